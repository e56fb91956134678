from collections import Counter

import corpus_pipeline
from gridloom.llm import quality
from tests.llm import data
from tests.llm.test_mixing import level
from tests.llm.test_ngram_join import brute
from tests.llm.test_quality import corpus
from tests.llm.test_tokens import check_packing


def test_stages_one_by_one(spark, tmp_path):
    rows, labels = corpus(200)
    rows += [(1000 + r[0], r[1], r[2], "b", r[4]) for r in rows[:60]]
    sf = data.write(spark, tmp_path / "in", rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        before = docs.collect()
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        got = docs.collect()
        if i < 3:
            assert docs.columns == columns
        if name == "quality_classifier":
            keep = {r.doc_id for r in quality.op5(spark, sf).collect() if r.predicted}
            assert {r.doc_id for r in got} == keep and len(got) < len(before)
        elif name == "ngram_jaccard_join":
            assert sorted(r.doc_id for r in got) == sorted({c for _, c, _ in brute([(r.doc_id, r.text) for r in before])})
        elif name == "source_mixing":
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
            want = level(sizes)
            for s in want:
                assert abs(sum(len(r.text.split()) for r in got if r.source == s) - want[s]) <= 600
            assert max(Counter(r.doc_id for r in got).values()) <= 2
        else:
            check_packing(got)
            assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in before)
    assert corpus_pipeline.run(spark, sf).count() == len(got)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]


def test_stages_on_nothing_and_on_odd_columns(spark, tmp_path, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0
    rows, labels = corpus(60)
    rows = [*rows, (None, None, None, None, None), (9001, None, "en", None, 0), (9002, "", None, "b", 0), (9002, "", None, "b", 0), (None, "some words without an id", "en", "a", 24)]
    sf = data.write(spark, tmp_path / "odd", rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as Size", "2 as copies", "3 as class_id", "'s' as score", "4 as piece", "5 as sequence_id", "6 as stats", "7 as bands", "8 as in_0")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/odd-{i}")
        docs = spark.read.parquet(f"{tmp_path}/odd-{i}")
        assert docs.columns == columns or i == 3
    assert docs.count() > 0
