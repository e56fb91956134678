import re
from collections import defaultdict

import duckdb

from gridloom.llm import mixing


def level(sizes, weights=(5, 2, 1), total=1.5, most=2):
    """Shares with limits, reshared again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, share, active = total * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while active:
        part = {s: left * w[s] / sum(w[x] for x in active) for s in active}
        over = {s for s in active if part[s] > most * sizes[s]}
        if not over:
            share |= part
            break
        for s in over:
            share[s] = float(most * sizes[s])
            left -= share[s]
        active -= over
    return share


def test_targets_and_taken(spark, folder, docs):
    rows = mixing.op4(spark, folder).collect()
    assert len(rows) == len(docs)
    size = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs}
    of, sizes = {d[0]: d[3] for d in docs}, defaultdict(int)
    for d in docs:
        sizes[d[3]] += size[d[0]]
    want, taken = level(dict(sizes)), defaultdict(int)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[of[r.doc_id]] and abs(r.target - want[of[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[of[r.doc_id]] += r.taken
    for s in sizes:
        largest = max(size[k] for k in of if of[k] == s)
        assert abs(taken[s] - want[s]) <= 1.5 * largest + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op4(spark, folder).collect()))


def test_query_is_its_sql(spark, folder, nothing):
    for place in (folder, nothing):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{place}/documents.parquet/*.parquet'")
        df = mixing.op4(spark, place)
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({mixing.OP4_SQL})").fetchall()
        assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_each_document_gets_its_expectation_rounded(spark, folder):
    for r in mixing.op4(spark, folder).collect():
        e = r.target / r.source_size if r.source_size else 0
        assert int(e) <= r.copies <= int(e) + 1


def test_stage_and_odd_rows(spark, folder, nothing):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clash = docs.selectExpr("*", "1 as size", "2 as copies", "'x' as mix_source", "3 as target")
    out = mixing.stage(spark, clash, folder)
    assert out.columns == clash.columns
    assert out.count() == sum(r.copies for r in mixing.op4(spark, folder).collect())
    assert mixing.op4(spark, nothing).count() == 0 and mixing.stage(spark, spark.read.parquet(f"{nothing}/documents.parquet"), nothing).count() == 0
    empty = docs.where("doc_id in (400, 401)")
    assert [r.copies for r in mixing.mix(empty).collect()] == [0, 0]
