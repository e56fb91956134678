import random
import zlib

import numpy as np

from gridloom.llm import quality as q
from tests.llm import data


def corpus(n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        t, good = data.words(rng, rng.randrange(30, 300)), i % 4 > 0
        if not good:
            t = [t.upper().replace(" ", "!! "), t.replace(" ", "*** "), (t[:40] + "\n") * 30][i % 3]
        rows.append((i, t, "en", "a", len(t)))
        if i % 3:
            labels.append((i, int(good), 0))
    return rows, labels


def test_density_is_that_of_the_definition():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 2, (50, 3)), 1: rng.normal(1, 1, (80, 3))}
    m = q.fit({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()})
    cov = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    pooled = (50 * cov[0] + 80 * cov[1]) / 130
    at, density = rng.normal(0, 2, (20, 3)), {}
    for c in (0, 1):
        s = (1 - q.SHRINK_POOLED) * cov[c] + q.SHRINK_POOLED * pooled
        s = (1 - q.SHRINK_DIAGONAL) * s + q.SHRINK_DIAGONAL * np.diag(np.diag(s)) + 1e-3 * np.eye(3)
        d = at - x[c].mean(0)
        density[c] = np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)) / np.sqrt(np.linalg.det(s)) * len(x[c])
    assert np.allclose(m.score(at), density[1] / (density[0] + density[1]))


def test_held_out(spark, tmp_path):
    rows, labels = corpus()
    sf = data.write(spark, tmp_path, rows, labels)
    got = {r.doc_id: r for r in q.op5(spark, sf).collect()}
    assert len(got) == len(rows)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    truth = {k: v for k, v, _ in labels}
    held = [k for k in truth if got[k].held_out]
    assert np.mean([got[k].predicted == truth[k] for k in held]) >= 0.95
    # held-out labels have no influence
    flipped = [(k, 1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v, 0) for k, v, _ in labels]
    again = {r.doc_id: r.score for r in q.op5(spark, data.write(spark, tmp_path / "x", rows, flipped)).collect()}
    assert all(abs(again[k] - r.score) < 1e-6 for k, r in got.items())
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as score", "2 as in_0", "3 as stats")
    kept = q.stage(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}


def test_odd_rows(spark, folder, docs, nothing):
    got = q.op5(spark, folder).collect()
    assert len(got) == len(docs) and all(r.score is not None for r in got)
    assert q.op5(spark, nothing).count() == 0
    few = spark.createDataFrame([(1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in q.classify(few, one.where("doc_id = 5")).collect()} == {0.5}
    assert len(q.classify(few, one).collect()) == 3
    assert len(q.statistics(None)) == len(q.statistics("word " * 100_000)) == q.D
