import hashlib
import random

import duckdb
import numpy as np
import pytest

from gridloom.llm import clustering as c

ROWS = "label int, vec_id long, embedding array<double>, cluster string, Distance int"


def brute(rows, k=8, rounds=10, dims=64):
    """Plain rounds in whole numbers."""
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) <= c.LIMIT for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)[:k]
    now = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [min(range(len(now)), key=lambda j: (far(v, now[j]), j)) for _, v in good]
        if r == rounds:
            break
        for j in range(len(now)):
            own = [v for (_, v), a in zip(good, at, strict=True) if a == j]
            if own:
                now[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    d = [far(v, now[a]) for (_, v), a in zip(good, at, strict=True)]
    names = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in now]
    return [(i, a, x, sum(y for y, b in zip(d, at, strict=True) if a == b), sum(d), names[a]) for (i, _), a, x in zip(good, at, d, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(1, i, v, "x", 3) for i, v in rows], ROWS).repartition(3)


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_rounds_against_plain_ones(spark, spread):
    rng = np.random.default_rng(int(spread * 100))
    middles = rng.normal(0, 0.4, (11, 64))
    rows = [(i, (middles[i % 11] + rng.normal(0, spread, 64)).tolist()) for i in range(300)]
    out, centroids = c.cluster(frame(spark, rows))
    same(out.collect(), brute(rows))
    assert centroids.shape == (8, 64)


def test_ties_repeats_and_what_is_left_out(spark):
    one, two = [0.001] * 64, [-0.0005] * 64
    mean = [float("nan")] + [0.0] * 63
    rows = [(1, one), (1, one), (2, two), (3, one), (None, two), (4, None), (5, one[:-1]), (6, [None] + one[1:]), (7, mean), (8, [float("inf")] + one[1:]), (9, [1e30] + one[1:]), (10, [])]
    rows += [(20 + i, [random.Random(i).choice([0.0, 0.125]) for _ in range(64)]) for i in range(30)]  # many equal distances
    same(c.cluster(frame(spark, rows))[0].collect(), brute(rows))


def test_few_vectors_and_none(spark):
    rows = [(i, [i / 8] * 64) for i in range(3)]
    same(c.cluster(frame(spark, rows))[0].collect(), brute(rows))
    assert c.cluster(frame(spark, rows).where("vec_id > 99"))[0].count() == 0
    assert c.cluster(frame(spark, [(None, [0.5] * 64)]))[0].count() == 0


def test_bounds_hold_and_save_scans():
    rng = np.random.default_rng(4)
    x = (rng.normal(0, 1, (2000, 64)) + rng.integers(0, 8, 2000)[:, None] * 3).astype(np.float64)
    x = np.floor(x * 1024).astype(np.int64)
    now, before, scans = x[:8].copy(), None, []
    at, upper, lower = np.full(2000, -1), np.zeros(2000), np.zeros(2000)
    for _ in range(8):
        scans.append(c.Bounds(now, before).assign(x, at, upper, lower))
        d = np.stack([c.squared(x, m) for m in now], 1)
        assert (at == d.argmin(1)).all()
        two = np.sort(np.sqrt(d.astype(float)), 1)
        assert (upper >= two[:, 0]).all() and (lower <= two[:, 1]).all()
        before = now
        now = np.array([x[at == j].sum(0) // max(1, (at == j).sum()) if (at == j).any() else now[j] for j in range(8)])
    assert scans[0] == 2000 and scans[-1] < 500


def test_far_components_stay_exact():
    x = np.array([[2**27] * 64, [-(2**27)] * 64], np.int64)
    assert c.squared(x, x[::-1]).tolist() == [64 * 2**56] * 2


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(c.OP11_SQL)
    names = [d[0] for d in want.description]
    got = c.op11(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.fetchall()))
