import random

import numpy as np
import pytest

from gridloom.llm import ngram_join as j
from tests.llm import data


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Class and links by all pairs."""
    sets = [grams(t) for _, t in rows]
    ids = [k for k, _ in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if (not x and not y) or 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], least[find(i)], links[i]) for i in range(len(rows)))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_query_against_all_pairs(spark, folder, docs):
    got = sorted(map(tuple, j.op9(spark, folder).collect()))
    assert got == brute([(d[0], d[1]) for d in docs])


@pytest.mark.parametrize("block", [256, 7])
def test_near_copies_in_blocks(spark, block):
    rng = random.Random(block)
    rows = []
    for g in range(6):
        base = data.words(rng, 80, 10_000).split()
        for i in range(20):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            rows.append((g * 100 + i, " ".join(w)))
    got = sorted(map(tuple, j.join(frame(spark, rows), block=block).collect()))
    assert got == brute(rows)


def test_blocks_that_share_a_bucket_meet(spark):
    rng = random.Random(6)
    rows = [(r, 10, b, rng.randrange(12) if r < 60 else 1000 + r // 2) for r in range(120) for b in range(4)] + [(500 + i, 10, 0, i // 2) for i in range(40)]
    chain = [(1000 + i, 10, 5, i // 2) for i in range(100)] + [(1000 + i, 10, 6, (i + 1) // 2) for i in range(100)]  # each text shares a bucket with the next
    homes, meet = j.blocks(spark.createDataFrame(rows + chain, "rep long, grams long, band int, hash long"), block=5)
    of = {r.rep: r.blk for r in homes.collect()}
    met = {(r.lo, r.hi) for r in meet.collect()}
    sharing, wanted = {}, set()
    for rep, _, band, h in rows + chain:
        sharing.setdefault((band, h), []).append(rep)
    for reps in sharing.values():
        wanted |= {tuple(sorted((of[a], of[b]))) for a in reps for b in reps if len(reps) > 1}
    assert met == wanted
    assert len({b for b in met if of[1000] in b}) <= 2 and max(sum(1 for x in of.values() if x == b) for b in set(of.values())) <= 20


def test_a_block_is_bounded_by_n_grams(spark):
    rows = [(i, 100, 0, 7) for i in range(200)]
    homes, _ = j.blocks(spark.createDataFrame(rows, "rep long, grams long, band int, hash long"), 1000, 2000)
    assert len({r.blk for r in homes.collect()}) == 10


def test_bands():
    for recall in (0.9, 0.999):
        b, r = j.bands_for(0.8, recall)
        assert 1 - (1 - 0.8**r) ** b >= recall and b * r <= j.HASHES
    assert 1 - (1 - 0.8 ** j.bands_for(0.8)[1]) ** j.bands_for(0.8)[0] >= 0.9995


def test_verified_counts():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(330, 400), replace=False)) for _ in range(60)] + [np.zeros(0, np.uint64)]
    left, right = np.arange(0, 30), np.arange(30, 61)
    i, k = j.verified(sets, left, right, False)
    want = {(a, b) for a in left for b in right if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])) and len(sets[b])}
    assert set(zip(i.tolist(), k.tolist(), strict=True)) == want


def test_recall_on_the_supplied_documents(spark):
    """Links of every fifth document, against all documents by brute force."""
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, grams(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.n_links for r in j.op9(spark, sf).collect()}
    want = {k: sum(1 for o, t in docs if o != k and ((not s and not t) or 5 * len(s & t) >= 4 * len(s | t))) for k, s in docs if k % 5 == 0}
    assert sum(want.values()) >= 10 and sum(min(got[k], n) for k, n in want.items()) >= 0.99 * sum(want.values())
    assert all(got[k] <= n for k, n in want.items())


def test_odd_rows(spark, nothing):
    assert j.op9(spark, nothing).count() == 0
    rows = [(1, None), (2, ""), (None, "a b"), (3, "One two"), (4, "one  TWO"), (5, "x " * 50_000), (5, "x " * 50_000), (6, "p q r"), (6, "s t u"), (7, "s t u")]
    got = sorted(map(tuple, j.join(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, 1), (2, 1, 1), (None, None, 0), (3, 3, 1), (4, 3, 1), (5, 5, 1), (5, 5, 1), (6, 6, 0), (6, 6, 1), (7, 6, 1)], key=str)


def test_stage_keeps_one_of_each_class(spark, folder, docs):
    df = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as class_id", "2 as in_1", "3 as nth")
    out = j.stage(spark, df, folder)
    assert out.columns == df.columns
    want = sorted({c for _, c, _ in brute([(d[0], d[1]) for d in docs])})
    assert sorted(r.doc_id for r in out.collect()) == want


T = " ".join(f"w{i}" for i in range(40))
U = "quite another text of one and the same id"
NEAR = T + " end"


@pytest.mark.parametrize(
    ("rows", "links"),
    [
        ([(1, T), (1, T), (2, NEAR)], [2, 2, 2]),
        ([(1, T), (1, T), (3, T), (2, NEAR), (2, NEAR)], [4] * 5),
        ([(1, T), (1, U), (2, NEAR)], [0, 1, 1]),
        ([(5, T), (5, U), (2, NEAR), (2, U)], [1, 1, 1, 1]),
    ],
)
def test_links_of_repeated_rows_and_ids(spark, rows, links):
    got = sorted(map(tuple, j.join(frame(spark, rows)).collect()))
    assert got == brute(rows) and sorted(n for *_, n in got) == links


def test_random_tables_with_repeats_and_shared_ids(spark):
    rng = random.Random(8)
    bases = [data.words(rng, 60, 5000).split() for _ in range(4)]
    rows = []
    for _ in range(90):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"v{rng.randrange(4)}"
        rows += [(rng.randrange(50), " ".join(w))] * rng.choice([1, 1, 1, 3])
    assert sorted(map(tuple, j.join(frame(spark, rows), block=9).collect())) == brute(rows)


def test_stage_keeps_other_texts_of_an_id(spark):
    rows = [(1, T), (1, T), (1, U), (2, NEAR), (3, U), (4, NEAR + " more"), (None, T)]
    out = j.stage(spark, frame(spark, rows), "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, T), (1, U), (None, T)], key=str)
