import random
import re

import duckdb
import numpy as np
import pytest

from gridloom.llm import near_duplicates as d
from tests.llm import data


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Components by all pairs; rows without an id link nothing."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and None not in (rows[a][0], rows[b][0]) and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    out = []
    for i, (k, _) in enumerate(rows):
        c = None if k is None else least[find(i)]
        out.append((k, len(sets[i]), c, k == c))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, node string, comp int, Kept int").repartition(3)


def found(spark, rows, **more):
    return sorted(map(tuple, d.classes(frame(spark, rows), **more).collect()), key=str)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.random()}"
    return " ".join(w)


def test_query_against_all_pairs(spark, folder, docs):
    got = sorted(map(tuple, d.op12(spark, folder).collect()), key=str)
    assert got == brute([(x[0], x[1]) for x in docs])


@pytest.mark.parametrize(("block", "rounds"), [(256, 2), (5, 1), (7, 0)])
def test_groups_chains_and_hubs(spark, block, rounds):
    rng = random.Random(block)
    rows = []
    for g in range(4):  # dense groups, their members below and above the threshold among themselves
        base = data.words(rng, 150, 10_000).split()
        rows += [(g * 100 + i, edited(rng, base, rng.randrange(5))) for i in range(25)]
    step = data.words(rng, 150, 10_000).split()
    for i in range(25):  # a chain: each is like the next only
        rows.append((1000 - i, " ".join(step)))
        step = edited(rng, step, 2).split()
    rng.shuffle(rows)
    assert found(spark, rows, block=block, rounds=rounds) == brute(rows)


def test_a_common_passage_links_nothing(spark):
    rng = random.Random(3)
    shared = data.words(rng, 120, 10_000)
    rows = [(i, f"{shared} {data.words(rng, 60, 10_000)}") for i in range(60)]
    want = brute(rows)
    assert all(kept for *_, kept in want)
    assert found(spark, rows, block=10, rounds=1) == want


def test_the_threshold_is_met_exactly(spark):
    """17 of 20 shingles in common is a link, 16 of 20 is none."""
    words = [f"w{i}" for i in range(60)]
    a = " ".join(words[:21])  # 17 shingles
    rows = [(1, a), (2, " ".join(words[:24]))]  # 20 shingles: 17 / 20
    rows += [(3, " ".join(words[30:50])), (4, " ".join(words[30:54]))]  # 16 / 20
    assert found(spark, rows) == brute(rows) == sorted([(1, 17, 1, True), (2, 20, 1, False), (3, 16, 3, True), (4, 20, 4, True)], key=str)


def test_odd_rows(spark, nothing):
    assert d.op12(spark, nothing).count() == 0
    long = data.words(random.Random(1), 30_000, 50_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c"), (4, "A B c"), (5, "a b\x0bC"), (6, "a b c"), (7, long), (8, long + " end"), (8, long + " end"), (9, "É b"), (10, "é b")]
    rows += [(11, "one id and text here"), (11, "another text of that id here"), (12, "another text of that id here"), (13, "one id and text here")] + [(14, "again and again and again once more")] * 40
    assert found(spark, rows) == brute(rows)


def test_minima_are_fair():
    """The share of equal minima is near the sets' likeness, and signatures agree at the threshold."""
    m, rng = d.Minima(20, 5), np.random.default_rng(1)
    agree, lost = [], 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = np.unique(x[:370]), np.unique(x[30:])  # 340 of 400
        p, q = m(a), m(b)
        agree.append((p == q).mean())
        lost += np.count_nonzero(p.astype(np.uint8) == q.astype(np.uint8)) < d.AGREE or not (m.banded(p) == m.banded(q)).any()
        assert d.alike(a, b)
    assert abs(np.mean(agree) - 0.85) < 0.01 and lost == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(d.OP12_SQL)
    names = [x[0] for x in want.description]
    got = d.op12(spark, sf).select(*names).collect()
    want = sorted(map(tuple, want.fetchall()))
    assert sorted(map(tuple, got)) == want and sum(not k for *_, k in want) > 20
