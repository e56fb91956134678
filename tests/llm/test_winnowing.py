import hashlib
import random

import numpy as np

from gridloom.llm import winnowing as w


def brute(text, k, window):
    """Chosen positions by the definition, on hashes made one character after another."""
    c = [ord(x) + 1 for x in text]
    k = min(k, len(c))
    h = []
    for i in range(len(c) - k + 1 if c else 0):
        v = 0
        for x in c[i : i + k]:
            v = (v * w.BASE + x) & w.M64
        v ^= v >> 32
        v = v * 0xD6E8FEB86659FD93 & w.M64
        h.append(v ^ v >> 32)
    window = min(window, len(h))
    chosen = set()
    for i in range(len(h) - window + 1 if h else 0):
        part = h[i : i + window]
        chosen.add(i + max(j for j, v in enumerate(part) if v == min(part)))
    return sorted(chosen), [h[i] for i in sorted(chosen)]


def test_winnow_is_the_definition():
    rng = random.Random(3)
    for k, window in ((1, 1), (5, 4), (7, 10), (20, 64)):
        for n in (0, 1, 2, 6, 30, 300):
            text = "".join(rng.choice("abü😀") for _ in range(n))
            pos, h = w.winnow(text, k, window)
            assert (pos.tolist(), h.tolist()) == brute(text, k, window)
    pos, _ = w.winnow("a" * 100, 3, 5)
    assert pos.tolist() == list(range(4, 98))  # ties go right


def test_shared_passage_is_found():
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = some(w.K + w.WINDOW - 1)
    a, b = w.winnow(some(500) + passage + some(300)), w.winnow(some(50) + passage + some(900))
    assert len(np.intersect1d(a[1], b[1])) >= 1


def test_query(spark, folder, docs):
    got = {r.doc_id: r for r in w.op2(spark, folder).collect()}
    order = sorted(docs, key=lambda d: (-d[0], d[1] or ""))
    texts = [d[1] or "" for d in order]
    assert w.op2(spark, folder).count() == len(docs)
    for i, d in enumerate(order):
        if d[0] == 405:
            continue
        a, b = texts[i], texts[(i + 1) % len(texts)]
        half = len(a) // 2
        e = a[: len(a) - half] + b[:half]
        r = got[d[0]]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(e.encode()).hexdigest())
        ha, hb, he = (w.winnow(x)[1] for x in (a, b, e))
        assert r.fingerprint == "".join(f"{x:016x}" for x in ha.tolist()) and r.edited_fingerprint == "".join(f"{x:016x}" for x in he.tolist())
        assert (r.positions, r.edited_positions) == (w.winnow(a)[0].tolist(), w.winnow(e)[0].tolist())
        for value, other in ((r.near_edited, he), (r.near_next, hb)):
            x, y = set(ha.tolist()), set(other.tolist())
            assert abs(value - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-12


def test_odd_rows(spark, nothing):
    assert w.op2(spark, nothing).count() == 0
    df = spark.createDataFrame([(None, "abc"), (None, None), (3, "x y z"), (9007199254740993, "q")], "doc_id long, text string")
    rows = w.compare_edits(df).collect()
    assert sorted(r.doc_id or -1 for r in rows) == [-1, -1, 3, 9007199254740993]
    one = w.compare_edits(df.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    clash = w.fingerprints(df.withColumnRenamed("doc_id", "Positions"))
    assert clash.columns == ["_Positions", "text", "positions", "hashes"] and clash.count() == 4
    many = spark.createDataFrame([(i // 3, "x" * 300) for i in range(300)], "doc_id long, text string")
    placed, n = w.with_ranges(many, "doc_id", "rng", "text", 7)
    assert n == 7 and sorted(r[0] for r in placed.select("rng").distinct().collect()) == list(range(7))
    assert w.compare_edits(many).count() == 300
    out = w.fingerprints(df.withColumnRenamed("doc_id", "winnowed"))
    assert out.columns == ["winnowed", "text", "positions", "hashes"] and out.count() == 4
