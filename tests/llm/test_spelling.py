import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from gridloom.llm import spelling as s

LETTERS = "abcdeàÿ"


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                total[run] += 1
    words = {w: n for w, n in total.items() if n >= 5}
    out, forms = [], {}
    for w, n in words.items():
        around = [x for x in words if near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        forms[w] = (best if best and words[best] >= 5 * n else None, len(around))
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        form, count = forms[w]
        out.append((w, form, root, n, count, words[form] if form else None))
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, Word string, n int").repartition(3)
    return sorted(map(tuple, s.variants(df).collect()))


def texts(seed, n=120, stems=25):
    rng = random.Random(seed)
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(5, 10))) for _ in range(stems)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(200)):
            w = base[int(rng.random() ** 2 * len(base))]
            if rng.random() < 0.4:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice(LETTERS)) + w[at + (kind != 1) :]
            words.append(w if rng.random() < 0.9 else w.upper())
        rows.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_all_pairs(spark, seed):
    rows = texts(seed)
    want = brute(rows)
    assert len(want) > 100 and sum(r[1] is not None for r in want) > 20
    assert found(spark, rows) == want


def test_changed_runs_and_chains(spark):
    rows = [(i, f"Variant variants colour color ÀÉîõü {'x' * (i % 9)}") for i in range(900)]
    rows += [(None, "colours " * 900), (2000, "colourse " * 7), (2001, "colourses " * 5), (2002, "aaaaaaa " * 600 + "aaaaaaaa " * 60 + "aaaaaaaaa " * 6)]
    want = brute(rows)
    assert any(r[1] and r[2] != r[1] for r in want)
    assert found(spark, rows) == want


def test_odd_rows(spark, nothing):
    assert s.op13(spark, nothing).count() == 0
    long = "y" * 30_000
    rows = [(1, None), (2, ""), (3, "12 34"), (4, "x ×÷×÷×÷ " * 6), (5, f"{long} {long}z " * 6), (6, "straße straßen " * 30), (6, "straße straßen " * 30), (7, "ǆabcdefǆ " * 8)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert [r[4] for r in got if len(r[0]) > 20_000] == [1, 1]


def test_a_text_is_cut_between_runs(monkeypatch):
    monkeypatch.setattr(s, "SLICE", 7)
    for text in ("", "abc", "a" * 30, "ab cdefghijkl mno, pqr" * 5, "1234567" * 3, "abcdef ghijklmnop"):
        assert [r for p in s.pieces(text) for r in s.RUN.findall(p)] == s.RUN.findall(text) and "".join(s.pieces(text)) == text


def test_keys_are_those_of_the_strings():
    words = ["abcdef", "aabbcc", "zzzzzz", "bcdef", "ÿabcdef", "abxdef"]
    key, word, kind, place = s.deletion_keys(words)
    of = {}
    for k, w, t, p in zip(key, word, kind, place, strict=True):
        rest = words[w] if t == s.OWN else words[w][:p] + words[w][p + 1 :]
        of.setdefault(int(k), set()).add((t == s.REPLACED, p if t == s.REPLACED else 0, rest))
    assert all(len(v) == 1 for v in of.values()) and len({x for v in of.values() for x in v}) == len(of)
    assert sum(kind == s.LONGER) == 6 + 3 + 1 + 5 + 7 + 6


def test_equal_keys_of_different_strings_are_parted():
    group = [(1, "abcdef", 9, s.OWN, -1), (2, "xyzdefg", 5, s.LONGER, 6), (3, "abcdefg", 5, s.LONGER, 6), (4, "abcdeg", 7, s.REPLACED, 5), (5, "abcdef", 9, s.REPLACED, 5), (6, "abXdef", 1, s.REPLACED, 2)]
    assert sorted(s.near_of(group)) == [(1, 1, 5, "abcdefg"), (3, 1, 9, "abcdef"), (4, 1, 9, "abcdef"), (5, 1, 7, "abcdeg")]


def test_hashes_spread():
    rng = np.random.default_rng(3)
    words = list({"".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(5000)})
    key, _, kind, _ = s.deletion_keys(words)
    assert len(set(key[kind == s.OWN].tolist())) == len(words)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(s.OP13_SQL)
    names = [d[0] for d in want.description]
    got = s.op13(spark, sf).select(*names).collect()
    want = sorted(map(tuple, want.fetchall()), key=str)
    assert sorted(map(tuple, got), key=str) == want and len(want) > 100
