import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridloom.llm import dac, packing, token_files, tokens


def library(name):
    """The library's own tokenizer, as its file has it."""
    return Tokenizer.from_file(tokens.vocabulary(name))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_give_the_ids_of_the_whole_text(name):
    enc = tokens.Encoder(tokens.vocabulary(name))
    rng = random.Random(2)
    signs = ["a", "Bc", "é", "é", "Σ", " ", "  ", "\n", "\n\n", "\t", " ", " ", "\x1c", "\x85", "\r\n", "1", "23", "!", "...", "'s", "'ll", "😀", "̈", "<|endoftext|>", "ß", "İ", "中", "|", " ."]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", " ", "\n", "x" * 5000]
    texts += ["a <|endoftext|> b", "<|startoftext|>", "x<|ENDOFTEXT|>y", "two <|endoftext|><|endoftext|>\n  lines", "<|endoftext", "no |> end <|"]
    whole = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc(texts)] == whole
    assert [x.tolist() for x in enc(texts)] == whole  # from memory


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_encoded_as_a_line(name):
    enc = tokens.Encoder(tokens.vocabulary(name))
    rng = random.Random(3)
    words = ["".join(rng.choice("abcXYZ019'<>/|.,-\x00\x7fw") for _ in range(rng.randrange(1, 12))) for _ in range(5000)] + ["'s", "</w>", "a</w>", "<|end", "x" * 300]
    words += ["".join(rng.choice("abcÀÉÿßµñ«×½\x7f\x80\x9f'1") for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    plain = library(name)
    want = [plain.encode(f" {w}", add_special_tokens=False).ids for w in words]
    got = enc.line(words)
    assert got is not None and [x.tolist() for x in np.split(got[0], got[1])[:-1]] == want and got[1][-1] == len(got[0])
    odd = " ".join(["plain", *words, "é"])
    assert enc([odd])[0].tolist() == plain.encode(odd, add_special_tokens=False).ids
    enc.sizes[:] = 1  # sizes that fit no word: each is encoded by itself
    enc.forget()
    assert enc.line(words) is None and enc([odd])[0].tolist() == plain.encode(odd, add_special_tokens=False).ids


def test_codes_random_access():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(70), rng.integers(0, 49408, 5000), rng.integers(0, 2**32, 3000), rng.integers(0, 300, 1024 * 3 + 1)):
        for bits in (4, 8):
            r = dac.Reader(dac.encode(ids.astype(np.uint32), bits))
            at = rng.integers(0, max(1, len(ids)), 500)[: 500 * bool(len(ids))]
            for lo, hi in ((1, 64), (63, 130), (700, 701), (1000, 2050), (2, 2), (len(ids), len(ids) + 5)):
                assert (r.slice(lo, hi) == ids[lo:hi]).all() and len(r.slice(lo, hi)) == len(ids[lo:hi])
            assert len(r) == len(ids) and (r.slice(0, len(ids)) == ids).all() and (r.read(at) == ids[at]).all()
    with pytest.raises(ValueError):
        dac.Reader(b"no token file" * 3)
    blob = dac.encode(np.arange(9), 4, [7, -3], [0, 5], 1)
    assert (dac.Reader(blob).docs.tolist(), dac.Reader(blob).starts.tolist(), dac.Reader(blob).nulls) == ([7, -3], [0, 5], 1)


def test_one_token_read_by_range():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 49408, 50_000).astype(np.uint32)
    ids[:300] = 5
    blob = dac.encode(ids, 8, list(range(100)), list(range(100)))
    read = []

    def fetch(at, n):
        read.append(n)
        return blob[at : at + n]

    for at in [0, 63, 64, 1023, 1024, 299, 300, 49_999, *rng.integers(0, 50_000, 200).tolist()]:
        read.clear()
        assert dac.token(fetch, at) == ids[at]
        assert sum(read) < 80 and len(read) < 12  # the counts of the levels, and a few bytes of each
    with pytest.raises(IndexError):
        dac.token(fetch, 50_000)
    assert dac.token(lambda at, n: dac.encode(np.array([70_000, 3]), 8)[at : at + n], 0) == 70_000


def test_tokens_lie_in_storage_byte_by_byte(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some words of text number {i} " * 50) for i in range(200)], "doc_id long, text string")
    table = token_files.write(df, segment_tokens=10**9)
    got = sorted(token_files.read(table).collect(), key=lambda r: r.start)
    tok = library(token_files.VOCABULARY)
    (want,) = [np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1]) for r in df.where("doc_id = 150").collect()]
    seen = 0
    for path in table.inputFiles():
        with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
            raw = f.read()
            begin = raw.find(dac.MAGIC)
            while begin >= 0:
                try:
                    reader = dac.Reader(raw[begin:])
                except (struct.error, ValueError):  # the file's beginning alone, in the statistics
                    reader = None
                if reader and 150 in reader.docs.tolist():
                    at = int(reader.starts[reader.docs.tolist().index(150)])

                    def fetch(offset, n, begin=begin):
                        f.seek(begin + offset)
                        return f.read(n)

                    assert [dac.token(fetch, at + i) for i in range(len(want))] == want.tolist()
                    seen += 1
                begin = raw.find(dac.MAGIC, begin + 1)
    assert seen == 1 and len(got) == 200


def test_token_files(spark, folder, docs, nothing):
    table = token_files.write(spark.read.parquet(f"{folder}/documents.parquet"), segment_tokens=2000)
    assert table.count() > 5
    for rows in (token_files.read(table).collect(), token_files.op7(spark, folder).collect()):
        tok = library(token_files.VOCABULARY)
        start, want = 0, []
        for d in sorted(docs, key=lambda d: (d[0], d[1] or "")):
            ids = [*tok.encode(d[1] or "", add_special_tokens=False).ids, 1]
            want.append((d[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert token_files.op7(spark, nothing).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, None), (-5, "b"), (2**60 + 1, "c")], "doc_id long, text string")
    got = sorted(token_files.read(token_files.write(odd)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -5, 2**60 + 1] and [r.n_tokens for r in got] == [1, 2, 2, 2]


def check_packing(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for got in by.values():
        at = 0
        for offset, n in sorted(got):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark, folder, docs, nothing):
    rows = packing.op10(spark, folder).collect()
    tok = library(packing.VOCABULARY)
    want = []
    for d in docs:
        ids = np.array([*tok.encode(d[1] or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        for i, (a, b) in enumerate([(0, head), *((x, x + 1024) for x in range(head, len(ids), 1024))]):
            want.append((d[0], i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    n, least = check_packing(rows), -(-sum(r.length for r in rows) // 1024)
    assert least <= n <= 1.03 * least + 1
    assert packing.op10(spark, nothing).count() == 0
    odd = spark.createDataFrame([(None, "a", 1), (None, None, 1), (3, "b " * 3000, 1), (3, "b " * 3000, 1)], "doc_id long, text string, rank int")
    assert check_packing(packing.stage(spark, odd, "").collect()) >= 6


def test_columns_stay(spark):
    cut = spark.createDataFrame([(i, 0, 0, 1 + i % 7, i, "a", 5, 6) for i in range(50)], "doc_id long, piece int, start long, length long, ids_crc32 long, Offset string, cell int, rank int")
    got = packing.pack(cut, capacity=10, max_docs=3)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "_Offset", "cell", "rank", "sequence_id", "offset"]
    rows = got.collect()
    assert check_packing(rows, 10) and all((r._Offset, r.cell, r["rank"]) == ("a", 5, 6) for r in rows)
    assert max(sum(1 for r in rows if r.sequence_id == q.sequence_id) for q in rows) <= 3


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(30, None, None), (30, 3, None), (30, 4, 500.0), (40, 6, 700.0)])
def test_every_choice_is_the_best_one(rule, limits):
    capacity, docs, cost = limits
    rng = random.Random(9)
    limit = np.array([capacity, docs or capacity, cost or capacity**2])
    w = np.array(packing.WEIGHTS) / limit**2
    for _ in range(40):
        counts = {n: rng.randrange(1, 6) for n in rng.sample(range(1, 23), 8)}
        room, opened = {}, 0  # sequences that are open, piece by piece in the plan's order
        for length, lo, hi, first, each, _ in packing.best_fit(counts, capacity, docs, cost, rule=rule):
            for r in range(lo, hi):
                demand = np.array([length, 1, length**2])
                fits = {s: x for s, x in room.items() if (demand <= x).all()}
                score = {s: ((x - demand) ** 2 * w).sum() if rule == "norm" else -(x * demand * w).sum() for s, x in fits.items()}
                s = first + (r - lo) // each
                if fits:
                    assert s in fits and score[s] <= min(score.values()) + 1e-9
                else:
                    assert s == opened
                    opened += 1
                    room[s] = limit.astype(float)
                room[s] = room[s] - demand
                assert (room[s] >= 0).all()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_limit(rule):
    rng = random.Random(6)
    counts = {rng.randrange(1, 76): rng.randrange(1, 40) for _ in range(60)}
    plan = packing.best_fit(counts, 100, 3, 6000.0, rule=rule)
    bins, seen = {}, {}
    for length, lo, hi, first, each, offset in plan:
        for r in range(lo, hi):
            bins.setdefault(first + (r - lo) // each, []).append((offset + (r - lo) % each * length, length))
            seen.setdefault(length, []).append(r)
    assert {n: sorted(r) for n, r in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
    for got in bins.values():
        assert len(got) <= 3 and sum(n for _, n in got) <= 100 and sum(n * n for _, n in got) <= 6000


def test_best_fit_is_near_the_bound_and_limits_hold():
    rng = random.Random(8)
    counts = {}
    for _ in range(20_000):
        n = min(70, int(rng.expovariate(0.05)) + 1)
        counts[n] = counts.get(n, 0) + 1
    for docs, cost in ((100, None), (4, None), (100, 5500.0), (3, 5200.0)):
        plan = packing.best_fit(counts, 100, docs, cost)
        used = {}
        for length, lo, hi, first, each, _ in plan:
            for r in range(lo, hi):
                b = used.setdefault(first + (r - lo) // each, [0, 0, 0])
                b[0], b[1], b[2] = b[0] + length, b[1] + 1, b[2] + length * length
        assert all(b[0] <= 100 and b[1] <= docs and b[2] <= (cost or 10_000) for b in used.values())
        if docs == 100 and not cost:
            assert len(used) <= 1.02 * sum(k * v for k, v in counts.items()) / 100
    with pytest.raises(ValueError):
        packing.best_fit({80: 1}, 100, 5, 100.0)


def test_no_limit_of_documents_of_its_own(spark, tmp_path):
    """One token each: as few sequences as hold them."""
    assert len({s + i for _, lo, hi, s, k, _ in packing.best_fit({1: 100_000}) for i in range(-(-(hi - lo) // k))}) == 98
    spark.range(3000).selectExpr("id as doc_id", "if(id % 2 = 0, '', null) as text").write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op10(spark, str(tmp_path))
    assert got.select("sequence_id").distinct().count() == 3 and got.count() == 3000
