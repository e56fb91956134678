"""N-gram Jaccard join: MinHash banding to find pairs, full n-gram sets to verify them.

Words are what white space separates, in lower case; a text's n-grams are its
runs of five words (a shorter text is one n-gram). Texts of equal sets are
copies: one of them, the least id, stands for all. Representatives' sets get
MinHash values, cut into bands whose number and height are chosen for a target
recall at the threshold; band hashes are shuffled, and representatives that
share one are candidates of each other.

Candidates are never written out as pairs. Of the band buckets that a
representative shares with others the fullest is its own; its home is the
fullest of the own buckets of those that it shares a bucket with. A home's texts
are cut into blocks of at most about ``BLOCK`` texts and ``BLOCK_GRAMS`` n-grams, and
two blocks (or a block and itself) meet in a task where some bucket has texts
of both. Each representative has one block, so each pair of texts that share a
bucket meets exactly once, is verified on full sets, and no link between
different texts is lost; a chain of buckets makes no more blocks meet than
share a bucket. A task counts each text's links (a linked representative
counts with all its copies) and ties linked texts together; connected
components of these ties are the classes.

Defined results: null and empty texts have the empty set and are copies of each
other; a null id has no class (null) and no links; rows that repeat an id and
text are copies, each of them a row that others link to; if an id has several
texts, each text's row has its own class and links; an empty table gives no
rows; a text of any length is read whole. Sets are compared by 64-bit
n-gram hashes. ``join`` reads the id and the text alone, so other columns can't
clash; the stage keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import components, load, released, runs, shielded, small_batches, stored, unshielded

N = 5
THRESHOLD = (4, 5)  # similarity of 4/5 or more, held exactly
RECALL = 0.9995
HASHES = 128
BLOCK = 256
BLOCK_GRAMS = 1_000_000
KNOWN_WORDS = 100_000


def bands_for(threshold: float, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows with ``1 - (1 - t**rows)**bands >= recall``: the highest bands that ``hashes`` values allow."""
    for rows in range(hashes, 0, -1):
        bands = max(1, ceil(log(1 - recall) / log(1 - threshold**rows))) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("too few hashes for this recall")


class _Words(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


_WORDS = _Words()


def ngram_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    words = (text or "").lower().split()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(n, len(h))
    m = len(h) - size + 1
    out = h[:m] + np.uint64(size)
    for i in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


class Bander:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**32, bands * rows, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, bands * rows, np.uint64).astype(np.uint32)[:, None]

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        x = (grams >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.bands * self.rows, 2**32 - 1, np.uint32)
        for at in range(0, len(x), 512):
            v = self.a * x[None, at : at + 512] + self.b
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            np.minimum(low, v.min(1), out=low)
        low = low.reshape(self.bands, self.rows).astype(np.uint64)
        out = np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(self.rows):
            out = (out ^ low[:, i]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


def rows_with_id(df: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, text_key, text``; the key tells texts of one id apart."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))


def signatures(df: DataFrame, bander: Bander, key: str, text: str, n: int = N) -> DataFrame:
    """``doc_id, text_key, set_a, set_b, grams, bands`` of every row with an id, stored in the shared folder."""
    small_batches(df.sparkSession)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                grams = ngram_set(text, n)
                raw = grams.tobytes()
                out.append((xxhash.xxh3_64_intdigest(raw), xxhash.xxh3_64_intdigest(raw, 1), len(grams), bander(grams) if len(grams) else None))
            sets = np.array([r[:2] for r in out], np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "set_a": sets[:, 0], "set_b": sets[:, 1], "grams": [r[2] for r in out], "bands": [r[3] for r in out]})
        released()

    return stored(rows_with_id(df, key, text).mapInPandas(sign, "doc_id long, text_key long, set_a long, set_b long, grams long, bands array<bigint>"), "signatures")


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``left``, one of ``right``) whose sets are alike to the threshold, as two index arrays.

    Common n-grams are counted by products of 0/1 matrices over the n-grams
    that more than one text has, some columns at a time.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    owner, column = owner[keep], column[at[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)))
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        s = slice(*np.searchsorted(column, [lo, lo + width]))
        o, c = owner[s], column[s] - lo
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        a[place_l[o][place_l[o] >= 0], c[place_l[o] >= 0]] = 1
        b[place_r[o][place_r[o] >= 0], c[place_r[o] >= 0]] = 1
        both += a @ b.T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    alike = both * THRESHOLD[1] >= union * THRESHOLD[0]
    if same:
        alike &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    i, j = np.nonzero(alike)
    return left[i], right[j]


def _tied(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """The least index that each of ``n`` is connected with."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def blocks(buckets: DataFrame, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> tuple[DataFrame, DataFrame]:
    """From ``rep, grams, band, hash``: each representative's block (``rep, blk``), and the blocks that meet (``lo, hi``)."""
    full = buckets.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # another column's order, so that the join deals both sides anew and a very common hash can be split
    shared = stored(buckets.join(full.repartition("n", "hash"), ["band", "hash"]).select("rep", "grams", "band", "hash", "n"), "shared")
    own = shared.groupBy("rep").agg(F.max(F.struct("n", "band", "hash")).alias("own"))
    # the members of a dense group have different fullest buckets; each takes the fullest one of those it shares a bucket with
    best = shared.join(own, "rep").groupBy("band", "hash").agg(F.max("own").alias("best"))
    labels = shared.join(best.repartition("hash", "best"), ["band", "hash"]).groupBy("rep").agg(F.max("best").alias("home"), F.max("grams").alias("grams"))
    size = labels.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("grams") / F.lit(block_grams))).alias("parts"))
    homes = labels.join(size.repartition("parts", "home"), "home")
    homes = stored(homes.select("rep", F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("blk")), "homes")
    there = shared.select("rep", "band", "hash").join(homes, "rep").select("band", "hash", "blk").distinct()
    other = there.select("band", "hash", F.col("blk").alias("hi"))
    meet = there.withColumnRenamed("blk", "lo").join(other, ["band", "hash"]).where("lo <= hi").select("lo", "hi").distinct()
    return homes, stored(meet, "meet")


def classified(df: DataFrame, key: str, text: str, n: int, recall: float, hashes: int, block: int) -> DataFrame:
    """``doc_id, text_key, class, class_id, n_links`` of every row with an id; ``class`` numbers the classes, ``class_id`` is the class's least id."""
    bander = Bander(*bands_for(THRESHOLD[0] / THRESHOLD[1], recall, hashes))
    signed = signatures(df, bander, key, text, n)
    # copies: one representative for each set, known by a number of its own
    first = F.min(F.struct("doc_id", "text_key", "grams", "bands")).alias("first")
    reps = signed.groupBy("set_a", "set_b").agg(first, F.count(F.lit(1)).alias("copies")).select("set_a", "set_b", "first.*", "copies")
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    buckets = stored(reps.select("rep", "grams", F.posexplode("bands").alias("band", "hash")), "bands")
    homes, meet = blocks(buckets, block)
    # a row may repeat very often: its copies fall together before the text travels on
    of = reps.select("doc_id", "text_key", "rep", "copies").join(homes, "rep")
    texts = rows_with_id(df, key, text).join(of, ["doc_id", "text_key"]).groupBy("doc_id", "text_key", "rep", "copies", "blk").agg(F.max("text").alias("text"))
    ends = meet.select(F.col("lo").alias("blk"), "lo", "hi").unionByName(meet.where("lo <> hi").select(F.col("hi").alias("blk"), "lo", "hi"))
    small_batches(df.sparkSession)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (lo, hi), pdf in runs(batches, ["lo", "hi"]):
            sets = [ngram_set(t, n) for t in pdf["text"]]
            reps, copies, own = pdf["rep"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64), pdf["blk"].to_numpy(np.int64)
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            if not len(left) or not len(right):
                continue
            i, j = verified(sets, left, right, lo == hi)
            if not len(i):
                continue
            links = np.zeros(len(reps), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            some = np.unique(np.concatenate([i, j]))
            yield pd.DataFrame({"rep": reps[some], "links": links[some], "root": reps[np.array(_tied(len(reps), i, j))[some]]})
        released()

    # each text once for each two blocks that meet
    dealt = texts.join(ends, "blk").select("lo", "hi", "blk", "rep", "copies", "text").repartition("lo", "hi").sortWithinPartitions("lo", "hi", "rep")
    linked = stored(dealt.mapInPandas(verify, "rep long, links long, root long"), "links")
    groups = components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v")), "classes")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    answers = reps.select("set_a", "set_b", "doc_id", "rep", "copies").join(counts, "rep", "left").join(groups.select(F.col("node").alias("rep"), "root"), "rep", "left")
    answers = answers.select("set_a", "set_b", "doc_id", F.coalesce("root", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = answers.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    # dealt by other columns, so that the joins deal both sides anew and a very large class or set can be split
    answers = answers.drop("doc_id").join(least.repartition("class_id", "class"), "class")
    return signed.select("doc_id", "text_key", "set_a", "set_b").join(answers.repartition("class_id", "set_a"), ["set_a", "set_b"]).select("doc_id", "text_key", "class", "class_id", "n_links")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, recall: float = RECALL, hashes: int = HASHES, block: int = BLOCK) -> DataFrame:
    """``doc_id, class_id, n_links`` for every row: the least id of its class, and how many other rows are alike to it."""
    out = classified(df, key, text, n, recall, hashes, block).select("doc_id", "class_id", "n_links")
    none = df.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(none)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and link counts of all documents."""
    return join(load(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the least id; rows without an id stay."""
    rows, at = shielded(docs)
    key, text = at["doc_id"], at["text"]
    first = classified(rows, key, text, N, RECALL, HASHES, BLOCK).where("doc_id = class_id").select(F.col("doc_id").alias(key), "text_key", "class").distinct()
    # a class may have several texts of its least id, and a row may repeat: one row of a class
    one = Window.partitionBy("class").orderBy(F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.col(text))
    kept = rows.withColumn("text_key", F.xxhash64(text)).join(first, [key, "text_key"]).withColumn("nth", F.row_number().over(one)).where("nth = 1").select(*rows.columns)
    return unshielded(kept.unionByName(rows.where(F.col(key).isNull())), at)
