"""Document fingerprints by winnowing.

A text's code points give one rolling hash for each run of ``k`` characters;
of each ``window`` consecutive hashes the least is chosen, the rightmost among
equals, and every chosen hash is kept once with its position. Texts that share
a passage of at least ``window + k - 1`` characters share a chosen hash, and the
positions say where it stands in each.

Defined results: a null text counts as empty; an empty text has no hashes; a
text shorter than ``k`` has the one hash of all its characters, and one with
fewer than ``window`` hashes keeps the least of them. Two texts without hashes
are alike to 1.0. Rows that repeat an id are ordered by text. A text of any
length is read whole; an empty table gives no rows. ``fingerprints`` keeps an
input column named as a result under a name with a leading underscore; the
other functions read the id and the text alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import LOWEST, aside, fresh, load, small_batches, with_ranges

K = 12
WINDOW = 24
BASE = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1


def _powers(k: int) -> dict[int, np.uint64]:
    return {n: np.uint64(pow(BASE, n, 1 << 64)) for n in range(k + 1)}


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``k`` code points, built by doubling, then mixed."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    power = _powers(k)
    one = codes.astype(np.uint64) + np.uint64(1)
    done, have, block, size = None, 0, one, 1
    bits = k
    while bits:
        if bits & 1:
            if done is None:
                done, have = block, size
            else:
                m = n - have - size + 1
                done = done[:m] * power[size] + block[have : have + m]
                have += size
        bits >>= 1
        if bits:
            m = n - 2 * size + 1
            block = block[:m] * power[size] + block[size : size + m]
            size *= 2
    h = done ^ (done >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def winnow(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen positions (ascending) and their hashes."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    h = gram_hashes(codes, k)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), h
    window = min(window, n)
    at = np.arange(n)
    value, place, size = h, at, 1
    while size < window:  # windows of `size` become windows of up to 2 * size, overlapping at the end
        step = min(size, window - size)
        m = len(value) - step
        left, right = value[:m], value[step:]
        later = right <= left
        value, place = np.where(later, right, left), np.where(later, place[step:], place[:m])
        size += step
    keep = np.ones(len(place), bool)
    keep[1:] = place[1:] != place[:-1]
    place = place[keep]
    return place, h[place]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among all chosen hashes of two texts, both sorted and distinct."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def packed(hashes: np.ndarray) -> str:
    """The chosen hashes in text order, 16 hexadecimal digits each."""
    return hashes.astype(">u8").tobytes().hex()


def fingerprints(df: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Add ``positions array<long>`` and ``hashes array<long>`` to each row."""
    small_batches(df.sparkSession)
    df, now_named = aside(df, "positions", "hashes")
    schema = "struct<positions: array<bigint>, hashes: array<bigint>>"
    (both,) = fresh(df, "winnowed")

    @F.pandas_udf(schema)
    def udf(texts: pd.Series) -> pd.DataFrame:
        got = [winnow(t, k, window) for t in texts]
        return pd.DataFrame({"positions": [p for p, _ in got], "hashes": [h.view(np.int64) for _, h in got]})

    return df.withColumn(both, udf(now_named(text))).select(*df.columns, f"{both}.positions", f"{both}.hashes")


def chained(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents in ranges of descending ``key``, each range ended by a copy of the document that follows it.

    Returns rows ``rng, k, ends, key, text`` sorted within partitions. Ranges are
    cut by quantiles, so no task holds more than its share; the only rows sent
    twice are the first of each range. The last range ends with the very first
    document.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(key), F.lit(LOWEST)).cast("long").alias("k"))
    placed, n = with_ranges(rows, "k", "rng", "text")
    firsts = sorted((r[0], r[1]) for r in placed.groupBy("rng").agg(F.max("k")).collect())  # one row a range
    heads = [(firsts[i][1], firsts[(i + 1) % len(firsts)][0]) for i in range(len(firsts))]
    follows = F.broadcast(spark.createDataFrame(heads, "k long, before int"))
    every = F.array(F.struct(F.col("rng"), F.lit(0).alias("ends")), F.struct(F.col("before").alias("rng"), F.lit(1).alias("ends")))
    dealt = placed.join(follows, "k", "left").withColumn("to", F.explode(F.filter(every, lambda x: x.rng.isNotNull())))
    dealt = dealt.select("to.rng", "to.ends", "k", "doc_id", "text")
    return dealt.repartitionById(n, "rng").sortWithinPartitions("rng", "ends", F.desc("k"), "text")


def edited(text: str, following: str) -> str:
    """The second half of ``text`` replaced by as many first characters of ``following``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edits(df: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and its edited text with the positions of their hashes, and how alike they are."""
    small_batches(df.sparkSession)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the document whose follower is not known yet
        for pdf in batches:
            out = []
            ids = [k if there else None for k, there in zip(pdf["k"].tolist(), pdf["doc_id"].notna(), strict=True)] if pdf["doc_id"].isna().any() else pdf["k"].tolist()
            for rng, ends, doc_id, text in zip(pdf["rng"], pdf["ends"], ids, pdf["text"], strict=True):
                if ends and (held is None or held[0] != rng):
                    continue  # a further copy of the follower
                pos, h = winnow(text, k, window)
                own = np.unique(h)
                if held is not None and held[0] == rng:
                    _, last_id, last_text, last_pos, last_h, last_own = held
                    changed = edited(last_text, text)
                    epos, eh = winnow(changed, k, window)
                    out.append((last_id, len(last_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), packed(last_h), packed(eh), likeness(last_own, np.unique(eh)), likeness(last_own, own), last_pos, epos))
                held = None if ends else (rng, doc_id, text, pos, h, own)
            yield pd.DataFrame({
                "doc_id": pd.array([r[0] for r in out], dtype="Int64"),
                **{c: [r[i] for r in out] for i, c in enumerate(("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions", "edited_positions"), 1)},
            })

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<bigint>, edited_positions array<bigint>"
    return chained(df).mapInPandas(walk, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_edits(load(spark, sf_dir, "documents").select("doc_id", "text"))
