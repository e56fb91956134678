"""Packing documents into sequences by vector best-fit.

Pieces have three demands: tokens, one document, and attention cost (the square
of their length). A sequence has a capacity for each. Pieces are taken longest
first; among the open sequences that a piece fits under every constraint, the
one whose weighted residual scores best is chosen: ``norm`` takes the least
norm of the residual after placing, ``dot`` the largest weighted dot product of
demand and residual.

The query and the stage set no limit of documents or cost of their own, as any
limit that binds makes more sequences: ``max_docs`` unset means ``capacity`` and
``max_cost`` unset ``capacity ** 2``, which what fits by tokens can't exceed.
Documents and cost act on the choice by their weights there; as parameters of
``pack`` they bind.

All demands follow from a piece's length, so equal lengths are interchangeable
and so are sequences with equal residuals. The choice is therefore made for
lengths and residuals instead of single pieces: it works on the counts by
length (at most ``capacity`` rows, whatever the corpus) and places runs of
pieces into runs of sequences. Each piece then finds its sequence by its rank
among the pieces of its length, which is computed without one task per length.

Only documents longer than the capacity are cut; the first piece takes the
remainder and the others are full.

Defined results: a null text counts as empty and is its end id alone; rows that
repeat are packed apart, and of equal pieces any takes a place; a null id passes
through; a text of any length is encoded whole; an empty table gives no rows;
``pieces`` reads the id and the text alone, and ``pack`` keeps a column named as
a result under a name with a leading underscore.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import LOWEST, aside, fresh, load, ranked, released, small_batches, stored
from gridloom.llm.tokens import KEPT, encoder, vocabulary

VOCABULARY = "byte_bpe_50k.json"
END = 2
CAPACITY = 1024
WEIGHTS = (1.0, 0.05, 0.05)
#: Chunks that the pipeline's stage remembers: fewer, as its workers hold what the stages before it left.
STAGE_KEPT = 250_000


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``n`` tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n else []


def best_fit(counts: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Runs of pieces in runs of sequences: ``(length, from rank, to rank, first sequence, a sequence's pieces, offset)``.

    Piece ``r`` of a run goes to sequence ``first + (r - from) // each`` at
    ``offset + (r - from) % each * length``.
    """
    limits = np.array([capacity, max_docs or capacity, int(max_cost or capacity**2)], np.int64)
    w = np.array(weights) / limits.astype(float) ** 2
    states = np.zeros((64, 3), np.int64)  # tokens, documents and cost used by runs of sequences that are alike
    runs: list[list[tuple[int, int]]] = []  # of each state: first sequence and number of sequences
    place: dict[tuple[int, int, int], int] = {}
    plan, made = [], 0

    def put(state: tuple[int, int, int], run: tuple[int, int]) -> None:
        nonlocal states
        at = place.setdefault(state, len(runs))
        if at == len(runs):
            runs.append([])
            if at == len(states):
                states = np.concatenate([states, np.zeros_like(states)])
            states[at] = state
        runs[at].append(run)

    for length in sorted((x for x in counts if x > 0), reverse=True):
        demand = np.array([length, 1, length * length], np.int64)
        whole = int((limits // demand).min())
        if not whole:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        rank, left = 0, counts[length]
        alive = np.array([i for i in range(len(runs)) if runs[i]], np.int64)
        if len(alive) < len(runs) // 2:  # forget what is empty
            old = [(tuple(int(x) for x in states[i]), runs[i]) for i in alive]
            place, runs = {}, []
            for state, its in old:
                for run in its:
                    put(state, run)
            alive = np.arange(len(runs))
        while left:
            alive = np.array([i for i in range(len(runs)) if runs[i]], np.int64)
            room = limits - states[alive]
            each_of = (room // demand).min(1) if len(alive) else alive
            alive, room, each_of = alive[each_of > 0], room[each_of > 0], each_of[each_of > 0]
            if rule == "norm":
                # a sequence that has taken a piece scores better still, so it is filled before the next one is tried
                score = ((room - demand) ** 2 * w).sum(1)
                tried = [(int(alive[i]), int(each_of[i])) for i in np.argsort(score, kind="stable")]
            else:
                # it scores worse, so all sequences that are alike take one piece each
                score = -(room * demand * w).sum(1)
                tried = [(int(alive[i]), 1) for i in np.argsort(score, kind="stable")[:1]]
            for at, each in tried or [(-1, whole)]:
                if not left:
                    break
                if at < 0:
                    n = -(-left // each)
                    used, mine, made = (0, 0, 0), [(made, n)], made + n
                else:
                    used, mine, runs[at] = tuple(int(x) for x in states[at]), runs[at], []
                for first, n in mine:
                    full = min(n, left // each)
                    some = left - full * each if full < n else 0
                    for start, many, k in ((first, full, each), (first + full, 1 if some else 0, some)):
                        if many:
                            plan.append((length, rank, rank + many * k, start, k, used[0]))
                            rank, left = rank + many * k, left - many * k
                            put((used[0] + k * length, used[1] + k, used[2] + k * length * length), (start, many))
                    rest = full + bool(some)
                    if rest < n:
                        put(used, (first + rest, n - rest))
    return plan


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_name: str = VOCABULARY, end: int = END, capacity: int = CAPACITY, kept: int = KEPT) -> DataFrame:
    """Every document's pieces ``doc_id, piece, start, length, ids_crc32``, stored in the shared folder."""
    small_batches(df.sparkSession)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = encoder(vocabulary(vocabulary_name), kept)
        for pdf in batches:
            out = []
            for k, no_id, ids in zip(pdf["k"].tolist(), pdf["no_id"].tolist(), ids_of(pdf["text"].tolist()), strict=True):
                raw = np.append(ids, np.uint32(end)).astype("<u4")
                out += [(None if no_id else k, i, at, n, zlib.crc32(raw[at : at + n].tobytes())) for i, (at, n) in enumerate(cuts(len(raw), capacity))]
            yield pd.DataFrame({"doc_id": pd.array([r[0] for r in out], dtype="Int64"), **{c: [r[i] for r in out] for i, c in enumerate(("piece", "start", "length", "ids_crc32"), 1)}})
        released()

    rows = df.select(F.coalesce(F.col(key), F.lit(LOWEST)).cast("long").alias("k"), F.col(key).isNull().alias("no_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return stored(rows.mapInPandas(encode, "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")


def pack(cut: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``length`` at most ``capacity``)."""
    cut, now_named = aside(cut, "sequence_id", "offset")
    given, size = cut.columns, now_named("length")
    counts = {r[0]: r[1] for r in cut.groupBy(size).count().collect()}  # at most `capacity` rows
    plan = sorted(best_fit(counts, capacity, max_docs, max_cost, weights, rule))
    length, lo, _, first, each, offset = (np.array(x, np.int64) for x in (zip(*plan, strict=True) if plan else [[]] * 6))
    # lengths and ranks in one ascending code: runs of a length lie side by side from rank 0
    begin = np.concatenate([[0], np.cumsum([counts.get(n, 0) for n in range(1, capacity + 1)])]).astype(np.int64)
    code = begin[length - 1] + lo if plan else lo

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, rank = n.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(code, begin[n - 1] + rank, side="right") - 1
        r = rank - lo[at]
        return pd.DataFrame({"sequence_id": first[at] + r // each[at], "offset": offset[at] + r % each[at] * n})

    # neither a cell's rows nor a length's cells grow faster than the square root of the length's count
    cells = F.array(*(F.lit(int(counts.get(n, 0) ** 0.5) + 1) for n in range(capacity + 1)))
    cell, rank, at = fresh(cut, "pack_cell", "pack_rank", "pack_at")
    ids = [c for c in ("doc_id", "piece", "ids_crc32") if c in given]
    spread = cut.withColumn(cell, F.pmod(F.xxhash64(*ids), cells[F.col(size)]))
    numbered = ranked(spread, [size], [cell], ids, rank)
    return numbered.withColumn(at, place(size, rank)).select(*given, f"{at}.sequence_id", f"{at}.offset")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces and their places."""
    return pack(pieces(load(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents goes."""
    return pack(pieces(docs, kept=STAGE_KEPT))
