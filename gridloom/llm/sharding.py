"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual_nodes`` points of a 64-bit ring; a document's key is
hashed onto the ring and belongs to the next point clockwise. Shards have a
bounded load. Documents are taken in ring order within an arc (the stretch that
ends at a point); what a full shard can't take continues clockwise to the next
point whose shard has room. Arcs hold whole documents only by number, so the
overflow is settled on the arcs' counts (``shards * virtual_nodes`` rows, a
parameter and not the data) and each document finds its place by its rank in
its arc.

``slack`` 0 gives every shard ``floor(n / shards)`` documents or one more, so
counts are at most one apart; a larger slack moves fewer documents when shards
are added, with no shard above ``ceil((1 + slack) * n / shards)``.

Defined results: a null key is hashed by its text's checksum; null and empty
texts have checksum 0 and size 16; rows with equal key and text are
interchangeable; an empty table gives no rows; a text of any length counts
whole; other columns pass through, one named as a result under a name with a
leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import aside, fresh, load

SHARDS = 40
VIRTUAL_NODES = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser, so that points are spread and the same everywhere."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """The ring's points in clockwise order (as signed longs), and the shard of each."""
    owner = np.repeat(np.arange(shards), virtual_nodes)
    copy = np.tile(np.arange(virtual_nodes), shards)
    points = _mix(_mix(owner * 1_000_003 + seed) + _mix(copy + 0x5EED)).view(np.int64)
    order = np.lexsort((owner, points))
    return points[order], owner[order]


def capacities(n: int, shards: int, slack: float) -> list[int]:
    """Most documents for each shard."""
    if slack <= 0:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [int(np.ceil((1 + slack) * n / shards))] * shards


def settle(counts: dict[int, int], owner: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the arcs' documents go: ``(arc, from rank, to rank, shard, first slot)``.

    Each shard first takes the documents of its own arcs, as far as it has room;
    the rest walks clockwise from its arc to the next points with room.
    """
    room, slots = list(room), [0] * len(room)
    placed, waiting = [], []

    def take(arc: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard])
        if n:
            placed.append((arc, lo, lo + n, shard, slots[shard]))
            room[shard] -= n
            slots[shard] += n
        return lo + n

    for arc in sorted(counts):
        lo = take(arc, 0, counts[arc], int(owner[arc]))
        if lo < counts[arc]:
            waiting.append((arc, lo, counts[arc]))
    step = np.arange(len(owner))
    for arc, lo, hi in waiting:
        for at in np.roll(step, -arc - 1):
            if lo == hi:
                break
            lo = take(arc, lo, hi, int(owner[at]))
    return placed


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0, seed: int = 17) -> DataFrame:
    """Add ``size, text_crc32, shard, slot`` (and ``home``, the shard before overflow) to the documents."""
    points, owner = ring(shards, virtual_nodes, seed)
    df, now_named = aside(df, "size", "text_crc32", "shard", "slot", "home")
    key, text = now_named(key), now_named(text)
    pos, arc, rank, lo, hi, base = fresh(df, "ring_pos", "ring_arc", "ring_rank", "ring_lo", "ring_hi", "ring_base")

    @F.pandas_udf(T.IntegerType())
    def arc_of(at: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in at:
            yield pd.Series(np.searchsorted(points, x.to_numpy(np.int64), side="left") % len(points), dtype="int32")

    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    sized = df.withColumns({
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16,
        "text_crc32": crc,
        pos: F.when(F.col(key).isNull(), F.xxhash64(F.lit(seed), crc)).otherwise(F.xxhash64(F.lit(seed), F.col(key))),
    })
    sized = sized.withColumn(arc, arc_of(F.col(pos)))
    # at most shards * virtual_nodes rows
    counts = {r[0]: r[1] for r in sized.groupBy(arc).count().collect()}
    plan = settle(counts, owner, capacities(sum(counts.values()), shards, slack))
    spark = df.sparkSession
    pieces = spark.createDataFrame(plan or [], f"{arc} int, {lo} long, {hi} long, shard int, {base} long")
    ids = [c for c in (key, "text_crc32", "size") if c != pos]
    w = Window.partitionBy(arc).orderBy(pos, *ids)
    out = sized.withColumn(rank, F.row_number().over(w).cast("long") - 1)
    out = out.join(F.broadcast(pieces), [out[arc] == pieces[arc], out[rank] >= pieces[lo], out[rank] < pieces[hi]]).drop(pieces[arc])
    homes = F.array(*(F.lit(int(x)) for x in owner))
    return out.withColumns({"slot": F.col(base) + F.col(rank) - F.col(lo), "home": homes[F.col(arc)]}).drop(pos, arc, rank, lo, hi, base)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 39, counts at most one apart (law ``rows``)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")
