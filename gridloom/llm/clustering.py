"""Centroid clustering of vectors with Hamerly's bounds, exact in whole numbers.

Vectors become integers (``floor(scale * x)``), so distances, sums and new
centroids are exact and every run agrees. Each vector keeps its cluster, one
upper bound of the distance to its centroid and one lower bound of the distance
to the second nearest. When centroids drift, the bounds are loosened by the
drift; only a vector whose upper bound reaches both the lower bound and half
the way to the next centroid is ambiguous: its own distance is measured, and if
that doesn't settle it, all centroids are scanned in whole numbers. Bounds are
square roots rounded outwards, so a tie always ends in the scan, which gives it
to the smaller number.

A round is one pass without a shuffle: a task reads its vectors with their
bounds from the shared folder, assigns them, and writes them with the new
bounds; behind them it writes, for each centroid, what moved in less what moved
out. Only these few rows (tasks times centroids) are added up, and only
``k`` centroids reach the driver. The round's table replaces the one before.

Defined results: a vector with another number of components, a null or
non-finite component, or one beyond ``LIMIT`` in size (whose squares would
leave 64 bits) is left out, as is a null vector; a null id is kept and
clustered but never starts a centroid; repeated rows count each, and of equal
ids the lesser vector starts a centroid first; fewer vectors than ``k`` start
as many centroids as there are; an empty table gives no rows. Only the id and
the vector are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import discard, load, stored

K = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SEED = 3
LIMIT = float(2**17)
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, sum_of int, n long, sums array<bigint>"
FINAL = "vec_id long, cluster int, distance long, sum_of int, n long, sums array<bigint>"


def kept(df: DataFrame, key: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the vectors that count, as whole numbers."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.size("v") == dims)
    rows = rows.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= LIMIT), F.lit(False))))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def starts(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The first centroids: the ``k`` vectors whose ids have the least hashes."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one point, or of rows to rows, in whole numbers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _above(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64)) * (1 + 2.0**-48)


def _below(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64)) * (1 - 2.0**-48)


class Bounds:
    """One round's centroids, with what Hamerly's tests need of them."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        k = len(now)
        self.now = now
        between = np.array([squared(now, c) for c in now]) if k else np.zeros((0, 0), np.int64)
        near = _below(between)
        np.fill_diagonal(near, np.inf)
        self.half = near.min(1, initial=np.inf) / 2
        self.drift = _above(squared(now, before)) if before is not None else np.zeros(k)
        # the furthest drift of another centroid
        self.others = np.array([np.delete(self.drift, j).max(initial=0.0) for j in range(k)])

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (ties: the smaller number) and bounds, by all distances."""
        d = np.stack([squared(x, c) for c in self.now], 1)
        at = d.argmin(1)
        first = d[np.arange(len(x)), at]
        d[np.arange(len(x)), at] = np.iinfo(np.int64).max
        second = _below(d.min(1)) if len(self.now) > 1 else np.full(len(x), np.inf)
        return at, _above(first), second

    def assign(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Move the rows' clusters and bounds on, in place; returns how many rows were scanned."""
        new = at < 0
        old = ~new
        upper[old] = (upper[old] + self.drift[at[old]]) * (1 + 2.0**-48)
        lower[old] = (lower[old] - self.others[at[old]]) - np.abs(lower[old]) * 2.0**-48
        safe = np.full(len(x), -np.inf)
        safe[old] = np.maximum(self.half[at[old]], lower[old])
        unsure = np.flatnonzero(old & (upper >= safe))
        upper[unsure] = _above(squared(x[unsure], self.now[at[unsure]]))
        todo = np.concatenate([unsure[upper[unsure] >= safe[unsure]], np.flatnonzero(new)])
        at[todo], upper[todo], lower[todo] = self.scan(x[todo])
        return len(todo)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def passed(state: DataFrame, bounds: Bounds, first: bool, final: bool, dims: int = DIMS) -> DataFrame:
    """One pass over the vectors: ``STATE`` rows, or ``FINAL`` rows if it is the last."""
    k = len(bounds.now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, counts, inertia = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), [0] * k
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("v"), dims)
            at = np.full(n, -1, np.int64) if first else batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            upper = np.zeros(n) if first else batch.column("upper").to_numpy(zero_copy_only=False).copy()
            lower = np.zeros(n) if first else batch.column("lower").to_numpy(zero_copy_only=False).copy()
            was = at.copy()
            bounds.assign(x, at, upper, lower)
            none = pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))
            if final:
                far = squared(x, bounds.now[at])
                for j in np.unique(at).tolist():
                    inertia[j] += sum(far[at == j].tolist())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(far), *none], names=["vec_id", "cluster", "distance", "sum_of", "n", "sums"])
                continue
            change = np.flatnonzero(was != at)
            np.add.at(moved, at[change], x[change])
            np.add.at(counts, at[change], 1)
            change = change[was[change] >= 0]
            np.subtract.at(moved, was[change], x[change])
            np.subtract.at(counts, was[change], 1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(at.astype(np.int32)), pa.array(upper), pa.array(lower), *none], names=["vec_id", "v", "cluster", "upper", "lower", "sum_of", "n", "sums"])
        of = pa.array(range(k), pa.int32())
        gone = lambda kind: pa.nulls(k, kind)
        if final:
            yield pa.RecordBatch.from_arrays([gone(pa.int64()), gone(pa.int32()), gone(pa.int64()), of, pa.array(counts), pa.array([[i] for i in inertia], pa.list_(pa.int64()))], names=["vec_id", "cluster", "distance", "sum_of", "n", "sums"])
        else:
            yield pa.RecordBatch.from_arrays([gone(pa.int64()), gone(pa.list_(pa.int32())), gone(pa.int32()), gone(pa.float64()), gone(pa.float64()), of, pa.array(counts), pa.array(moved.tolist(), pa.list_(pa.int64()))], names=["vec_id", "v", "cluster", "upper", "lower", "sum_of", "n", "sums"])

    return state.mapInArrow(run, FINAL if final else STATE)


def added(state: DataFrame, k: int) -> tuple[list[int], list[list[int]]]:
    """What the tasks wrote of each centroid, added up: counts and sums of ``k`` rows."""
    rows = state.where("sum_of is not null").select("sum_of", "n", F.posexplode("sums").alias("dim", "x"))
    rows = rows.groupBy("sum_of", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    counts, sums = [0] * k, [[] for _ in range(k)]
    for r in sorted(rows, key=lambda r: (r.sum_of, r.dim)):
        counts[r.sum_of] = int(r.n)
        sums[r.sum_of].append(int(r.x))
    return counts, sums


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector, and the final centroids."""
    spark = df.sparkSession
    vectors = kept(df, key, vector, dims, scale)
    now, before = starts(vectors, k, seed), None
    if not len(now):
        # nothing to start from: no kept vector has an id
        out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], out), now
    k, state, whole = len(now), None, [[0] * dims for _ in now]
    counts = [0] * k
    for _ in range(rounds):
        last = state
        rows = vectors if last is None else last.where("sum_of is null").select("vec_id", "v", "cluster", "upper", "lower")
        state = stored(passed(rows, Bounds(now, before), last is None, False, dims), "vectors")
        if last is not None:
            discard(last)
        more, sums = added(state, k)
        counts = [a + b for a, b in zip(counts, more, strict=True)]
        whole = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(whole, sums, strict=True)]
        before = now
        now = np.array([[x // n for x in s] if n else b.tolist() for s, n, b in zip(whole, counts, before, strict=True)], np.int64)
    rows = vectors if state is None else state.where("sum_of is null").select("vec_id", "v", "cluster", "upper", "lower")
    done = stored(passed(rows, Bounds(now, before), state is None, True, dims), "clusters")
    if state is not None:
        discard(state)
    _, inertia = added(done, k)
    own = [int(s[0]) for s in inertia]
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    of = spark.createDataFrame([(j, own[j], sum(own), names[j]) for j in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = done.where("sum_of is null").join(F.broadcast(of), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), now


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all ``embeddings``."""
    return cluster(load(spark, sf_dir, "embeddings"))[0]


def _sql() -> str:
    """The rounds spelled out: components as rows, a table of assignments and one of centroids for each round."""
    parts = [
        f"""k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) <= {LIMIT})) = {DIMS})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM k WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {K}))""",
        "p AS (SELECT row_number() OVER () AS r, vec_id, v FROM k)",
        f"x AS MATERIALIZED (SELECT r, vec_id, d.i AS i, v[d.i] AS a FROM p, (SELECT unnest(range(1, {DIMS + 1})) AS i) AS d)",
        f"m0 AS MATERIALIZED (SELECT c, d.i AS i, v[d.i] AS a FROM c0, (SELECT unnest(range(1, {DIMS + 1})) AS i) AS d)",
    ]
    for j in range(ROUNDS + 1):
        parts.append(f"""a{j} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, min(d * {K} + c) AS best FROM
  (SELECT x.r, any_value(x.vec_id) AS vec_id, m.c, sum((x.a - m.a) * (x.a - m.a)) AS d FROM x JOIN m{j} AS m USING (i) GROUP BY x.r, m.c) GROUP BY r)""")
        if j < ROUNDS:
            parts.append(f"""m{j + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN s.n > 0 THEN (s.t - (((s.t % s.n) + s.n) % s.n)) // s.n ELSE m.a END AS a FROM m{j} AS m LEFT JOIN
  (SELECT a.best % {K} AS c, x.i, sum(x.a) AS t, count(*) AS n FROM x JOIN a{j} AS a USING (r) GROUP BY a.best % {K}, x.i) AS s ON s.c = m.c AND s.i = m.i)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(best % {K} AS INTEGER) AS cluster, CAST(best // {K} AS BIGINT) AS distance,
  CAST(sum(best // {K}) OVER (PARTITION BY best % {K}) AS BIGINT) AS cluster_inertia, CAST(sum(best // {K}) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{ROUNDS} JOIN (SELECT c, sha256(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m{ROUNDS} GROUP BY c) AS h ON h.c = best % {K}"""


OP11_SQL = _sql()
