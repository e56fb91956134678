"""Helpers that several operators share: shared storage, id ranges, distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOWEST = -(2**63)
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20
RANGE_BYTES = 256 << 20
#: Ranges at most, whatever the input: the driver and the plan hold one cut for each.
MOST_RANGES = 20_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a temporary folder; a
    cluster gets an error, as a machine-local folder would lose data there.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str, compression: str = "zstd", dictionary: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back; this cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes (one very long text is a batch of its own) and rows, unless the user chose sizes of their own.

    Plans run after this call returns, so the settings stay with the session.
    """
    for key, own in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(own))


def released() -> None:
    """Give Arrow's unused memory back at the end of a task: the worker stays for later stages."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` doesn't have yet, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame, *made: str) -> tuple[DataFrame, Callable[[str], str]]:
    """``df`` with its columns whose names (in any case of letters) an operator's results take renamed by leading underscores.

    No column is lost. The function gives an input column's present name.
    """
    low = {m.lower() for m in made}
    clash = [c for c in df.columns if c.lower() in low]
    taken = df.select(*df.columns, *(F.lit(None).alias(m) for m in made if m.lower() not in {c.lower() for c in df.columns}))
    names = {c.lower(): n for c, n in zip(clash, fresh(taken, *clash), strict=True)}
    return df.toDF(*(names.get(c.lower(), c) for c in df.columns)), lambda c: names.get(c.lower(), c)


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under neutral column names, and the neutral name of each column: no extra column can clash."""
    names = {c: f"in_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def unshielded(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(v).alias(c) for c, v in names.items()))


def with_ranges(df: DataFrame, key: str, out: str, text: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """Add ``out``, the number of the range of the long column ``key`` that a row falls in; also returns how many numbers there are.

    There is a range for each ``RANGE_BYTES`` of ``text``, but no fewer than the
    session's shuffle partitions and no more than ``MOST_RANGES``: beyond that
    the ranges grow (sorting spills), so neither the cuts on the driver nor the
    summary they are taken from grow with the input. The cuts are approximate quantiles; ranges are
    ordered as their keys are, and ``repartitionById`` gives each a partition of
    its own.
    """
    spark = df.sparkSession
    if parts is None:
        size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
        parts = min(MOST_RANGES, max(partitions(spark), -(-size // RANGE_BYTES)))
    cuts = sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (10 * parts)))) if parts > 1 else []
    if not cuts:
        return df.withColumn(out, F.lit(0)), 1
    (num,) = fresh(df, "range_key")
    placed = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=num, outputCol=out).transform(df.withColumn(num, F.col(key).cast("double")))
    return placed.drop(num).withColumn(out, F.col(out).cast("int")), len(cuts) + 1


def ranked(df: DataFrame, group: list[str], cells: list[str], order: list[str | Column], out: str, totals: DataFrame | None = None) -> DataFrame:
    """Add ``out``, each row's 0-based rank in its ``group``, without one task per group.

    Rows are ordered by the ``cells`` columns, then by ``order``. Rows are
    numbered within a cell, and only the cells' counts (partly aggregated before
    their shuffle) meet per group. ``group`` and ``cells`` must not be null.
    ``totals``: columns by group to carry onto the rows, joined to the cells.
    """
    before, count = fresh(df, "rank_before", "rank_count")
    sizes = df.groupBy(*group, *cells).agg(F.count(F.lit(1)).alias(count))
    w = Window.partitionBy(*group).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*group, *cells, F.coalesce(F.sum(count).over(w), F.lit(0)).alias(before))
    if totals is not None:
        bases = bases.join(totals, group)
    own = Window.partitionBy(*group, *cells).orderBy(*order)
    numbered = df.withColumn(out, F.row_number().over(own) - 1)
    return numbered.join(bases, [*group, *cells]).withColumn(out, F.col(out) + F.col(before)).drop(before)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Remove a table that ``stored`` wrote and nothing reads any more."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all that ``stored`` has written to the shared folder; call it when no result is read any more."""
    _remove(spark, f"{shared_folder(spark)}/gridloom")


def least_of(edges: DataFrame) -> DataFrame:
    """``u, m``: the least ``v`` of each ``u``.

    It is dealt by other columns than ``u``, so that a join with it deals both
    sides anew and a node with very many edges can be split by the engine.
    """
    return edges.groupBy("u").agg(F.min("v").alias("m")).repartition("m", "u")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (u, v long): ``node, root`` for each node, root its least node.

    Alternates large-star and small-star rounds; each round's edges are written
    to the shared folder and the round's before are removed, so lineage and disk
    stay small and nothing meets on the driver but a count and a checksum.
    """
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_of(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(least_of(large), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        small = small.select("u", "v").unionByName(small.select(F.col("w").alias("u"), "v")).distinct()
        last, e = e, stored(small, label)
        discard(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def runs(batches, key: list[str]):
    """Whole groups from pandas batches sorted by ``key``: a group may span batches."""
    import pandas as pd

    held: list = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        marks = list(zip(*(pdf[c].tolist() for c in key), strict=True))
        start = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(pdf.iloc[start:i])
                if held:
                    yield last, pd.concat(held) if len(held) > 1 else held[0]
                held, start, last = [], i, mark
        held.append(pdf.iloc[start:])
    if held:
        yield last, pd.concat(held) if len(held) > 1 else held[0]
