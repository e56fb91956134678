"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's target is its share of the mix by weight, never above ``max_copies``
times its own size; what a source can't take is shared again by weight among
the others until none is above (solved at once: sources fill in the order of
``limit / weight``, and prefix sums give the level at which the rest share).

Within a source every document expects ``target / size of source`` copies. The
expectations are prefix-summed in an order by size class, one random offset is
added, and a document is emitted once for each whole number its stretch
crosses. As neighbours in that order are alike in size, the words taken stay
close to the target; no document is taken more than ``max_copies`` times.

A source may hold any share of the rows: documents are numbered in cells of
source, size class and hash, and only the cells' counts meet per source.

Defined results: a null source is a source of its own, last in order; null and
empty texts have size 0 and are taken as any other (they add no words); a
source with no words has target 0 and nothing is taken; rows that repeat are
numbered apart, and of equal sizes in a cell the id decides; an empty table
gives no rows; a text of any length is counted whole; an input column named as
a result is kept under a name with a leading underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import aside, fresh, load, ranked, shielded, stored, unshielded

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MAX_COPIES = 2
CELLS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(*parts: Column) -> Column:
    """A number below 2**32 that follows from the parts as text, in SQL as here."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) with each source's ``target``."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    t = sizes.withColumn("weight", cycle[F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))])
    t = t.withColumn("limit", F.col("source_size") * F.lit(float(max_copies)))
    w = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({
        "full": F.coalesce(F.sum("limit").over(upto), F.lit(0.0)),
        "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
        "want": F.lit(float(total)) * F.sum("source_size").over(everything),
    })
    # this source's part if all that fill before it are full
    t = t.withColumn("part", (F.col("want") - F.col("full")) * F.col("weight") / F.col("left"))
    fits = F.when(F.col("part") <= F.col("limit"), F.col("part") / F.col("weight"))
    level = F.first(fits, ignorenulls=True).over(everything)
    return t.select("source", "source_size", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit"))).alias("target"))


def mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, max_copies: int = MAX_COPIES, seed: int = 42, cells: int = CELLS, counted: str | None = None) -> DataFrame:
    """Add ``size, source_size, target, copies, taken`` to every row; ``copies`` is 0 where a document is left out.

    ``counted``: a column that has the texts' sizes already; ``text`` isn't read then.
    """
    df, now_named = aside(df, "size", "source_size", "target", "copies", "taken")
    source, key = now_named(source), now_named(key)
    name, band, spread, rank = fresh(df, "mix_source", "mix_band", "mix_spread", "mix_rank")
    sized = df.withColumns({"size": F.col(now_named(counted)) if counted else words(now_named(text)), name: F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))})
    bits = F.bin(F.col("size") + 1)
    sized = sized.withColumns({
        band: F.length(bits) * 2 + F.when(F.substring(bits, 2, 1) == "1", 1).otherwise(0),
        spread: digest(F.lit(seed), F.col(key), F.col("size")) % cells,
    })
    per = sized.groupBy(name, band, spread).agg(F.sum("size").alias("size")).groupBy(name).agg(F.sum("size").alias("source_size"))
    shares = targets(per.select(F.when(F.col(name) != "", F.substring(name, 2, 2**30)).alias("source"), "source_size"), weights, total, max_copies)
    shares = shares.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias(name), "source_size", "target")
    placed = ranked(sized, [name], [band, spread], ["size", key], rank, shares)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = digest(F.lit(seed), F.col(name)) / F.lit(float(2**32))
    upto = lambda r: F.floor(r * each + offset)
    copies = F.least(F.lit(max_copies).cast("long"), upto(F.col(rank) + 1) - upto(F.col(rank)))
    return placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop(name, band, spread, rank)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document. The texts are read once, to count their words."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", words("text").alias("n_words"))
    return mix(stored(docs, "words"), counted="n_words").select("doc_id", "size", "source_size", "target", "taken", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents, one row for each copy."""
    rows, at = shielded(docs)
    mixed = mix(rows, at["source"], at["text"], at["doc_id"]).where("copies > 0")
    return unshielded(mixed.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), at)


_digest = "CAST('0x' || substr(md5(concat_ws('|', {}, {})), 1, 8) AS BIGINT)"
OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS name, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, name, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight, source_size * {MAX_COPIES}::DOUBLE AS most FROM s),
u AS (
  SELECT *, {TOTAL}::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS want, coalesce(sum(most) OVER o, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (want - filled) * weight / rest AS part FROM u),
t AS (SELECT name, source_size, least(most, coalesce((SELECT part / weight FROM p WHERE part <= most ORDER BY most / weight, source NULLS LAST LIMIT 1) * weight, most)) AS target FROM p),
c AS (SELECT *, length(bin(size + 1)) * 2 + CASE WHEN substr(bin(size + 1), 2, 1) = '1' THEN 1 ELSE 0 END AS band, {_digest.format(42, "doc_id, size")} % {CELLS} AS spread FROM d),
r AS (SELECT c.*, t.source_size, t.target, row_number() OVER (PARTITION BY c.name ORDER BY band, spread, size, doc_id NULLS FIRST) - 1 AS nth FROM c JOIN t USING (name)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each, {_digest.format(42, "name")} / {2**32}::DOUBLE AS start FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (SELECT *, CAST(least({MAX_COPIES}, floor((nth + 1) * each + start) - floor(nth * each + start)) AS BIGINT) AS copies FROM e)
"""
