"""Inputs that an earlier stage may or may not have left: a stage without one goes on with an empty frame of the declared columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Columns of each stage's output that later stages read; ``{id}`` is the type of the zones' ids.
SCHEMAS = {
    "forecast": "zone_id {id}, mae double, new_ratio double, decision string",
    "anomaly": "zone_id {id}, n bigint, mean_score double, critical bigint, congestion_share double, outage_share double",
    "scoring": "zone_id {id}, priority double, tier string, intervention string",
}


def empty(spark: SparkSession, stage: str, id_type: DataType) -> DataFrame:
    """No rows, with the declared columns."""
    return spark.createDataFrame([], SCHEMAS[stage].format(id=id_type.simpleString()))


def _read(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def resolve(spark: SparkSession, stage: str, given: DataFrame | str | None, id_type: DataType) -> DataFrame:
    """A stage's output from a frame, from a CSV or Parquet path, or from nothing.

    A path that isn't there, or holds no rows or files, gives the empty frame;
    columns are taken by name and cast to the declared types, a declared column
    that the input lacks is null.
    """
    none = empty(spark, stage, id_type)
    if isinstance(given, str):
        try:
            given = _read(spark, given)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            given = None
    if given is None:
        return none
    have = {c.lower(): c for c in given.columns}
    return given.select(*((F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in none.schema))
