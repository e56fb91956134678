"""A corpus pipeline: quality, near duplicates, source mix, packing.

Each stage gets the rows that its predecessor kept, written as Parquet in the
shared folder and read again. All but the last return the columns of
``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import mixing, ngram_join, packing, quality
from gridloom.llm.common import load, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("source_mixing", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL can't express the classifier, the verified join or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    rows = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
