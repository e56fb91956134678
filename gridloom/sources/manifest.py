"""Digests of written files, taken where the files are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``file, n_bytes, sha256`` of every file below ``folder`` whose name fits ``pattern``; ``file`` is relative to the folder.

    A file is one row, hashed by the task that reads it; no content reaches the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    file = F.substring_index("path", f"{base}/", -1)
    return files.select(file.alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
