"""Sinks (S6): JSON export of audit results.

The reference prints one JSON document ``{libraries, package_info}`` for a
whole project.  At corpus scale a single document would pass everything
through one task, so the export is JSON Lines, one record per
(library, file) with the library's version and license, written in parallel
by Spark (overwrite mode, like the reference's file writer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read an export back with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).json(path)
