"""CSV source for exported benchmark runs (S13); the schema is required because
empty cells carry the NULLs that tell writes from reads. A cell that does not parse fails the
read: as a NULL it would pass for an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import BENCHMARK_RUN_SCHEMA


def read_runs_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCHMARK_RUN_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)


def write_runs_csv(runs: DataFrame, path: str) -> None:
    runs.write.mode("errorifexists").option("header", True).csv(path)
