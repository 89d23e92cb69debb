"""Catalog operations (S2, S11): create-if-absent from a schema, exists, drop,
refresh, list by name with sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _ident(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def create_table_if_absent(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None,
                           partition_by: tuple[str, ...] = ()) -> None:
    """``CREATE TABLE IF NOT EXISTS`` from a StructType (keys are not enforced)."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    sql = f"CREATE TABLE IF NOT EXISTS {_ident(name)} ({cols}) USING parquet"
    if partition_by:
        sql += " PARTITIONED BY (" + ", ".join(f"`{c}`" for c in partition_by) + ")"
    if path:
        sql += f" LOCATION '{path}'"
    spark.sql(sql)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_ident(name)}")


def refresh_table(spark: SparkSession, name: str) -> None:
    """Make files written by other jobs visible to this session."""
    spark.catalog.refreshTable(name)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The catalog's tables sorted by name (metadata only, no data scan)."""
    rows = [(t.name, t.database, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    schema = "name string, database string, table_type string, is_temporary boolean"
    return spark.createDataFrame(rows, schema).orderBy("name")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Primary-key check for tables created by ``create_table_if_absent`` (Spark does
    not enforce keys): keys that occur more than once, with their count."""
    from pyspark.sql import functions as F

    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def storage_size(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """S11 sizes: file count and bytes under a table folder. The listing runs as a scan
    of the binaryFile source selecting only path and length, so no file is read."""
    from pyspark.sql import functions as F

    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(path).select("path", "length"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
