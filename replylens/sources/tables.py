"""Readers and writers: parquet, CSV and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

_DRIVER_TABLES = {
    "conversations": schemas.TURNS,
    "events": schemas.EVENTS,
    "documents": schemas.DOCUMENTS,
    "labels": schemas.LABELS,
}
_CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}
SMALL_SPLIT = 8 << 20


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    df = spark.read.parquet(path)
    return schemas.require_columns(df, *schema.fieldNames()) if schema else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, with its columns checked."""
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", _DRIVER_TABLES.get(name))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a scanned table that is too small to come in as many splits (a
    single row group, say). Larger tables are returned as they are, unshuffled. Only the
    size that the planner knows from the files is looked at; nothing runs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_SPLIT else df


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """CSV with a declared schema (no inference pass); an empty field is null. Cleaned
    texts hold no line breaks, so files are split among tasks. ``multi_line`` allows
    quoted line breaks, at the price of one task per file."""
    options = _CSV_OPTIONS | {"multiLine": str(multi_line).lower()}
    return spark.read.schema(schema).options(**options).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_pools(pairs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """All pools as one table, one folder per pool, so that a pool is read alone."""
    writer = pairs.write.mode("overwrite").partitionBy("pool")
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    writer.format(fmt).save(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """Nested report rows (structs, maps, arrays) as JSON lines; nulls are kept."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def as_bool(column: str):
    """Flags read back from CSV text as booleans."""
    return F.col(column).cast("boolean")
