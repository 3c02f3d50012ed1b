"""Scans of remote tables, documents and optional files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel.sources import files


def jdbc_scan(spark: SparkSession, url: str, query: str, *, user: str | None = None, properties: dict[str, str] | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A remote query as a DataFrame; ``partition`` (column, low, high, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").options(url=url, **({"user": user} if user else {}), **(properties or {}))
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, parts = partition
    return reader.options(dbtable=f"({query}) t", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def parameter_scan(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, **values: object) -> DataFrame:
    """A query with named parameters (``:name``), bound by Spark rather than spliced into the text; ``{name}`` is a table of ``tables``."""
    return spark.sql(sql, args=values, **(tables or {}))


def key_scan(df: DataFrame, keys: DataFrame, key: str, *, day: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows whose key is in ``keys`` (a semi-join in place of a long IN list), between two days."""
    out = df if day is None else df.filter(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return out.join(keys.select(key).distinct(), key, "left_semi")


def renamed_scan(df: DataFrame, predicate: Column, names: dict[str, str]) -> DataFrame:
    """The columns of ``names`` under their new names, of the rows that meet ``predicate``; both reach the scan."""
    return df.filter(predicate).select(*[F.col(old).alias(new) for old, new in names.items()])


def profiled_rows(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows in ``order`` for a profile that is meant to be bounded; the same on every run."""
    return df.orderBy(*order).limit(limit)


def optional_table(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, bool]:
    """The table at ``path`` and True, or an empty one of ``schema`` and False."""
    if files.exists(spark, path):
        return spark.read.schema(schema).parquet(path), True
    return spark.createDataFrame([], schema), False


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document of many lines as one row."""
    return spark.read.option("multiLine", True).json(path)


def literal_grid(spark: SparkSession, keys: Iterable[object], days: Sequence[str], key: str = "permno", day: str = "d") -> DataFrame:
    """One row per key and day of two literal lists."""
    rows = [(k, list(days)) for k in keys]
    return spark.createDataFrame(rows, f"{key} long, _days array<string>").select(key, F.explode(F.col("_days").cast("array<date>")).alias(day))
