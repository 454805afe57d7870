"""Table sources (SRC-1..4) and schema evolution (SCH-1, SCH-2)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadflow.sources.schemas import SOURCES, TABLES


def read_table(spark: SparkSession, root: str, name: str,
               schema: T.StructType | str | None = None) -> DataFrame:
    """SRC-1: read a named parquet table with a declared schema.

    Supplying the schema skips footer inference; column pruning and filter
    pushdown still reach the parquet scan. ``spark.read.jdbc`` would give the
    same DataFrame for a live database. Names without a declared schema are
    read with the schema that the files give.
    """
    reader = spark.read
    if schema is None:
        schema = TABLES.get(name) or SOURCES.get(name)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{root.rstrip('/')}/{name}.parquet")


def optional_table(spark: SparkSession, df: DataFrame | None, schema: T.StructType) -> DataFrame:
    """SRC-2: an absent table reads as empty with its declared schema, so
    aggregates over it produce zero counts through the same plan."""
    if df is not None:
        return df
    return spark.createDataFrame([], schema)


def seed_if_empty(target: DataFrame, seed: DataFrame) -> DataFrame:
    """SRC-3: append ``seed`` rows only when ``target`` has no row at all.

    The emptiness test is a scalar subquery over ``target.limit(1)``: it
    reads at most one row and is evaluated once, with no join.
    """
    empty = target.limit(1).select(F.count(F.lit(1))).scalar() == 0
    return target.unionByName(seed.filter(empty))


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """SCH-2: a default applies only to a column the input omits; an explicit
    NULL in a supplied column stays NULL."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def add_column_if_missing(df: DataFrame, name: str, dtype: T.DataType) -> DataFrame:
    """SCH-1 (first half): add a nullable column when an older snapshot lacks it."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(None).cast(dtype))


def read_if_written(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where nothing was ever written;
    any other failure to read it is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
