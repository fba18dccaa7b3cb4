"""Typed reads, additive schema evolution and versioned writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def default_of(kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, (T.DoubleType, T.LongType, T.IntegerType)):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)


def conform(df: DataFrame, schema: T.StructType, defaults: bool = True) -> DataFrame:
    """Exactly the declared columns, in order; absent or null ones take the default."""
    cols = []
    for field in schema.fields:
        base = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        cols.append((F.coalesce(base, default_of(field.dataType)) if defaults else base).alias(field.name))
    return df.select(*cols)


def read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read files of mixed age: columns added later come back with their default."""
    reader = spark.read.format(fmt)
    if fmt == "parquet":
        # The declared schema is the merged one; parquet fills absent columns with null.
        return conform(reader.schema(schema).load(path), schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return conform(reader.load(path), schema)


def read_many(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """Several sources as one frame with a ``source`` column; columns are aligned by name."""
    result = None
    for name, path in paths.items():
        part = conform(spark.read.parquet(path), schema).withColumn("source", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result


def fresh(df: DataFrame, keys: list[str], stamp: str, asof: Column, hours: int = 12) -> DataFrame:
    """Latest row per key among those not older than ``hours`` at ``asof``."""
    from ..operators.ledger import latest

    in_time = (F.col(stamp) <= asof) & (F.col(stamp) >= asof - F.expr(f"INTERVAL {hours} HOURS"))
    return latest(df.filter(in_time), keys, [F.col(stamp).desc()])


def skip_recent_failures(keys: DataFrame, failures: DataFrame, on: list[str], asof: Column) -> DataFrame:
    """Keys without an unexpired failure."""
    return keys.join(failures.filter(F.col("expires_at") > asof).select(*on), on, "left_anti")


def write_version(df: DataFrame, base: str, partition_by: list[str] | None = None) -> str:
    """Write a new version directory and return it; the reader is pointed at it afterwards.

    Without a transactional table format a path that is being read is never
    overwritten: read, merge, write a new version, switch the pointer.
    """
    target = f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table in the cluster's shared folder."""
    from ..session import shared_dir

    path = write_version(df, f"{shared_dir(df.sparkSession)}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(path)
