"""Input tables, the keyed cache, and YAML files."""

from __future__ import annotations

from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..errors import ConfigError

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV (types inferred) or Parquet table, by the path's suffix in any case."""
    kind = FORMATS.get(PurePath(path).suffix.lower())
    if kind is None:
        raise ConfigError(f"unsupported data file {path!r}: use one of {sorted(FORMATS)}")
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if kind == "csv" else spark.read.parquet(path)


def as_frame(spark: SparkSession, data) -> DataFrame:
    """A Spark DataFrame as it is; a pandas one converted, its index becoming ``sample_key`` if it has a name or is not the default."""
    if isinstance(data, DataFrame):
        return data
    index = data.index
    if index.name is None and isinstance(index, pd.RangeIndex) and index.start == 0 and index.step == 1:
        return spark.createDataFrame(data)
    if "sample_key" in data.columns:
        raise ConfigError("the index would become the column 'sample_key', which the table has already")
    return spark.createDataFrame(data.reset_index(names="sample_key"))


def load_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        out = yaml.safe_load(f)
    if not isinstance(out, dict):
        raise ConfigError(f"{path}: the file must hold a mapping")
    return out


class KeyedCache:
    """Append-only Parquet table of (key, written, value...) partitioned by the key's first two characters.

    The latest entry of a key counts; a stored null is an entry. Spark's committer makes a write visible as a whole,
    and an unreadable file is passed over, so that its keys are misses.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        fields = f"key string, written timestamp, {self.schema}, shard string"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], fields).drop("written", "shard")
        rows = self.spark.read.option("ignoreCorruptFiles", True).schema(fields).parquet(self.path)
        names = [n for n in rows.columns if n not in ("key", "written", "shard")]
        latest = rows.groupBy("key").agg(F.max_by(F.struct(*names), "written").alias("v"))
        return latest.select("key", *(F.col(f"v.{n}").alias(n) for n in names))

    def append(self, entries: DataFrame) -> None:
        entries.select("key", F.current_timestamp().alias("written"), *[c for c in entries.columns if c != "key"], F.substring("key", 1, 2).alias("shard")).write.mode("append").partitionBy("shard").parquet(self.path)


def with_position(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``row_pos``, the 0-based place by ``order``: counts of range partitions are summed, no task sees all rows."""
    placed = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return placed.withColumn("_k", rank).join(F.broadcast(before), "_part").withColumn("row_pos", (F.col("_before") + F.col("_k")).cast("long")).drop("_part", "_k", "_n", "_before")
