"""The three conditions of a sample, wide and long, and cache look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ARMS = {"original": "orig", "target": "target", "baseline": "base"}


def fan_out(df: DataFrame, columns: dict[str, str], keep: tuple[str, ...] = ("sample_id",), value: str = "value") -> DataFrame:
    """Long form: a row per sample and arm. ``columns`` names each arm's column."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(c).alias(value)) for a, c in columns.items()))).alias("p")
    return df.select(*keep, pairs).select(*keep, "p.arm", f"p.{value}")


def fan_in(df: DataFrame, value: str = "value", key: str = "sample_id") -> DataFrame:
    """Wide form again, by one aggregate."""
    return df.groupBy(key).agg(*(F.max(F.when(F.col("arm") == a, F.col(value))).alias(f"{value}_{s}") for a, s in ARMS.items()))


def class_index(c: Column, classes: list[str]) -> Column:
    """0-based place of a class in the user's order; null for an unknown one."""
    at = F.array_position(F.array(*map(F.lit, classes)), c)
    return F.when(at > 0, at - 1).cast("int")


def lookup(work: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """``work`` with the cache's columns and ``hit``: a cached null is a hit."""
    return work.join(cache.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def missing_work(work: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return work.join(cache.select(key), key, "left_anti")


def present(work: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return work.join(cache.select(key), key, "left_semi")
