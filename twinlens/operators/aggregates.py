"""Aggregates over label pairs, drops and edits. ``by`` groups all of them (one result row per group; none: one row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DROP_REASONS = ["zero_edit", "tokenization_failed", "extraction_returned_none", "extraction_raised", "openai_missing_class", "regression_nonfinite_logp"]


def flip_rate(df: DataFrame, original: str, other: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose labels differ; 0 without rows. Rows with a null label are left out."""
    pairs = df.where(F.col(original).isNotNull() & F.col(other).isNotNull())
    return pairs.groupBy(*by).agg(F.coalesce(F.avg((F.col(original) != F.col(other)).cast("double")), F.lit(0.0)).alias("flip_rate"), F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, original: str, other: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of label pairs with their marginals: a bounded table, the one pass that reads the rows."""
    pairs = df.select(*by, F.col(original).cast("string").alias("x"), F.col(other).cast("string").alias("y")).where("x is not null and y is not null")
    cells = pairs.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    over = lambda *k: F.sum("c").over(W.partitionBy(*by, *k))
    return cells.withColumns({"cx": over("x"), "cy": over("y"), "n": over()})


def mutual_information(df: DataFrame, original: str, other: str, by: Sequence[str] = ()) -> DataFrame:
    """Mutual information (nats) of the empirical joint of two label columns; 0 without rows."""
    cells = contingency(df, original, other, by)
    p, px, py = (F.col(c) / F.col("n") for c in ("c", "cx", "cy"))
    return cells.groupBy(*by).agg(F.coalesce(F.sum(p * (F.ln(p) - F.ln(px * py))), F.lit(0.0)).alias("mi"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def phi_coefficient(df: DataFrame, original: str, other: str, by: Sequence[str] = ()) -> DataFrame:
    """Phi of the 2 x 2 table, the larger label counting as high; ``status`` is ok, degenerate or not_binary, phi null but for ok."""
    cells = contingency(df, original, other, by)
    labels = cells.select(*by, F.explode(F.array("x", "y")).alias("v")).groupBy(*by).agg(F.max("v").alias("hi"), F.count_distinct("v").alias("k"))
    joined = cells.join(labels, list(by)) if by else cells.crossJoin(F.broadcast(labels))  # one row
    high = lambda c: F.col(c) == F.col("hi")
    cell = lambda a, b: F.sum(F.when((high("x") == F.lit(a)) & (high("y") == F.lit(b)), F.col("c")).otherwise(0)).cast("double")
    t = joined.groupBy(*by).agg(cell(True, True).alias("a"), cell(True, False).alias("b"), cell(False, True).alias("c_"), cell(False, False).alias("d"), F.max("k").alias("k"))
    norm = (F.col("a") + F.col("b")) * (F.col("c_") + F.col("d")) * (F.col("a") + F.col("c_")) * (F.col("b") + F.col("d"))
    status = F.when(F.col("k") > 2, "not_binary").when((F.coalesce("k", F.lit(0)) < 2) | (norm == 0), "degenerate").otherwise("ok")
    return t.select(*by, F.when(status == "ok", (F.col("a") * F.col("d") - F.col("b") * F.col("c_")) / F.sqrt(norm)).alias("phi"), status.alias("status"))


def drop_counts(df: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """One row with a count for each drop reason."""
    return df.agg(*(F.count_if(F.col(reason) == r).alias(r) for r in DROP_REASONS))


def drop_counts_table(df: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """reason, count and rate of all input rows."""
    counts = df.agg(F.count(F.lit(1)).alias("n_input"), *(F.count_if(F.col(reason) == r).alias(r) for r in DROP_REASONS))
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("reason"), F.col(r).alias("count")) for r in DROP_REASONS))).alias("p")
    out = counts.select("n_input", pairs).select("p.reason", "p.count", "n_input")
    return out.select("reason", "count", F.coalesce(F.try_divide(F.col("count"), F.col("n_input")), F.lit(0.0)).alias("rate"))


def edit_stats(df: DataFrame, tolerance: float = 0.5, max_retries: int = 50) -> DataFrame:
    """Means and sample deviations of the edit percentages, the share within tolerance, refusals and exhausted retries."""
    t, b = F.col("target_edit_pct"), F.col("baseline_edit_pct")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(
        F.count(F.lit(1)).alias("n"), zero(F.avg(t)).alias("target_mean"), zero(F.stddev_samp(t)).alias("target_sd"), zero(F.avg(b)).alias("baseline_mean"), zero(F.stddev_samp(b)).alias("baseline_sd"),
        zero(F.avg((F.abs(b - t) <= tolerance).cast("double"))).alias("within_tolerance"), F.count_if(F.col("retries_used") > max_retries).alias("retries_hit"), F.count_if("baseline_refused").alias("refused"),
    )


def value_counts(df: DataFrame, c: Column | str) -> DataFrame:
    return df.groupBy(F.col(c).alias("value") if isinstance(c, str) else c.alias("value")).agg(F.count(F.lit(1)).alias("count"))
