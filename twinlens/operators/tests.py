"""Statistical tests: aggregates in Spark, the last scalar steps on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import ConfigError, DegenerateMetricError
from . import special


@dataclass(frozen=True)
class TestResult:
    """One metric's test."""

    __test__ = False
    metric: str
    test: str
    statistic: float | None
    p_value: float
    p_value_kind: str
    n: int
    p_value_two_sided: float | None = None
    ci_low: float | None = None
    ci_high: float | None = None
    ci_kind: str | None = None
    extra: dict = field(default_factory=dict)


def paired_moments(df: DataFrame, target: Column, baseline: Column) -> DataFrame:
    """n, mean, sample deviation, t and degrees of freedom of the differences; t is null where they do not vary."""
    d = df.select((target - baseline).alias("d")).where(F.col("d").isNotNull())
    m = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.max("d").alias("hi"), F.min("d").alias("lo"))
    flat = (F.col("hi") == F.col("lo")) | F.coalesce(F.col("sd") == 0, F.lit(True))
    return m.select("n", "mean", F.when(flat, F.lit(0.0)).otherwise(F.col("sd")).alias("sd"), F.when(~flat, F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"))


def paired_t_from(metric: str, n: int, mean: float | None, sd: float, t: float | None) -> TestResult:
    if n < 2 or t is None:
        return TestResult(metric, "paired_t", 0.0, 1.0, "two_sided", n, 1.0, 0.0, 0.0, None, {"degenerate": True, "reason": "zero_variance"})
    p = min(1.0, 2 * special.t_sf(abs(t), n - 1))
    half = special.t_ppf(0.975, n - 1) * sd / math.sqrt(n)
    return TestResult(metric, "paired_t", t, p, "two_sided", n, p, mean - half, mean + half, "t", {"mean_difference": mean, "df": n - 1})


def paired_t(df: DataFrame, target: Column, baseline: Column, metric: str) -> TestResult:
    r = paired_moments(df, target, baseline).first()
    return paired_t_from(metric, r["n"], r["mean"], r["sd"], r["t"])


@dataclass(frozen=True)
class Fit:
    """A fitted directional regression."""

    model: str
    beta: float
    se: float
    statistic: float
    df: float
    ci_low: float
    ci_high: float
    p_two_sided: float
    r_squared: float
    n_obs: int


def difference_moments(df: DataFrame, direction: Column, delta: Column) -> DataFrame:
    """beta, se, t and r_squared of delta = beta * direction without an intercept, from one pass of moments."""
    x, y = direction.cast("double"), delta.cast("double")
    s = df.agg(F.count(F.lit(1)).alias("n"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"), F.sum(y).alias("y"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    s = s.withColumn("beta", F.col("xy") / F.col("xx")).withColumn("rss", F.greatest(F.col("yy") - F.col("beta") * F.col("xy"), F.lit(0.0)))
    # with a constant direction the regressor is an intercept, and the centred sum of squares is meant
    tss = F.when(F.col("lo") == F.col("hi"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")).otherwise(F.col("yy"))
    se = F.sqrt(F.col("rss") / (F.col("n") - 1) / F.col("xx"))
    return s.select("n", "beta", se.alias("se"), F.try_divide(F.col("beta"), se).alias("t"), (1 - F.try_divide(F.col("rss"), tss)).alias("r_squared"))


def fit_difference(df: DataFrame, direction: Column, delta: Column) -> Fit:
    r = difference_moments(df, direction, delta).first()
    if r["n"] < 2 or not r["se"]:
        raise DegenerateMetricError("the difference regression needs two rows and some residual")
    d = r["n"] - 1
    half = special.t_ppf(0.975, d) * r["se"]
    return Fit("difference", r["beta"], r["se"], r["t"], d, r["beta"] - half, r["beta"] + half, min(1.0, 2 * special.t_sf(abs(r["t"]), d)), r["r_squared"], r["n"])


def _design(direction: Column, z: Column) -> tuple[list[Column], list[Column]]:
    """Regressors of a sample's two rows: the baseline's, whose direction is 0, and the target's."""
    z = z.cast("double")
    return [F.lit(1.0), z, F.lit(0.0)], [F.lit(1.0), z, direction.cast("double")]


def level_fit(df: DataFrame, direction: Column, z: Column, y_target: Column, y_baseline: Column) -> dict[str, float]:
    """y = b0 + b1 z + beta direction over two rows per sample, errors clustered by sample.

    A sample's rows stay in one wide row, so both passes are plain aggregates without a shuffle by cluster.
    """
    xb, xt = _design(direction, z)
    df = df.select(*(c.alias(f"b{i}") for i, c in enumerate(xb)), *(c.alias(f"t{i}") for i, c in enumerate(xt)), y_baseline.cast("double").alias("yb"), y_target.cast("double").alias("yt"))
    cell = lambda i, j: F.sum(F.col(f"b{i}") * F.col(f"b{j}") + F.col(f"t{i}") * F.col(f"t{j}")).alias(f"x{i}{j}")
    side = lambda i: F.sum(F.col(f"b{i}") * F.col("yb") + F.col(f"t{i}") * F.col("yt")).alias(f"y{i}")
    s = df.agg(F.count(F.lit(1)).alias("g"), F.sum(F.col("yb") + F.col("yt")).alias("y"), F.sum(F.col("yb") ** 2 + F.col("yt") ** 2).alias("yy"), *(cell(i, j) for i in range(3) for j in range(i, 3)), *(side(i) for i in range(3))).first()
    g = s["g"]
    if g < 2:
        raise DegenerateMetricError("the level regression needs two samples")
    xx = np.array([[s[f"x{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
    if np.linalg.matrix_rank(xx) < 3:
        raise DegenerateMetricError("a regressor of the level regression is constant or a combination of the others")
    b = np.linalg.solve(xx, np.array([s[f"y{i}"] for i in range(3)]))
    fitted = lambda k: sum(float(b[i]) * F.col(f"{k}{i}") for i in range(3))
    df = df.withColumns({"ub": F.col("yb") - fitted("b"), "ut": F.col("yt") - fitted("t")})
    score = [F.col("ub") * F.col(f"b{i}") + F.col("ut") * F.col(f"t{i}") for i in range(3)]
    r = df.agg(F.sum(F.col("ub") ** 2 + F.col("ut") ** 2).alias("rss"), *(F.sum(score[i] * score[j]).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3))).first()
    meat = np.array([[r[f"m{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
    n, inverse = 2 * g, np.linalg.inv(xx)
    v = inverse @ meat @ inverse * (g / (g - 1)) * ((n - 1) / (n - 3))
    tss = s["yy"] - s["y"] ** 2 / n
    out = {f"b{i}": float(b[i]) for i in range(3)} | {f"se{i}": float(math.sqrt(v[i, i])) for i in range(3)}
    return out | {"n_obs": n, "g": g, "rss": r["rss"], "r_squared": 1 - r["rss"] / tss if tss else 0.0}


def fit_level(df: DataFrame, direction: Column, z: Column, y_target: Column, y_baseline: Column) -> Fit:
    """Normal quantiles for the interval and the two-sided p; the degrees of freedom, 2n - 3, serve the one-sided test."""
    r = level_fit(df, direction, z, y_target, y_baseline)
    if not r["se2"]:
        raise DegenerateMetricError("the level regression leaves no residual")
    stat, half = r["b2"] / r["se2"], special.normal_ppf(0.975) * r["se2"]
    return Fit("level", r["b2"], r["se2"], stat, r["n_obs"] - 3, r["b2"] - half, r["b2"] + half, special.normal_two_sided(stat), r["r_squared"], r["n_obs"])


def regression_test(fit: Fit, alternative: str, n_distinct: int) -> TestResult:
    """One-sided test of the direction's coefficient by the t distribution."""
    if alternative not in ("greater", "less"):
        raise ConfigError("alternative must be 'greater' or 'less'")
    p = special.t_sf(fit.statistic, fit.df) if alternative == "greater" else special.t_cdf(fit.statistic, fit.df)
    extra = {"model": fit.model, "beta": fit.beta, "se": fit.se, "df": fit.df, "r_squared": fit.r_squared, "alternative": alternative}
    return TestResult("regression", f"ols_{fit.model}", fit.statistic, p, f"one_sided_{alternative}", n_distinct, fit.p_two_sided, fit.ci_low, fit.ci_high, "t" if fit.model == "difference" else "normal", extra)
