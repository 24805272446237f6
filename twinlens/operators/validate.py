"""Checks before a study: each an aggregate with a bounded sample of offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import ConfigError
from .bootstrap import METRICS

RESERVED = ["sample_id", "original", "target_perturbed", "baseline_perturbed", "target_edit_pct", "baseline_edit_pct", "baseline_refused", "retries_used"] + [f"{k}_{a}" for k in ("probs", "label", "generation") for a in ("orig", "target", "base")]
SHOWN = 10


def check_mode(classes: list[str] | None, extract_label) -> str:
    if (classes is None) == (extract_label is None):
        raise ConfigError("exactly one of classes and extract_label is needed")
    return "classification" if classes is not None else "free_form"


def check_columns(df: DataFrame, perturb: str) -> None:
    if perturb not in df.columns:
        raise ConfigError(f"column {perturb!r} is not among {df.columns}")
    taken = sorted(set(df.columns) & set(RESERVED))
    if taken:
        raise ConfigError(f"columns {taken} are reserved")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once."""
    return df.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def check_unique(df: DataFrame, key: str) -> None:
    some = [r["id"] for r in duplicate_ids(df, key).limit(SHOWN).collect()]
    if some:
        raise ConfigError(f"ids must be unique; repeated: {some}")


def direction_kind(c: Column) -> Column:
    """What is wrong with a direction: zero, nan (or not a number), inf; null if nothing."""
    x = F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").when(x == 0, "zero")


def check_direction(df: DataFrame, column: str, key: str) -> None:
    bad = df.select(F.col(key).alias("id"), direction_kind(F.col(column)).alias("kind")).where("kind is not null")
    per = bad.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set(F.col("id").cast("string"))), 1, SHOWN).alias("some")) if bad.limit(1).count() else None
    if per is not None:
        raise ConfigError(f"direction {column!r}: " + "; ".join(f"{r['n']} {r['kind']} in rows {r['some']}" for r in per.collect()))


def outcome_offenders(df: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """Counts of outcomes that are no class; null is one of them."""
    return df.where(~F.coalesce(F.col(column).isin(classes), F.lit(False))).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def check_outcome(df: DataFrame, column: str, classes: list[str]) -> None:
    some = outcome_offenders(df, column, classes).orderBy(F.desc("count"), "value").limit(SHOWN).collect()
    if some:
        raise ConfigError(f"outcome {column!r} has values that are no class: " + ", ".join(f"{r['value']!r} x {r['count']}" for r in some))


def check_directional(df: DataFrame, direction: str | None, outcome: str | None, alternative: str | None, classes: list[str] | None, key: str) -> bool:
    given = [x is not None for x in (direction, outcome, alternative)]
    if not any(given):
        return False
    if not all(given):
        raise ConfigError("direction_column, outcome_class_column and alternative come together or not at all")
    if classes is None:
        raise ConfigError("directional options need classes")
    absent = [c for c in (direction, outcome) if c not in df.columns]
    if absent:
        raise ConfigError(f"columns {absent} are not among {df.columns}")
    if alternative not in ("greater", "less"):
        raise ConfigError("alternative must be 'greater' or 'less'")
    check_direction(df, direction, key)
    check_outcome(df, outcome, classes)
    return True


def token_collisions(first: dict[str, int | None]) -> list[list[str]]:
    """Groups of classes whose first tokens are equal; a class without tokens is a group with itself."""
    groups: dict[int | None, list[str]] = {}
    for c, t in first.items():
        groups.setdefault(t, []).append(c)
    return [g for t, g in groups.items() if len(g) > 1 or t is None]


SCORE_METRICS = ("jsd", "kl")


def check_metrics(metrics: list[str], mode: str, directional: bool) -> None:
    labels = tuple(METRICS)  # with those that callers have added
    for m in metrics:
        if mode == "free_form" and m in (*SCORE_METRICS, "regression"):
            raise ConfigError(f"metric {m!r} needs classification; free-form studies have {labels}")
        if m == "regression" and not directional:
            raise ConfigError("metric 'regression' needs the directional options")
        if m not in (*labels, *SCORE_METRICS, "regression"):
            raise ConfigError(f"unknown metric {m!r}")
