"""Paired percentile bootstrap of label metrics.

Every metric is a function of the counts of (original, target, baseline) label triples, so a sample is one small cell
code in row order. Resamples are dealt over the cluster; each starts from a snapshot of the one seeded index stream, so
results do not depend on how they are dealt, and one pass serves all metrics. This engine, "exact", broadcasts the
codes, so it refuses more than ``MAX_BROADCAST_ROWS`` rows. The engine "multinomial" draws the cells' counts from the
bounded contingency table, at any size, by another stream of the same distribution; it is used only where it is asked
for, and every result names its engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..errors import ConfigError, DegenerateMetricError, TwinlensError
from .tests import TestResult

MAX_BROADCAST_ROWS, UNSTABLE_SHARE = 5_000_000, 0.05
ENGINES = ("exact", "multinomial")


def flip_metric(table: np.ndarray) -> float:
    n = table.sum()
    return float((n - np.trace(table)) / n) if n else 0.0


def mi_metric(table: np.ndarray) -> float:
    n = table.sum()
    if not n:
        return 0.0
    px, py = table.sum(1) / n, table.sum(0) / n
    out = 0.0
    for i, j in zip(*np.nonzero(table), strict=True):
        p = table[i, j] / n
        out += p * (math.log(p) - math.log(px[i] * py[j]))
    return float(out)


def phi_metric(table: np.ndarray) -> float:
    used = np.flatnonzero(table.sum(0) + table.sum(1))
    if len(used) > 2:
        raise TwinlensError("phi needs two labels")
    if len(used) < 2:
        raise DegenerateMetricError("phi needs two labels to occur")
    lo, hi = used
    n = table.sum()
    p11, p10, p01, p00 = (table[a, b] / n for a, b in ((hi, hi), (hi, lo), (lo, hi), (lo, lo)))
    norm = (p11 + p10) * (p01 + p00) * (p11 + p01) * (p10 + p00)
    if norm == 0:
        raise DegenerateMetricError("a label has no rows in one column")
    return float((p11 * p00 - p10 * p01) / math.sqrt(norm))


#: Metrics of a table of label counts (original by other, labels in lexicographic order); callers may add theirs.
METRICS: dict[str, Callable[[np.ndarray], float]] = {"flip_rate": flip_metric, "mi": mi_metric, "phi": phi_metric}


def _tables(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    cube = counts.reshape(k, k, k)
    return cube.sum(2), cube.sum(1)  # original by target, original by baseline


def _difference(metric: Callable, counts: np.ndarray, k: int) -> float:
    target, baseline = _tables(counts, k)
    return metric(target) - metric(baseline)


def resamples(df: DataFrame, metrics: list[str], order: str, columns: tuple[str, str, str], n_bootstrap: int, seed: int, engine: str = "exact", chunk: int = 50) -> tuple[DataFrame, list[str], np.ndarray]:
    """(resample, metric, diff) with a null diff where the metric is degenerate; the labels; the observed cell counts."""
    if engine not in ENGINES:
        raise ConfigError(f"unknown bootstrap engine {engine!r}: use one of {ENGINES}")
    spark = df.sparkSession
    rows = df.select(F.col(order).alias("_pos"), *(F.col(c).cast("string").alias(f"_l{i}") for i, c in enumerate(columns)))
    cells = rows.groupBy("_l0", "_l1", "_l2").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the labels
    labels = sorted({r[f"_l{i}"] for r in cells for i in range(3)})
    k, place = len(labels), {a: i for i, a in enumerate(labels)}
    counts = np.zeros(k**3, np.int64)
    for r in cells:
        counts[(place[r["_l0"]] * k + place[r["_l1"]]) * k + place[r["_l2"]]] += r["n"]
    n = int(counts.sum())
    functions = {m: METRICS[m] for m in metrics}
    starts: list[tuple] = []
    if engine == "exact":
        if n > MAX_BROADCAST_ROWS:
            raise ConfigError(f"the exact engine broadcasts at most {MAX_BROADCAST_ROWS} rows; use 'multinomial'")
        code = sum((F.element_at(F.create_map(*(F.lit(x) for kv in place.items() for x in kv)), F.col(f"_l{i}")) * k ** (2 - i) for i in range(3)), F.lit(0))
        codes = rows.select("_pos", code.cast("int").alias("c")).orderBy("_pos").toArrow()["c"].to_numpy()
        state = np.random.RandomState(seed)
        for first in range(0, n_bootstrap, chunk):
            starts.append(state.get_state())
            for _ in range(min(chunk, n_bootstrap - first)):
                state.randint(0, n, size=n)
        shared = spark.sparkContext.broadcast((codes, starts))
    else:
        shared = spark.sparkContext.broadcast((None, None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, begin = shared.value
        for b in batches:
            for c in b["id"]:
                state, out = np.random.RandomState(), []
                if own is None:
                    draw = np.random.default_rng([seed, int(c)])
                else:
                    state.set_state(begin[c])
                for i in range(c * chunk, min((c + 1) * chunk, n_bootstrap)):
                    new = draw.multinomial(n, counts / n) if own is None else np.bincount(own[state.randint(0, n, size=n)], minlength=k**3)
                    for m, f in functions.items():
                        try:
                            out.append((i, m, _difference(f, new, k)))
                        except (DegenerateMetricError, ZeroDivisionError):
                            out.append((i, m, None))
                yield pd.DataFrame(out, columns=["resample", "metric", "diff"])

    chunks = -(-n_bootstrap // chunk)
    ids = spark.range(0, chunks, 1, min(chunks, spark.sparkContext.defaultParallelism * 2))
    return ids.mapInPandas(run, "resample int, metric string, diff double"), labels, counts


def bootstrap_diff(df: DataFrame, metrics: list[str], order: str = "row_pos", columns: tuple[str, str, str] = ("label_orig", "label_target", "label_base"), n_bootstrap: int = 1000, seed: int = 42, engine: str = "exact") -> list[TestResult]:
    """Tests of metric(original, target) - metric(original, baseline), one for each of ``metrics``."""
    diffs, labels, counts = resamples(df, list(dict.fromkeys(metrics)), order, columns, n_bootstrap, seed, engine)
    n, k, out = int(counts.sum()), len(labels), {}
    stats = {r["metric"]: r for r in summary(diffs).collect()}
    for m in dict.fromkeys(metrics):
        try:
            seen = _difference(METRICS[m], counts, k)
        except DegenerateMetricError as e:
            out[m] = TestResult(m, "paired_bootstrap", None, 1.0, "two_sided", n, 1.0, extra={"engine": engine, "degenerate": True, "reason": f"observed_metric_undefined: {e}"})
            continue
        r = stats[m]
        extra = {"engine": engine, "n_dropped_resamples": r["dropped"], "bootstrap_unstable": r["dropped"] > UNSTABLE_SHARE * n_bootstrap}
        if not r["kept"]:
            out[m] = TestResult(m, "paired_bootstrap", seen, 1.0, "two_sided", n, 1.0, seen, seen, "percentile", extra | {"degenerate": True, "reason": "all_resamples_dropped"})
        elif r["flat"]:
            out[m] = TestResult(m, "paired_bootstrap", seen, 1.0, "two_sided", n, 1.0, r["lo"], r["hi"], "percentile", extra | {"degenerate": True, "reason": "zero_variance"})
        else:
            p = min(1.0, 2 * min(r["below"], r["above"]))
            out[m] = TestResult(m, "paired_bootstrap", seen, p, "two_sided", n, p, r["lo"], r["hi"], "percentile", extra)
    return [out[m] for m in metrics]


def summary(diffs: DataFrame) -> DataFrame:
    """For each metric: kept and dropped resamples, the 2.5 and 97.5 percentiles, the shares on either side of 0 (0 on both), whether all are close."""
    first = F.min_by("diff", F.when(F.col("diff").isNotNull(), F.col("resample")))
    per = diffs.groupBy("metric").agg(
        F.count("diff").alias("kept"), F.count_if(F.col("diff").isNull()).alias("dropped"), F.percentile("diff", [0.025, 0.975]).alias("q"),
        F.avg((F.col("diff") <= 0).cast("double")).alias("below"), F.avg((F.col("diff") >= 0).cast("double")).alias("above"), first.alias("first"), F.max("diff").alias("max"), F.min("diff").alias("min"),
    )
    near = F.lit(1e-8) + 1e-5 * F.abs("first")
    flat = (F.abs(F.col("max") - F.col("first")) <= near) & (F.abs(F.col("min") - F.col("first")) <= near)
    return per.select("metric", "kept", "dropped", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"), "below", "above", flat.alias("flat"))
