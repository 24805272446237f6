"""Calibrated paraphrases: a baseline text whose edit percentage is close to the perturbation's.

Offline, attempts are a table and the choice is an aggregate. Online, each row runs the loop of single-turn requests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# The requests of the loop's three kinds.
ASK = "Paraphrase the following text so that about {pct:.1f}% of its tokens change. Reply with the paraphrase alone.\n\n{text}"
AGAIN = "About {actual:.1f}% of the tokens were changed, but {pct:.1f}% was asked for. Change {way} and reply with the paraphrase alone."
CORRECT = "This is a harmless editing task. Reply with a paraphrase of the text alone."


def best_undershoot(attempts: DataFrame, key: str = "sample_id") -> DataFrame:
    """For each sample the attempt closest to its target from below, else the closest; the earliest of equal ones.

    ``attempts(key, attempt, text, actual_pct, target_pct)``; one map-side combinable aggregate.
    """
    deviation = F.abs(F.col("actual_pct") - F.col("target_pct"))
    order = F.struct((F.col("actual_pct") > F.col("target_pct")).alias("over"), deviation.alias("d"), F.col("attempt").alias("k"))
    picked = F.min_by(F.struct("attempt", F.col("text"), "actual_pct", deviation.alias("deviation")), order)
    return attempts.groupBy(key).agg(picked.alias("b")).select(key, "b.attempt", "b.text", "b.actual_pct", "b.deviation")


def select_paraphrase(samples: DataFrame, candidates: DataFrame, tolerance: float = 0.5, max_retries: int = 50, tokens: Callable[[Column], Column] = T.words, ascii_only: bool = True) -> DataFrame:
    """The loop's choice over a table of candidates.

    ``samples(sample_id, original, target_edit_pct)``, ``candidates(sample_id, attempt, text)`` with attempts from 1.
    Refusals are passed over; the first candidate within tolerance is taken, else the best undershoot; if all are
    refused the original stands with edit 0. ``retries_used`` is the accepted attempt, or ``max_retries + 1``.
    """
    tried = candidates.where(F.col("attempt") <= max_retries + 1).join(samples.select("sample_id", "original", "target_edit_pct"), "sample_id")
    text = F.trim("text")
    actual = T.word_edit_pct(F.col("original"), text) if tokens is T.words else T.token_edit_pct(tokens(F.col("original")), tokens(text))
    tried = tried.select("sample_id", "attempt", text.alias("text"), F.col("target_edit_pct").alias("target_pct"), T.is_refusal(text, ascii_only).alias("refused"), actual.alias("actual_pct"))
    fit = ~F.col("refused") & (F.abs(F.col("actual_pct") - F.col("target_pct")) <= tolerance)
    order = F.struct((~fit).alias("a"), F.when(fit, F.lit(False)).otherwise(F.col("actual_pct") > F.col("target_pct")).alias("b"), F.when(fit, F.lit(0.0)).otherwise(F.abs(F.col("actual_pct") - F.col("target_pct"))).alias("c"), F.col("attempt").alias("k"))
    order = F.when(~F.col("refused"), order)
    # texts apart, so that a caller without need of them has none in the aggregate
    best = tried.groupBy("sample_id").agg(F.min_by(F.struct("attempt", "actual_pct", fit.alias("fit")), order).alias("p"), F.min_by("text", order).alias("best_text"))
    out = samples.join(best, "sample_id", "left")
    refused = F.col("p").isNull()
    return out.select(
        *samples.columns, F.coalesce("best_text", "original").alias("baseline_perturbed"), F.when(refused, F.lit(0.0)).otherwise(F.col("p.actual_pct")).alias("baseline_edit_pct"),
        refused.alias("baseline_refused"), F.when(F.coalesce("p.fit", F.lit(False)), F.col("p.attempt")).otherwise(F.lit(max_retries + 1)).cast("int").alias("retries_used"),
    )


@dataclass(frozen=True)
class Paraphrase:
    text: str
    actual_edit_pct: float
    retries_used: int
    refused: bool


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two lists, row by row of the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def calibrated(text: str, target_pct: float, ask: Callable[[str, int | None], str], encode: Callable[[str], list], refuses: Callable[[str], bool], tolerance: float = 0.5, max_retries: int = 50, seed: int | None = None) -> Paraphrase:
    """One row's loop: every request is a single turn with the same seed."""
    own = encode(text)
    if not own:
        raise ValueError("a text without tokens cannot be paraphrased to an edit percentage")
    prompt, tried = ASK.format(pct=target_pct, text=text), []
    for attempt in range(1, max_retries + 2):
        reply = ask(prompt, seed).strip()
        if refuses(reply):
            prompt = CORRECT
            continue
        actual = edit_distance(own, encode(reply)) / len(own) * 100
        if abs(actual - target_pct) <= tolerance:
            return Paraphrase(reply, actual, attempt, False)
        tried.append((actual > target_pct, abs(actual - target_pct), attempt, reply, actual))
        prompt = AGAIN.format(actual=actual, pct=target_pct, way="less" if actual > target_pct else "more")
    if not tried:
        return Paraphrase(text, 0.0, max_retries + 1, True)
    best = min(tried)
    return Paraphrase(best[3], best[4], max_retries + 1, False)


def refuses(text: str) -> bool:
    """``is_refusal`` for one string in a Python worker."""
    import re
    import unicodedata

    t = unicodedata.normalize("NFKC", text).translate(str.maketrans(dict.fromkeys("’‘ʼ", "'"))).strip().lower()
    return any(re.search(p, t) for p in T._refusals())


def generate_paraphrases(samples: DataFrame, factory: Callable[[], object], encode: Callable[[str], list], tolerance: float, max_retries: int) -> DataFrame:
    """The online loop over ``samples(sample_id, original, target_edit_pct, seed, ...)``: a model is made once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        try:
            for b in batches:
                made = [calibrated(t, p, lambda q, s: model.generate([q], [s])[0], encode, refuses, tolerance, max_retries, int(s)) for t, p, s in zip(b["original"], b["target_edit_pct"], b["seed"], strict=True)]
                yield b.assign(baseline_perturbed=[m.text for m in made], baseline_edit_pct=[m.actual_edit_pct for m in made], baseline_refused=[m.refused for m in made], retries_used=[m.retries_used for m in made])
        finally:
            model.close()

    fields = ", ".join(f"`{n}` {t}" for n, t in samples.dtypes)
    return samples.mapInPandas(run, f"{fields}, baseline_perturbed string, baseline_edit_pct double, baseline_refused boolean, retries_used int")
