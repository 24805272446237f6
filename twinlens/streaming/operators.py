"""Row-local operators on streams: perturbation, edit percentage and refusal flags need no state, so a streaming
DataFrame takes them unchanged; drops are counted in event-time windows behind a watermark (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


def annotate(stream: DataFrame, text: str, perturb: Callable[[Column], Column]) -> DataFrame:
    changed = perturb(F.col(text))
    out = stream.withColumn("target_perturbed", changed)
    reason = F.when(F.col(text).isNull() | (F.size(T.words(F.col(text))) <= 0), "tokenization_failed").when(F.col("target_perturbed").eqNullSafe(F.col(text)), "zero_edit")
    return out.withColumns({"drop_reason": reason, "target_edit_pct": T.token_edit_pct(T.words(F.col(text)), T.words(F.col("target_perturbed"))), "refusal": T.is_refusal(F.col(text), ascii_only=True)})


def drops_by_window(stream: DataFrame, ts: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), "drop_reason").agg(F.count(F.lit(1)).alias("n"))
