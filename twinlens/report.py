"""Reports: result rows, metadata, and their files."""

from __future__ import annotations

import json
import logging
import math
import os
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .operators.tests import TestResult

log = logging.getLogger("twinlens")
SUMMARY = "metric string, test string, statistic double, p_value double, p_value_kind string, p_value_two_sided double, ci_low double, ci_high double, ci_kind string, n long, n_dropped long, degenerate boolean, n_dropped_resamples long, bootstrap_unstable boolean"


def json_safe(x):
    """A value for strict JSON: non-finite numbers are null, numpy values unwrapped, others text."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [json_safe(v) for v in x]
    if isinstance(x, np.ndarray):
        return json_safe(x.tolist())
    if isinstance(x, np.generic):
        return json_safe(x.item())
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x if x is None or isinstance(x, (bool, int, str)) else str(x)


@dataclass
class Report:
    results: list[TestResult]
    metadata: dict = field(default_factory=dict)

    def rows(self) -> list[dict]:
        n_input = self.metadata.get("n_input") or 0
        return [
            {k: getattr(r, k) for k in ("metric", "test", "statistic", "p_value", "p_value_kind", "p_value_two_sided", "ci_low", "ci_high", "ci_kind", "n")}
            | {"n_dropped": n_input - r.n if n_input else 0, "degenerate": bool(r.extra.get("degenerate", False)), "n_dropped_resamples": int(r.extra.get("n_dropped_resamples", 0)), "bootstrap_unstable": bool(r.extra.get("bootstrap_unstable", False))}
            for r in self.results
        ]

    def summary_table(self, spark: SparkSession) -> DataFrame:
        names = [f.split()[0] for f in SUMMARY.split(", ")]
        return spark.createDataFrame([tuple(r[c] for c in names) for r in self.rows()], SUMMARY)

    def metadata_rows(self) -> list[tuple[str, str]]:
        return [(k, json.dumps(json_safe(v))) for k, v in self.metadata.items()]

    def drop_rows(self) -> list[tuple[str, int, float]]:
        n = self.metadata.get("n_input") or 0
        return [(k, c, c / n if n else 0.0) for k, c in self.metadata.get("drop_counts", {}).items()]

    def to_json(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"results": [json_safe(asdict(r)) for r in self.results], "metadata": json_safe(self.metadata)}, f, indent=2, allow_nan=False)

    def sheets(self) -> dict[str, pd.DataFrame]:
        out = {
            "Results": pd.DataFrame(self.rows()),
            "Metadata": pd.DataFrame(self.metadata_rows(), columns=["key", "value"]),
            "Drop Counts": pd.DataFrame(self.drop_rows(), columns=["reason", "count", "rate"]),
        }
        if self.metadata.get("refused_samples"):
            out["Refused Samples"] = pd.DataFrame({"sample_id": self.metadata["refused_samples"]})
        return out

    def to_excel(self, path: str) -> str:
        """Write a workbook; without an engine for it, a folder of CSV files of that name. Returns what was written."""
        try:
            import openpyxl  # noqa: F401
        except ModuleNotFoundError:
            folder = os.path.splitext(path)[0]
            os.makedirs(folder, exist_ok=True)
            for name, d in self.sheets().items():
                d.to_csv(os.path.join(folder, f"{name}.csv"), index=False)
            log.warning("no engine for workbooks is installed; wrote CSV files to %s", folder)
            return folder
        with pd.ExcelWriter(path, engine="openpyxl") as w:
            for name, d in self.sheets().items():
                d.to_excel(w, sheet_name=name, index=False)
        return path

    def merge(self, other: Report) -> Report:
        """Both reports' results; this one's metadata stands, and both are listed as leaves under ``merged_from``."""
        leaves = []
        for r in (self, other):
            leaves += r.metadata.get("merged_from") or [{k: v for k, v in r.metadata.items() if k != "merged_from"}]
        differ = sorted(k for k in self.metadata.keys() & other.metadata.keys() - {"merged_from"} if self.metadata[k] != other.metadata[k])
        if differ:
            log.warning("merged reports differ in %s", differ)
        return Report([*self.results, *other.results], {**self.metadata, "merged_from": leaves})

    def __repr__(self) -> str:
        return pd.DataFrame(self.rows()).to_string(index=False) if self.results else "Report without results"
