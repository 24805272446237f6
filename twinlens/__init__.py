"""Counterfactual-evaluation studies of language models as Spark DataFrames."""

import logging

from .errors import ClassificationModeError, ConfigError, DegenerateMetricError, StageNotRunError, TwinlensError
from .models import FunctionTokenizer, LexicalTokenizer, ModelBackend, TiktokenTokenizer, Tokenizer
from .operators.tests import TestResult
from .report import Report
from .study import Study, native

__version__ = "0.1"
__all__ = [
    "ClassificationModeError", "ConfigError", "DegenerateMetricError", "FunctionTokenizer", "LexicalTokenizer", "ModelBackend", "Report", "StageNotRunError",
    "Study", "TestResult", "TiktokenTokenizer", "Tokenizer", "TwinlensError", "native", "set_log_level",
]


def set_log_level(level: str | int) -> None:
    logging.getLogger("twinlens").setLevel(level)
