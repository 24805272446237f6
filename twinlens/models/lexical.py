"""Tokenizers, and deterministic models for tests, examples and differential queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from ..functions.text import words
from .base import ModelBackend


class LexicalTokenizer:
    """Whitespace tokens, in the JVM."""

    cache_id = "lexical:whitespace"

    def encode(self, text: str) -> list[str]:
        return text.split()

    def as_column(self, text: Column) -> Column:
        return words(text)


class FunctionTokenizer:
    """Any ``encode``; as a column it is an Arrow-batched function that gives null where encoding fails."""

    def __init__(self, encode: Callable[[str], list[int]], cache_id: str):
        self.encode, self.cache_id = encode, cache_id

    def as_column(self, text: Column) -> Column:
        encode = self.encode

        @F.pandas_udf("array<int>")
        def run(s: pd.Series) -> pd.Series:
            def one(t: str | None) -> list[int] | None:
                try:
                    return [int(x) for x in encode(t)]
                except Exception:  # counted by the study as a failed tokenization
                    return None

            return s.map(one)

        return run(text)


class TiktokenTokenizer(FunctionTokenizer):
    """A tiktoken encoding by model or encoding name; an unknown model has o200k_base. Needs its vocabulary at hand."""

    def __init__(self, name: str):
        import tiktoken

        try:
            encoding = tiktoken.encoding_for_model(name)
        except KeyError:
            encoding = tiktoken.get_encoding(name if name in tiktoken.list_encoding_names() else "o200k_base")
        super().__init__(encoding.encode_ordinary, f"tiktoken:{encoding.name}")


class ScriptedModel(ModelBackend):
    """Answers from a table of prompts, or by a function of the prompt: for tests and examples."""

    def __init__(self, texts: Callable[[str, int | None], str] | dict | None = None, scores: Callable[[str], list[float]] | dict | None = None, name: str = "scripted"):
        self.texts, self.scores, self.name = texts, scores, name

    @property
    def cache_id(self) -> str:
        return f"scripted:{self.name}"

    def generate(self, prompts, seeds):
        if isinstance(self.texts, dict):
            return [self.texts.get(p, "") for p in prompts]
        return [self.texts(p, s) if self.texts else "" for p, s in zip(prompts, seeds, strict=True)]

    def score_classes(self, prompts, classes, seeds):
        k = len(classes)
        one = lambda p: [1 / k] * k if self.scores is None else self.scores.get(p, [1 / k] * k) if isinstance(self.scores, dict) else self.scores(p)
        return np.array([one(p) for p in prompts], float)


class HashModel(ModelBackend):
    """Class probabilities from a hash of prompt and class: deterministic, without any model."""

    cache_id = "hash:1"

    def generate(self, prompts, seeds):
        return ["ABCD"[hashlib.md5(p.encode()).digest()[0] % 4] for p in prompts]

    def score_classes(self, prompts, classes, seeds):
        raw = np.array([[hashlib.md5(f"{c}|{p}".encode()).digest()[0] / 64 for c in classes] for p in prompts])
        e = np.exp(raw - raw.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
