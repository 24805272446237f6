"""What a study asks of models and tokenizers. Backends are made on the workers by picklable factories."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import Column


@runtime_checkable
class Tokenizer(Protocol):
    @property
    def cache_id(self) -> str: ...

    def encode(self, text: str) -> list: ...

    def as_column(self, text: Column) -> Column:
        """The tokens of a text column as an array."""
        ...


class ModelBackend:
    """A language model. Subclasses give texts, class probabilities (rows of NaN where there are none), or both."""

    @property
    def cache_id(self) -> str:
        """Everything that affects outputs."""
        raise NotImplementedError

    def validate_classes(self, classes: list[str]) -> None:
        """Raise ClassificationModeError if the classes cannot be scored."""

    def generate(self, prompts: list[str], seeds: list[int]) -> list[str]:
        raise NotImplementedError

    def score_classes(self, prompts: list[str], classes: list[str], seeds: list[int]) -> np.ndarray:
        raise NotImplementedError

    def close(self) -> None:
        """Release what the backend holds; may be called again."""

    def __enter__(self) -> ModelBackend:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
