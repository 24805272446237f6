"""Operators on per-row probability vectors (``array<double>`` columns), all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Probabilities are kept from 0 by this before a logarithm.
EPSILON = 1e-12


def _clip(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(EPSILON))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence in nats: clipped inside the logarithms only; terms of p <= 0 are 0."""
    term = lambda x, y: F.when(x > 0, x * (F.ln(_clip(x)) - F.ln(_clip(y)))).otherwise(F.lit(0.0))
    return total(F.zip_with(p, q, term))


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in nats (at most ln 2)."""
    middle = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (kl(p, middle) + kl(q, middle)) / 2


def softmax(scores: Column) -> Column:
    """Softmax over an array, the greatest score being subtracted first."""
    return F.transform(scores, lambda x: F.exp(x - F.array_max(scores)) / total(F.transform(scores, lambda y: F.exp(y - F.array_max(scores)))))


def gather(a: Column, places: list[int]) -> Column:
    """Elements at 0-based ``places``: class scores out of a vocabulary's logits."""
    return F.array(*(F.get(a, F.lit(i)) for i in places))


def argmax_label(p: Column, classes: list[str]) -> Column:
    """The class of the greatest probability, the first of equal ones."""
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(p, F.array_max(p)).cast("int"))


def class_probability(p: Column, classes: list[str], outcome: Column) -> Column:
    """The probability of the row's outcome class; null for an unknown class."""
    at = F.array_position(F.array(*map(F.lit, classes)), outcome).cast("int")
    return F.get(p, at - 1)


def clipped_log(p: Column) -> Column:
    return F.ln(_clip(p))


def any_clipped(*arms: Column) -> Column:
    """Whether a component of any of the vectors is below EPSILON."""
    return F.least(*(F.array_min(a) for a in arms)) < EPSILON if len(arms) > 1 else F.array_min(arms[0]) < EPSILON


def missing(p: Column) -> Column:
    """Whether a score vector is null or has a null or NaN component: the model could not score the row."""
    return p.isNull() | F.coalesce(F.exists(p, lambda x: x.isNull() | F.isnan(x)), F.lit(True))
