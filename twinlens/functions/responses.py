"""Operators on the JSON responses of a chat-completion service."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What is read of a response.
RESPONSE = (
    "id string, object string, created long, model string, system_fingerprint string, "
    "choices array<struct<index int, message struct<role string, content string>, finish_reason string, "
    "logprobs struct<content array<struct<token string, logprob double, "
    "top_logprobs array<struct<token string, logprob double>>>>>>>, "
    "usage struct<prompt_tokens int, completion_tokens int, total_tokens int>"
)


def parsed(response: Column) -> Column:
    return F.from_json(response, RESPONSE)


def top_logprobs(response: Column) -> Column:
    """The candidates of the first generated token; null if any part of the path is missing."""
    first = F.get(parsed(response)["choices"], F.lit(0))["logprobs"]["content"]
    return F.get(first, F.lit(0))["top_logprobs"]


def class_logprobs(top: Column, classes: list[str], prefix: str = " ") -> Column:
    """Log-probabilities of ``prefix + class`` (a token's first occurrence counts); null for the row if one is missing."""

    def first(token: str) -> Column:
        return F.get(F.filter(top, lambda t: t["token"] == token), F.lit(0))["logprob"]

    found = F.array(*(first(prefix + c) for c in classes))
    return F.when(F.forall(found, lambda x: x.isNotNull() & ~F.isnan(x)), found)


def generation_text(response: Column) -> Column:
    return F.coalesce(F.get(parsed(response)["choices"], F.lit(0))["message"]["content"], F.lit(""))


def fingerprint(response: Column) -> Column:
    return parsed(response)["system_fingerprint"]


def json_safe(x: Column) -> Column:
    """A double for JSON: NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
