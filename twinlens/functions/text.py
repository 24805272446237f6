"""Text operators: token edits, refusals, templates, seeds, cache keys, perturbations and label extraction."""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import string
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from ..errors import ConfigError


#: White space as Python's ``str.split`` knows it, so that a text has the same tokens in the JVM and in Python.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Tokens of the longer of two texts whose columns of the distance are compared as the bits of one number.
FEW = 2048


def has_words(text: Column) -> Column:
    """Whether a text has ``words``, without splitting it."""
    return text.rlike("[^" + SPACES[1:-1])


def words(text: Column) -> Column:
    """Whitespace tokens; none of a blank text."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def distance(a: list, b: list) -> int:
    """Levenshtein distance of two token sequences, a column of the table at a time as the bits of a number (Myers, Hyyrö).

    Of equally long ones whose differing places have no token in common it is the number of these places. Else equal
    beginnings and ends are left out, and the longer sequence goes in blocks of ``FEW`` tokens, which hand on the steps
    between the columns of their last rows, so that memory is linear in the lengths.
    """
    if len(a) == len(b):
        other = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        if {x for x, _ in other}.isdisjoint(y for _, y in other):
            return len(other)  # not fewer either, as none of these tokens is left to be matched
    start, m, n = 0, len(a), len(b)
    while start < m and start < n and a[start] == b[start]:
        start += 1
    while m > start and n > start and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    long_, short = sorted((a[start:m], b[start:n]), key=len, reverse=True)
    steps = [1] * len(short)
    for at in range(0, len(long_) if short else 0, FEW):
        block, places = long_[at : at + FEW], {}
        for i, t in enumerate(block):
            places[t] = places.get(t, 0) | 1 << i
        last, ones = len(block) - 1, (1 << len(block)) - 1
        more, less = ones, 0  # where the column grows or falls by one from a row to the next
        for j, t in enumerate(short):
            same, step = places.get(t, 0), steps[j]
            level = same | less
            if step < 0:
                same |= 1
            cross = (((same & more) + more) ^ more) | same
            up, down = less | (~(cross | more) & ones), more & cross
            steps[j] = (up >> last & 1) - (down >> last & 1)
            up, down = up << 1 | (step > 0), down << 1 | (step < 0)
            more, less = (down | ~(level | up)) & ones, up & level & ones
    return len(long_) + sum(steps) if short else len(long_)


def token_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two token arrays (unit costs). Null if either array is null.

    In Arrow batches, as numbers of the batch's distinct tokens.
    """

    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        tokens = [x.flatten(), y.flatten()]
        codes = pa.chunked_array(tokens).dictionary_encode("encode").chunks  # none of an empty part
        ids = np.concatenate([np.empty(0, np.int32), *(c.indices.to_numpy() for c in codes)])
        sizes = (pc.fill_null(pc.list_value_length(c), 0).to_pylist() for c in (x, y))
        out, i, j = [], 0, len(tokens[0])
        for ok, m, n in zip(pc.and_(x.is_valid(), y.is_valid()).to_pylist(), *sizes, strict=True):
            out.append(distance(ids[i : i + m].tolist(), ids[j : j + n].tolist()) if ok else None)
            i, j = i + m, j + n
        return pa.array(out, pa.int32())

    return run(a.cast("array<string>"), b.cast("array<string>"))


def token_edit_pct(original: Column, changed: Column) -> Column:
    """Edit distance in percent of the original's tokens; null for an original without tokens."""
    return F.when(F.size(original) > 0, token_edit_distance(original, changed) / F.size(original) * 100.0)


def word_edit_pct(original: Column, changed: Column) -> Column:
    """``token_edit_pct`` of the ``words`` of two texts, split in Python: the JVM's split costs more than the comparison."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            # malformed bytes as in the JVM's strings
            a, b = (None if v is None else v.decode("utf-8", "replace").split() for v in (p.as_py(), q.as_py()))
            out.append(distance(a, b) / len(a) * 100.0 if a and b is not None else None)
        return pa.array(out, pa.float64())

    return run(original.cast("binary"), changed.cast("binary"))


# The phrases at a text's beginning, and the patterns, by which it counts as a refusal.
REFUSAL_PHRASES = [
    "i can't help with",
    "i cannot help with",
    "i can't help you",
    "i cannot help you",
    "i can't help engineer",
    "i cannot help engineer",
    "i can't help generate",
    "i cannot help generate",
    "i can't assist",
    "i cannot assist",
    "i can't do what",
    "i cannot do what",
    "i can't do that",
    "i cannot do that",
    "i cannot fulfill this",
    "i can't fulfill this",
    "i cannot fulfill the",
    "i can't fulfill the",
    "i cannot fulfill your",
    "i can't fulfill your",
    "i can't comply with the",
    "i cannot comply with the",
    "i can't comply with request",
    "i cannot comply with request",
    "i can't produce a paraphrase",
    "i cannot produce a paraphrase",
    "i can't meet the requirement",
    "i cannot meet the requirement",
    "i can't generate a paraphrase",
    "i cannot generate a paraphrase",
]
REFUSAL_PATTERNS = [
    r"^as an ai(?=[,\s]|$)",
    r"^as a language model(?=[,\s]|$)",
    r"\bi'?m sorry,? but i (?:cannot|can not|can't|won't)\b",
    r"\bunfortunately,? i (?:cannot|can'?t|won'?t)\b",
    r"\bmy apologies,? i (?:cannot|can'?t)\b",
    r"\bi (?:am unable|am not able|won'?t|can'?t|refuse) to (?:help|assist|do)\b",
    r"^sorry,? i (?:cannot|can'?t|won'?t)\b",
]


def _refusals() -> list[str]:
    return ["^(?:" + "|".join(REFUSAL_PHRASES) + ")", *REFUSAL_PATTERNS]


#: What a text with one of the unanchored patterns has in it: a plain search for it spares most texts the pattern.
REFUSAL_PARTS = {
    REFUSAL_PATTERNS[2]: ["m sorry"],
    REFUSAL_PATTERNS[3]: ["unfortunately"],
    REFUSAL_PATTERNS[4]: ["my apologies"],
    REFUSAL_PATTERNS[5]: ["to help", "to assist", "to do"],
}


def normalize_refusal(text: Column, ascii_only: bool = False) -> Column:
    """NFKC, typographic apostrophes as ', trimmed, lower case. ``ascii_only`` stays in the JVM and leaves NFKC out."""
    if ascii_only:
        curly = text.contains("’") | text.contains("‘") | text.contains("ʼ")
        return F.lower(F.trim(F.when(curly, F.translate(text, "’‘ʼ", "'''")).otherwise(text)))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        fold = str.maketrans(dict.fromkeys("’‘ʼ", "'"))
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(fold).strip().lower())

    return run(text)


def is_refusal(text: Column, ascii_only: bool = False) -> Column:
    """Whether a text is a refusal: by its beginning, or by a phrase anywhere. Null text is none."""
    t = normalize_refusal(text, ascii_only)
    hit = F.lit(False)
    for p in _refusals():
        found = t.rlike("(?U)" + p)
        if p in REFUSAL_PARTS:
            found = functools.reduce(operator.or_, map(t.contains, REFUSAL_PARTS[p])) & found
        hit = hit | found
    return F.coalesce(hit, F.lit(False))


def parse_template(template: str) -> list[tuple[str, str | None]]:
    """(literal, column) parts of a template that may hold ``{name}``, ``{{`` and ``}}`` only."""
    try:
        parts = list(string.Formatter().parse(template))
    except ValueError as e:
        raise ConfigError(f"malformed template: {e}") from e
    out = []
    for literal, name, spec, conversion in parts:
        if name is not None and (not name.isidentifier() or spec or conversion):
            raise ConfigError(f"unsupported placeholder {{{name}{'!' + conversion if conversion else ''}{':' + spec if spec else ''}}}; only {{name}} is allowed")
        out.append((literal, name))
    return out


def as_text(c: Column, kind: str) -> Column:
    """A value as Python's ``str`` would show it where that differs from a cast: None, True and False."""
    if kind == "boolean":
        return F.when(c.isNull(), "None").when(c, "True").otherwise("False")
    return F.coalesce(c.cast("string"), F.lit("None"))


def render(template: str, columns: dict[str, Column], kinds: dict[str, str] | None = None) -> Column:
    """A prompt: the template's literals and columns concatenated. Values are never read as templates."""
    parts = parse_template(template)
    absent = sorted({n for _, n in parts if n} - set(columns))
    if absent:
        raise ConfigError(f"template names {absent} are not among the columns {sorted(columns)}")
    pieces = []
    for literal, name in parts:
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(as_text(columns[name], (kinds or {}).get(name, "string")))
    return F.concat(*pieces) if pieces else F.lit("")


def _seed(blob: str) -> int:
    return int.from_bytes(hashlib.sha256(blob.encode()).digest()[:8], "big") & (2**63 - 1)


def derive_seed(seed: int, *parts: int | str | tuple) -> int:
    """A non-negative 63-bit seed from a study's seed and parts (int, str, or tuples of them)."""

    def check(x) -> None:
        if isinstance(x, tuple):
            for y in x:
                check(y)
        elif isinstance(x, bool) or not isinstance(x, (int, str)):
            raise TypeError(f"seed parts must be int, str or tuple, not {type(x).__name__}")

    check((seed, *parts))
    return _seed(json.dumps([seed, *parts]))


def seed_column(seed: int, *parts: Column | str) -> Column:
    """``derive_seed`` over columns of strings; strings that JSON escapes take the Python way."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    blob = F.concat(F.lit(f"[{seed}"), *(F.concat(F.lit(', "'), c, F.lit('"')) for c in columns), F.lit("]"))
    number = F.conv(F.substring(F.sha2(blob, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    plain = (number % F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")
    simple = F.lit(True)
    for c in columns:
        simple = simple & c.rlike(r'^[\x20\x21\x23-\x5B\x5D-\x7E]*$')

    @F.pandas_udf("long")
    def escaped(x: pd.DataFrame) -> pd.Series:
        return pd.Series([derive_seed(seed, *row) for row in x.itertuples(index=False)])

    return F.when(simple, plain).otherwise(escaped(F.struct(*(c.alias(f"p{i}") for i, c in enumerate(columns)))))


def seed_column_ascii(seed: int, *parts: Column | str) -> Column:
    """``seed_column`` for strings known to be plain: in the JVM alone."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    blob = F.concat(F.lit(f"[{seed}"), *(F.concat(F.lit(', "'), c, F.lit('"')) for c in columns), F.lit("]"))
    return (F.conv(F.substring(F.sha2(blob, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


#: Versions that are part of cache keys, so that a change of an algorithm never reads older entries.
PACKAGE_VERSION, PARAPHRASE_VERSION, INFERENCE_VERSION = "0.1", "1", "1"


def _key(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object of the fields in the order of their names, nulls included."""
    blob = F.to_json(F.struct(*(F.coalesce(fields[k].cast("string"), F.lit("\u0000null")).alias(k) for k in sorted(fields))))
    return F.sha2(blob, 256)


def paraphrase_key(original: Column, target: Column, edit_pct: Column, model: str, tokenizer: str, tolerance: float, max_retries: int, seed: Column) -> Column:
    return _key({
        "stage": F.lit(PARAPHRASE_VERSION), "package": F.lit(PACKAGE_VERSION), "original": original, "target": target, "edit_pct": F.round(edit_pct, 4),
        "model": F.lit(model), "tokenizer": F.lit(tokenizer), "tolerance": F.lit(tolerance), "max_retries": F.lit(max_retries), "seed": seed,
    })


def inference_key(prompt: Column, model: str, mode: str, classes: list[str] | None, seed: Column) -> Column:
    """Classes keep the user's order, which is part of the key."""
    return _key({"stage": F.lit(INFERENCE_VERSION), "prompt": prompt, "model": F.lit(model), "mode": F.lit(mode), "classes": F.lit(json.dumps(classes)), "seed": seed})


def swap_words(text: Column, pairs: dict[str, str]) -> Column:
    """A perturbation: whole tokens replaced by their counterparts, compared in lower case."""
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.array_join(F.transform(words(text), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " ")


def extract_letter(text: Column, letters: str = "A-D") -> Column:
    """The first letter of a class that stands alone; null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"\b([{letters}])\b", 1), F.lit(""))
