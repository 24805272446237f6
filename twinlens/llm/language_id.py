"""Operator 7: language identification by hierarchical discrimination.

A linear classifier on hashed byte trigrams predicts the language family first; then one-versus-one linear support
vector machines separate the languages of that family by majority, ties by the summed margins. The models are fitted
on a bounded sample of labelled documents, at most ``PER_LANG`` of each language, chosen by a hash of the id: the one
bound here. Whole texts are read, in training and in prediction.

Null text, or text with no letter, gets ``und`` with score 0. With nothing to learn from, every text gets ``und``.
Languages without a known family form families of their own. Extra columns are ignored; repeated rows give repeated
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import lean, release, small_batches

#: Size of the training sample for each language, the number of hashed features, passes over the sample.
PER_LANG, BITS, EPOCHS = 400, 12, 6
#: ISO 639-1 codes of language families.
FAMILIES = {
    "germanic": "en de nl sv da no is af",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk pl cs sk bg sr hr sl be",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ur pa gu",
}
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs.split()}


def features(text: str) -> np.ndarray:
    """Square roots of the hashed trigram counts of a text's lower-cased UTF-8 bytes, scaled to length 1; then a constant."""
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    codes = (a[:-2] | a[1:-1] << 8 | a[2:] << 16) * np.uint32(2654435761) >> np.uint32(32 - BITS) if len(a) > 2 else a[:0]
    x = np.sqrt(np.bincount(codes, minlength=1 << BITS)).astype(np.float32)
    return np.append(x / max(1.0, float(np.linalg.norm(x))), np.float32(1))


def svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss) by dual coordinate descent; y is +1 or -1."""
    w, alpha, c = np.zeros(x.shape[1], np.float64), np.zeros(len(x)), 1 / (reg * len(x))
    square, rng = (x * x).sum(1), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / square[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    """Family and pair classifiers as columns of one matrix."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = langs
        kin = [_FAMILY.get(a, a) for a in langs]
        self.families = sorted(set(kin))
        self.members = {f: [i for i, k in enumerate(kin) if k == f] for f in self.families}
        of = np.array([self.families.index(k) for k in kin])[y] if langs else y
        columns = [svm(x, np.where(of == i, 1.0, -1.0)) for i in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                rows = (y == a) | (y == b)
                self.pairs[a, b] = len(columns)
                columns.append(svm(x[rows], np.where(y[rows] == a, 1.0, -1.0)))
        self.weights = np.array(columns, np.float32).T if columns else np.zeros((x.shape[1], 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        """Languages and scores: the logistic of the smallest margin that led there, so from 0 to 1."""
        s = x @ self.weights
        out, score = [], []
        for row in s:
            n = len(self.families)
            order = np.argsort(-row[:n], kind="stable") if n > 1 else [0]
            margin = [float(row[order[0]])] if n > 1 else []
            own = self.members[self.families[order[0]]]
            votes = {a: [0, 0.0] for a in own}
            for a, b in combinations(own, 2):
                m = float(row[self.pairs[a, b]])
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
            best = max(own, key=lambda a: (*votes[a], -a))
            margin += [abs(float(row[self.pairs[min(a, best), max(a, best)]])) for a in own if a != best]
            out.append(self.langs[best])
            score.append(1 / (1 + np.exp(-4 * min(margin))) if margin else 1.0)
        return out, score


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Fit on ``docs(doc_id, text, lang)``; rows without text or lang are left out. Only hashed features reach the driver."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, (1 << BITS) + 1), np.float32), np.zeros(0, int))
    share = F.create_map(*[x for a in langs for x in (F.lit(a), F.lit(min(1.0, 1.5 * per_lang / counts[a] + 20 / counts[a])))])
    drawn = (F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("_u")
    some = known.withColumn("_u", drawn).where(F.col("_u") < F.element_at(share, F.col("lang")))
    first = W.partitionBy("lang").orderBy("_u", "doc_id")  # of at most about 1.5 * per_lang rows of each language
    some = some.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= per_lang).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["lang", "x"])

    rows = some.mapInArrow(lean(run), "lang string, x binary").toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    x = np.array([np.frombuffer(v, np.float32) for v in rows["x"].to_pylist()])
    model = Model(langs, x, np.array([langs.index(a) for a in rows["lang"].to_pylist()]))
    del rows, x
    release()
    return model


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score for every row of ``docs``; only the text is read for the prediction."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, letter = shipped.value, regex.compile(r"\p{L}").search
        for b in batches:
            for k in range(0, b.num_rows, 128):
                c = b.slice(k, 128)
                texts = [t.as_py() for t in c.column(c.num_columns - 1)]
                can = [i for i, t in enumerate(texts) if m.langs and t and letter(t)]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if can:
                    for i, a, s in zip(can, *m.predict(np.array([features(texts[i]) for i in can])), strict=True):
                        langs[i], scores[i] = a, float(s)
                yield pa.RecordBatch.from_arrays([*c.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return kept.mapInArrow(lean(run), f"{kinds}, lang_pred string, score double")


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
