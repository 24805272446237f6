"""A training-corpus pipeline over ``documents``: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinlens.llm import byte_bpe, jaccard_join, language_id, mixing, suffix_dedup
from twinlens.llm.common import SETTLED, row_key, short_plans, stored


#: The columns that stages work by; all others are carried.
OWN = ("doc_id", "text", "lang", "source")


def carrying(stage: Callable) -> Callable:
    """``stage`` with all columns but its own renamed while it works, so that no name of theirs meets one that it makes."""

    @functools.wraps(stage)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_plans(spark)
        inner = [c if c in OWN else f"_carried_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inner), sf_dir).select(*inner).toDF(*docs.columns)

    return run_


@carrying
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model, tuple(docs.columns)).where("lang_pred <> 'und'").select(*docs.columns)


@carrying
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word Jaccard similarity of 0.8 or more, that with the smallest id stays; of null ids alone, one stays."""
    found = stored(jaccard_join.keyed(docs, shingle=5, percent=80, settled=SETTLED), "near-found")
    named = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.expr("doc_id = component_id")).alias("first"))
    dropped = stored(named.where("not first").select("doc_id"), "near-dropped")
    out = jaccard_join.without(docs.where("doc_id is not null"), dropped, "doc_id").select(*docs.columns)
    first = "doc_id is null and component_id is null and (n_shingles = 0 or key = component)"
    kept = found.where(first).select(F.col("key").alias("_row"), "n_shingles").distinct()
    blank = docs.where("doc_id is null").withColumn("_row", row_key()).join(kept, "_row")
    once = blank.where("n_shingles > 0").dropDuplicates(["_row"])  # copies of one text; texts without words are no copies
    return out.unionByName(once.select(*docs.columns)).unionByName(blank.where("n_shingles = 0").select(*docs.columns))


@carrying
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that start in a document with a smaller id are cut out; a document may become empty."""
    return suffix_dedup.cut(docs)


@carrying
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: rows are left out or repeated."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each mixed document, and the bytes decoded from them.

    In small pieces, as executors still hold what the stages before have left there.
    """
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN, ("doc_id", "lang", "source"), small=True).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mix),
    ("byte_bpe", tokens),
]
#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
