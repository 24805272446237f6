"""Operator 2: near-duplicate embeddings by spherical-cap filters.

Random product codes give filter directions: each of ``CODES`` codes cuts the space into blocks of coordinates after
its own random rotation, each with random code words, and a filter is one word of each block. A vector goes to the
``BEST`` filters of each code whose directions are nearest to it, whatever their distance, so no vector is without
filters at any size of the table. Vectors that share a filter are compared, each pair in the smallest filter that both
have, by cosine in double precision. The number of filters grows with the number of vectors, so that a filter's share
of unrelated vectors stays the same, but not beyond the number at which a filter is a cap of ``NARROW``, as narrower
caps would part near vectors (few dimensions); a filter with more than ``BLOCK`` vectors is compared in pairs of blocks.
Tasks return link counts and a spanning forest of their links, never the pairs.

Equal vectors are one class, compared once and counted with its size. Vectors that are null, zero, or hold null or
non-finite components link with nothing; so do vectors of different lengths. Repeated ids count as rows each. Extra
columns are ignored. An empty table gives an empty result. Filters are probabilistic: a pair that shares none is missed.
The README has the measured share of such pairs by size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import components, partitions, salted_join, small_batches, stored

#: Codes, filters of a vector in each, unrelated vectors of a filter on average, rows of a compared block.
CODES, BEST, SHARE, BLOCK = 4, 11, 256, 768
#: The narrowest cap (half its opening angle), in radians.
NARROW = np.pi / 6
_KIND = "vec_id long, dim int, vec binary, n long"


def usable(x: Column) -> Column:
    """Whether a vector has a direction: not null or empty, all components finite, one of them not 0."""
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def cap_share(dim: int, angle: float) -> float:
    """The share of the sphere that is within ``angle`` of a point."""
    if dim < 2:
        return 0.5
    at = (np.arange(1 << 14) + 0.5) / (1 << 14)
    inside, whole = (top * np.mean(np.sin(top * at) ** (dim - 2)) for top in (angle, np.pi))
    return float(inside / whole)


@lru_cache(64)
def plan(n: int, dim: int) -> tuple[int, int]:
    """Blocks of a code and words of a block, for ``n`` vectors."""
    p = max(min(1 / 32, SHARE / max(n, 1)), cap_share(dim, NARROW))
    need, blocks = BEST / p, 1
    # blocks of few coordinates have few distinct words
    while need ** (1 / blocks) > 512 and blocks < dim // 8:
        blocks += 1
    return blocks, int(np.ceil(need ** (1 / blocks)))


@lru_cache(16)
def code(dim: int, blocks: int, words: int, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Code ``k``: the rotation, and each block's words as unit columns (of its coordinates)."""
    rng = np.random.default_rng([dim, blocks, words, k])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    parts = [rng.standard_normal((len(c), words)) for c in np.array_split(np.arange(dim), blocks)]
    return turn, [w / np.linalg.norm(w, axis=0) for w in parts]


def decode(x: np.ndarray, blocks: int, words: int) -> np.ndarray:
    """The sorted filters (word numbers as digits, after the code's) of each unit row of ``x``: in each code the best BEST."""

    def best(score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-score, axis=1, kind="stable")[:, :BEST]
        return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    out = []
    for k in range(CODES):
        turn, parts = code(x.shape[1], blocks, words, k)
        y, at = x @ turn, 0
        total, ids = np.zeros((len(x), 1)), np.full((len(x), 1), k, np.int64)
        for w in parts:
            s, digit = best(y[:, at : at + len(w)] @ w, np.broadcast_to(np.arange(words), (len(x), words)))
            at += len(w)
            # of two ordered lists, only pairs of early places are among the best sums
            i, j = np.divmod(np.arange(total.shape[1] * s.shape[1]), s.shape[1])
            early = (i + 1) * (j + 1) <= BEST
            i, j = i[early], j[early]
            total, ids = best(total[:, i] + s[:, j], ids[:, i] * words + digit[:, j])
        out.append(ids)
    return np.sort(np.concatenate(out, 1), 1)


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric 0/1 matrix, the smallest row of its component."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label, len(near)).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def compare(threshold: float):
    """Of one filter's block, or of two: each vector's number of links first seen here, and a root it is linked with."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable", ignore_index=True)
        x = np.array([np.frombuffer(v, np.float64) for v in rows["vec"]])
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if rows["lo"][0] != rows["hi"][0]:
            side = rows["block"].to_numpy()
            near &= side[:, None] != side[None, :]
        live = np.flatnonzero(near.any(1))
        near, rows = near[np.ix_(live, live)], rows.iloc[live]
        # a pair that a smaller filter has as well is counted there
        lower = [f[f < k] for f, k in zip(rows["filters"], rows["filter"], strict=True)]
        if lower and (all_lower := np.concatenate(lower)).size:
            names, col, times = np.unique(all_lower, return_inverse=True, return_counts=True)
            has = np.zeros((len(rows), len(names)), np.float32)
            has[np.repeat(np.arange(len(rows)), [len(f) for f in lower]), col] = 1
            has = has[:, times > 1]
            near &= (has @ has.T) == 0
        ids, many = rows["vec_id"].to_numpy(), rows["n"].to_numpy()
        out = pd.DataFrame({"vec_id": ids, "links": near @ many, "root": ids[forest(near)] if len(ids) else ids})
        return out[out["links"] > 0]

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.select("vec_id", F.when(usable(F.col("x")), F.col("x")).alias("x"))
    # -0.0 equals 0.0 in a class, as it does in the cosine
    name = F.sha2(F.array_join(F.transform("x", lambda v: (v + F.lit(0.0)).cast("string")), ",").cast("binary"), 256)
    rows = rows.withColumn("name", name)
    classes = rows.where("x is not null").groupBy("name").agg(F.min("vec_id").alias("class"), F.count(F.lit(1)).alias("n"), F.first("x").alias("x"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(v, np.float64) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(v) for v in x], pa.int32()), pa.array([v.tobytes() for v in x], pa.binary()), b.column(2)], ["vec_id", "dim", "vec", "n"])

    one = stored(classes.select(F.col("class").alias("vec_id"), "x", "n").mapInArrow(packed, _KIND), "cap-classes")
    n = one.count()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            found = [None] * b.num_rows
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = np.array([np.frombuffer(b.column(2)[int(i)].as_py(), np.float64) for i in own])
                for i, f in zip(own.tolist(), decode(x / np.linalg.norm(x, axis=1)[:, None], *plan(n, dim)), strict=True):
                    found[i] = f
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], [*b.schema.names, "filters"])

    spread = stored(one.repartition(partitions(spark)).mapInArrow(listed, f"{_KIND}, filters array<long>"), "cap-filters")
    hit = spread.withColumn("filter", F.explode("filters"))
    sizes = hit.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # hot filters are few rows on either side; the sizes are joined by shuffling, with skewed keys split by salt
    hit = hit.withColumn("_key", F.xxhash64("dim", "filter"))
    sizes = sizes.select(F.xxhash64("dim", "filter").alias("_key"), F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")).groupBy("_key").agg(F.max("parts").alias("parts"))
    hit = salted_join(hit, sizes, "_key", 8, "inner", "vec_id").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    hit = hit.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hit = hit.select("vec_id", "dim", "vec", "n", "filters", "filter", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = stored(hit.groupBy("dim", "filter", "lo", "hi").applyInPandas(compare(threshold), "vec_id long, links long, root long"), "cap-links")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    part = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), "cap-components")
    of_class = one.select("vec_id", "n").join(links, "vec_id", "left").join(part.select(F.col("id").alias("vec_id"), "component"), "vec_id", "left")
    named = classes.select("name", F.col("class").alias("vec_id")).join(of_class, "vec_id").withColumnRenamed("vec_id", "class")
    out = salted_join(rows.select("vec_id", "name"), named, "name", 16, "left", "vec_id")
    out = out.select(
        "vec_id",
        F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "class", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
