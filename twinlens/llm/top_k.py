"""Operator 4: exact top-k by inner product.

Components become integers, so scores are exact. Vectors are turned to the singular directions of all of them, where
the first coordinates carry most of a product. In a block of candidates a query goes through the vectors by descending
length: it stops when length times length cannot reach its k-th score so far; before that, the products of the first
coordinates plus the Cauchy-Schwarz bound of the rest (with room for rounding) decide which vectors get an exact
product. Queries, a stated set, and candidates meet in bounded blocks; a query's best of each block are merged.

Vectors that are null or empty, or hold null or non-finite components, take no part; vectors of other lengths than the
query's are no candidates of it. Zero vectors score 0. Ties go to the smaller id. Rows with the query's id are its own.
Extra columns are ignored; with no queries or no candidates the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import small_batches, stored

#: Rows of a block of candidates and of queries; candidates taken at a time.
CANDIDATES, QUERIES, CHUNK = 4096, 1024, 256
_KIND = "vec_id long, dim int, vec binary"


def finite(x: Column) -> Column:
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))), F.lit(False))


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, dim, vec): floor(scale * component) of the usable vectors, as doubles in a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.floor(scale * np.array(v, np.float64)) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(v) for v in x], pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "dim", "vec"])

    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rows.where(finite(F.col("x"))).mapInArrow(run, _KIND)


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the right singular vectors, from the sums of products over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d in set(b.column(1).to_pylist()):
                x = np.array([np.frombuffer(v.as_py(), np.float64) for n, v in zip(b.column(1), b.column(2), strict=True) if n.as_py() == d])
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d * d, pa.int32()), pa.array(np.arange(d * d), pa.int32()), pa.array(s.ravel(), pa.float64())], ["dim", "cell", "v"])

    cells = rows.mapInArrow(run, "dim int, cell int, v double").groupBy("dim", "cell").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, own in cells.groupby("dim"):
        gram = own.sort_values("cell")["v"].to_numpy().reshape(d, d)
        out[int(d)] = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]
    return out


def best(k: int, turns: dict[int, np.ndarray]):
    """The k best candidates of a block for every query of a block."""

    def run(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(items):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        turn = turns[int(items["dim"].iloc[0])]
        head = max(1, len(turn) // 4)
        q, x = (np.array([np.frombuffer(v, np.float64) for v in d["vec"]]) for d in (queries, items))
        order = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")
        x, ids, own = x[order], items["vec_id"].to_numpy()[order], queries["vec_id"].to_numpy()
        qr, xr = q @ turn, x @ turn
        rest_q, rest_x = np.linalg.norm(qr[:, head:], axis=1), np.linalg.norm(xr[:, head:], axis=1)
        long_q, long_x = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        top = np.full((len(q), k), -np.inf)
        who = np.full((len(q), k), np.iinfo(np.int64).max)
        for at in range(0, len(x), CHUNK):
            c = slice(at, at + CHUNK)
            room = 1e-6 + 1e-9 * long_q * long_x[at]
            live = np.flatnonzero(long_q * long_x[at] + room >= top[:, -1])
            if not len(live):
                break
            bound = qr[live, :head] @ xr[c, :head].T + rest_q[live, None] * rest_x[None, c] + room[live, None]
            rows, cols = np.nonzero((bound >= top[live, -1:]) & (own[live, None] != ids[None, c]))
            rows, cols = live[rows], cols + at
            score = np.einsum("ij,ij->i", q[rows], x[cols])
            for r in np.unique(rows):
                new = slice(*np.searchsorted(rows, [r, r + 1]))
                s, w = np.append(top[r], score[new]), np.append(who[r], ids[cols[new]])
                first = np.lexsort((w, -s))[:k]
                top[r], who[r] = s[first], w[first]
        r, c = np.nonzero(np.isfinite(top))
        return pd.DataFrame({"query_id": own[r], "vec_id": who[r, c], "score": top[r, c].astype("int64")})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows for every row that is a query."""
    rows = stored(integers(vectors, scale), "topk-integers")
    small_batches(vectors.sparkSession)
    turns = rotations(rows)
    queries = rows.where(is_query)
    n, m = rows.count(), queries.count()
    many, parts = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    items = rows.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    keys = ["b", "qb", "dim"]
    found = asked.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInPandas(best(k, turns), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
