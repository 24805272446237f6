"""Shared helpers: scratch tables in the cluster's shared folder, salted joins, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Edges (16 bytes each) that one task settles, where it may; more take rounds.
SETTLED = 1 << 20
#: A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="twinlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts, which are held by the JVM and by Python at once. A lower setting stands."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1024), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        with contextlib.suppress(Exception):  # not every version of Spark has both
            now = spark.conf.get(key)
            if not now.isdigit() or not 0 < int(now) <= most:
                spark.conf.set(key, str(most))


def short_plans(spark: SparkSession) -> None:
    """Bound the plans' text, which the driver keeps for each query: one with a large literal has megabytes of it."""
    with contextlib.suppress(Exception):  # the setting may be another in other versions
        spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 16))


def release() -> None:
    """Give memory that Python has freed back to the system: a worker lives on after its task, beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(fn: Callable) -> Callable:
    """``fn`` over batches, with ``release`` at its end; Arrow takes its memory from the system's allocator, which keeps less."""

    def run(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from fn(batches)
        release()

    return run


def lean_group(fn: Callable) -> Callable:
    def run(table):
        pa.set_memory_pool(pa.system_memory_pool())
        out = fn(table)
        release()
        return out

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: what numbers of buckets are taken from, so that a bucket stays as large whatever the input."""
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, compressed each: they are most of what is shuffled."""
    press = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        texts = pa.array([press(x.as_py().encode("utf-8", "replace")) if x.is_valid else None for x in b.column(b.num_columns - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], b.schema.names)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "left", salt_from: str = "doc_id") -> DataFrame:
    """Join a possibly hot ``key``: ``right`` has one row per key and is repeated once per salt, ``left`` is spread by ``salt_from``."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "_salt"], how).drop("_salt")


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges (a, b) that come: roots are hooked to the smallest root next to them until none has one."""
    parts = [[c.to_numpy() for c in b.columns[:2]] for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    for k in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + (1 << 16)]), pa.array(ids[root[k : k + (1 << 16)]])], ["id", "component"])


def components(edges: DataFrame, label: str, max_rounds: int = 60, settled: int = 0) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (id, component) per id on an edge, component = smallest id reachable.

    Up to ``settled`` edges go to one task, as each round costs the driver some ten exchanges, however small. More take
    rounds, with the same result.

    Alternating large-star and small-star steps. Each step's groups are aggregated before they are joined, so no
    neighbourhood is ever collected; every round is cut with a table in the shared folder. An empty ``edges`` gives
    an empty result; duplicate edges and loops are allowed.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    if settled and e.count() <= settled:
        out = stored(e.coalesce(1).mapInArrow(lean(settle), "id long, component long"), label)
        discard(e)
        return out
    ids = e
    n = -1
    for _ in range(max_rounds):
        # large star: every neighbour above u points at the smallest of u and its neighbours
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = salted_join(both.where("b > a"), low, "a", 8, "inner", "b").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every neighbour below u, and u itself, points at the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = salted_join(large, low, "a", 8, "inner", "b")
        small = near.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        new = stored(small, label)
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        old, e = e, new
        if old is not ids:
            discard(old)
        if tuple(seen) == n:
            break
        n = tuple(seen)
    else:
        raise RuntimeError(f"components of {label} did not settle in {max_rounds} rounds")
    out = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return out.union(e.select(F.col("b"), F.col("b")).distinct())


def row_key(id_col: str = "doc_id", text: str = "text") -> Column:
    """The id, and for a null one a hash of the text: null ids are documents each, and equal texts among them copies."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("row"), text))


def bare(text: Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(text, F.lit(""))
