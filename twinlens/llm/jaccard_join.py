"""Operator 5: n-gram Jaccard self-join by T-occurrence search.

1. Documents with equal shingle sets are one class; from here on classes are joined.
2. Classes are brought together exactly: a pair of the required similarity differs in at most k shingles, k following
   from the sizes, so of more than k ranges of the hash space at least one holds the same shingles in both. Range hashes
   travel packed, a row per task and bucket. Classes that share one are compared by parity sketches, which never differ
   more than the sets; the components of what is left are clusters, which contain every true link.
3. The sets of clusters of two or more classes are made again from the texts (a Bloom filter of fixed size keeps others
   from being sent) and searched in blocks: short inverted lists are merged and counted, long ones are probed by
   binary search for what can still reach the overlap T (DivideSkip), and each pair that reaches its own T is a link.
   Larger clusters are searched in pairs of blocks. Tasks return a spanning forest of their links.

Null or empty text, or text without words, has the empty set and links with nothing; text with fewer words than a
shingle has one shingle, the whole sequence. Whole texts are read. Repeated ids count as one document for links. Null
ids are documents each, larger than all others: a component of null ids alone has a null ``component_id``. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import components, discard, lean, lean_group, partitions, row_key, salted_join, small_batches, stored, text_bytes
from .shingles import Hasher, mix, shingle_set

#: Classes of a searched block; bits of the Bloom filter; signatures that a task holds before it sends them; text that a bucket stands for.
BLOCK, BLOOM_BITS, HELD, BUCKET = 256, 1 << 24, 1 << 18, 8 << 20
#: DivideSkip's weight of the number of long lists.
MU = 0.0085
_U = np.uint64


@lru_cache(1024)
def size_class(n: int, percent: int) -> int:
    """Sizes fall into classes such that a set of the required similarity is in the same class or a neighbouring one."""
    i, least = 0, 1
    while True:
        least = least * 100 // percent + 1
        if n < least:
            return i
        i += 1


@lru_cache(256)
def ranges(i: int, percent: int) -> np.ndarray:
    """Bounds of the ranges for pairs whose smaller set is in class ``i``: some more than they can differ in."""
    least = 1
    for _ in range(i + 1):
        least = least * 100 // percent + 1
    large = least - 1
    differ = (large + large * 100 // percent) * (100 - percent) // (100 + percent)
    parts = differ + 1 + differ // 8
    return np.array([(j << 64) // parts for j in range(1, parts)], np.uint64)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the ranges of a sorted set, for its own class and for the one below.

    Empty ranges say little. Two sets have at least ``spare`` ranges alike, so if fewer of a set's are empty, one that is
    not is among them, and its empty ranges need not be sent.
    """
    own, out = size_class(len(s), percent), []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + _U(0x5851F42D4C957F2D)))])
    for i in {own, max(0, own - 1)}:
        at = np.concatenate([[0], np.searchsorted(s, ranges(i, percent)), [len(s)]])
        part = np.arange(len(at) - 1, dtype=np.uint64) + _U(i << 32)
        h = mix(mix(sums[at[1:]] - sums[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64)) + part * _U(0x9E3779B97F4A7C15))
        full, spare = at[1:] > at[:-1], (len(h) - 1) // 9 + 1
        out.append(h if len(h) - full.sum() >= spare else h[full])
    return np.concatenate(out)


def sketch_bits(n: int) -> int:
    """Bits of a set's sketch: the power of two that is twice its size or more, 64 at least."""
    return 1 << max(6, (2 * n - 1).bit_length())


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set's hashes by their low bits: two sketches differ in no more bits than the sets in shingles."""
    m = sketch_bits(len(s))
    return np.packbits((np.bincount((s & _U(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def name(s: np.ndarray) -> int:
    """A class's id: 63 bits of a digest of the set."""
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little") >> 1


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hasher = Hasher()
    for b in batches:
        for k in range(0, b.num_rows, 512):
            c = b.slice(k, 512)
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in c.column(1)]
            yield c, [shingle_set(w, shingle) for w in hasher.texts(texts)]


def class_and_signatures(docs: DataFrame, shingle: int, percent: int, buckets: int) -> DataFrame:
    """Rows of two kinds: with bucket -1 a batch of packed (key, n_shingles and whether the id is null, class), else a bucket's packed signatures and classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(where: list[int], a: list[bytes], b: list[bytes], c: list[bytes], d: list[bytes] | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.binary()), pa.array(d or [b""] * len(where), pa.binary())], ["bucket", "a", "b", "c", "d"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sigs, of, held, seen
            if sigs:
                s, c = np.concatenate(sigs), np.repeat(np.array(of, np.int64), [len(x) for x in sigs])
                # the top bits are not part of a hash table's place later on
                where = ((s >> _U(32)) % _U(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                s, c, where = s[order], c[order], where[order]
                cut = np.searchsorted(where, np.arange(buckets + 1))
                for k in range(0, buckets, 64):
                    own = [i for i in range(k, min(buckets, k + 64)) if cut[i] < cut[i + 1]]
                    if own:
                        yield rows(own, [s[cut[i] : cut[i + 1]].tobytes() for i in own], [c[cut[i] : cut[i + 1]].tobytes() for i in own], [b""] * len(own))
            sigs, of, held, seen = [], [], 0, set()

        sigs: list[np.ndarray] = []
        of: list[int] = []
        held, seen = 0, set()
        for c, sets in _sets(batches, shingle):
            names = [name(s) if len(s) else -1 for s in sets]
            yield rows([-1], [c.column(0).to_numpy().astype(np.int64).tobytes()], [np.array([len(s) << 1 | blank for s, blank in zip(sets, c.column(2).to_pylist(), strict=True)], np.int64).tobytes()], [np.array(names, np.int64).tobytes()], [b"".join(sketch(s) for s in sets if len(s))])
            for s, k in zip(sets, names, strict=True):
                if k >= 0 and k not in seen:
                    seen.add(k)
                    sigs.append(signatures(s, percent))
                    of.append(k)
                    held += len(sigs[-1])
            if held > HELD:
                yield from flush()
        yield from flush()

    return docs.select(row_key().alias("key"), "text", F.col("doc_id").isNull().alias("blank")).mapInArrow(lean(run), "bucket int, a binary, b binary, c binary, d binary")


def _runs(table: pa.Table) -> pa.Table:
    """Classes of one bucket with a signature in common: (run, class), a run's number being a hash of its classes."""
    s, c = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(k)]) for k, t in (("a", np.uint64), ("b", np.int64)))
    order = np.lexsort((c, s))
    s, c = s[order], c[order]
    one = np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
    s, c = s[one], c[one]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(head, len(s)))
    run = mix(np.add.reduceat(mix(c.view(np.uint64)), head) + size.astype(np.uint64))
    many = np.flatnonzero(size > 1)
    own = many[np.unique(run[many], return_index=True)[1]]
    at = np.repeat(head[own], size[own]) + np.arange(size[own].sum()) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
    return pa.table({"run": pa.array(np.repeat(run[own], size[own]).view(np.int64), pa.int64()), "class": pa.array(c[at], pa.int64())})


def _links_of_runs(percent: int):
    """Candidate links within runs: pairs whose sketches differ in no more bits than sets of that similarity may.

    From each class in turn all that are still apart are compared; so runs of near copies take one comparison each.
    """

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["run"].to_numpy(), kind="stable")
        runs, names, sizes = (table[k].to_numpy()[order] for k in ("run", "class", "n_shingles"))
        sketches = [table["sketch"][int(i)].as_py() for i in order]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        out = []
        cuts = np.append(np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])), len(runs)).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = names[lo:hi].tolist()
            if len({find(c) for c in own}) == 1:
                continue
            width = min(len(x) for x in sketches[lo:hi])
            bits = np.array([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), 0) for x in sketches[lo:hi]])
            n = sizes[lo:hi]
            apart, queue = np.arange(1, hi - lo), [0]
            while len(apart):
                x = queue.pop() if queue else None
                if x is None:
                    x, apart = int(apart[0]), apart[1:]
                near = np.bitwise_count(bits[apart] ^ bits[x]).sum(1, dtype=np.int64) * (100 + percent) <= (n[apart] + n[x]) * (100 - percent)
                for y in apart[near].tolist():
                    a, b = find(own[x]), find(own[y])
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((own[x], own[y]))
                queue += apart[near].tolist()
                apart = apart[~near]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in zip(*(b.column(k) for k in (1, 2, 3)), b.column(4), strict=True):
            i, n, c = (np.frombuffer(x.as_py(), np.int64) for x in row[:3])
            blank, n = (n & 1).astype(bool), n >> 1
            ends = np.cumsum([sketch_bits(k) // 8 if k else 0 for k in n.tolist()]).tolist()
            data = row[3].as_py()
            own = [data[e - (sketch_bits(k) // 8 if k else 0) : e] for e, k in zip(ends, n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(blank), pa.array(n), pa.array(c, mask=c < 0), pa.array(own, pa.binary())], ["key", "blank", "n_shingles", "class", "sketch"])


def bloom(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of BLOOM_BITS bits (of fixed size, whatever the input) of a column of ids, with two hashes."""
    at = ids.select(F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(k), column), F.lit(BLOOM_BITS)) for k in (1, 2)))).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).toArrow()
    out = np.zeros(BLOOM_BITS >> 5, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` (not null) is none of ``ids``, so that of the others only few are shuffled.

    A Bloom filter of BLOOM_BITS bits (a table of fixed size, broadcast) tells what is certainly not among ``ids``; the
    rest is joined. With many more ids than bits the filter lets all through to the join.
    """
    spot = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col(column)), F.lit(BLOOM_BITS))
    bits = ids.select(F.explode(F.array(spot(1), spot(2))).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    bits = stored(bits, "bloom")
    for k in (1, 2):
        rows = rows.withColumn(f"_at{k}", spot(k)).withColumn(f"_word{k}", F.shiftright(f"_at{k}", 6))
        rows = rows.join(F.broadcast(bits.select(F.col("word").alias(f"_word{k}"), F.col("bits").alias(f"_bits{k}"))), f"_word{k}", "left")
    hit = " and ".join(f"coalesce(shiftright(_bits{k}, cast(_at{k} % 64 as int)) & 1, 0) = 1" for k in (1, 2))
    extra = [f"_{x}{k}" for x in ("at", "word", "bits") for k in (1, 2)]
    return rows.where(f"not ({hit})").drop(*extra).unionByName(rows.where(hit).drop(*extra).join(ids, column, "left_anti"))


def search(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set, the smallest place that its links reach within ``sets``: the T-occurrence search of a block."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(n), sizes)
    order = np.lexsort((doc, token))
    posting, start = doc[order], np.concatenate([[0], np.cumsum(np.bincount(token))])
    ends = np.cumsum(sizes)
    root = np.arange(n)
    most = int(np.diff(start).max())
    for x in range(n):
        if (root == root[0]).all():
            break
        lists = token[ends[x] - sizes[x] : ends[x]]
        length = start[lists + 1] - start[lists]
        lists, length = lists[np.argsort(length, kind="stable")], np.sort(length)
        least = -(-int(sizes[x]) * percent // 100)  # the overlap that the smallest partner needs
        long_ = min(least - 1, int(least / (MU * np.log(max(most, 2)) + 1)))
        short, far = lists[: len(lists) - long_], lists[len(lists) - long_ :]
        if not length[: len(short)].sum() > len(short):
            continue  # x is alone in its short lists
        merged = np.concatenate([posting[start[t] : start[t + 1]] for t in short.tolist()])
        count = np.bincount(merged, minlength=n)
        need = -(-percent * (sizes[x] + sizes) // (100 + percent))
        can = np.flatnonzero((count > 0) & (count + long_ >= need) & (root != root[x]) & (np.minimum(sizes, sizes[x]) * 100 >= percent * np.maximum(sizes, sizes[x])))
        have, left = count[can], long_
        for t in far[::-1].tolist():
            keep = (have + left >= need[can]) & (root[can] != root[x])
            can, have = can[keep], have[keep]
            if not len(can):
                break
            own = posting[start[t] : start[t + 1]]
            at = np.searchsorted(own, can)
            have = have + (own[np.minimum(at, len(own) - 1)] == can)
            left -= 1
        for y in can[have >= need[can]].tolist():
            low, high = sorted((root[x], root[y]))
            root[root == high] = low
    return root


def clusters_to_links(docs: DataFrame, member: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links within the clusters ``member(rep, cluster)``, rep being a class's smallest doc id, or key if all are null."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bloom(member, "rep"))
    maybe = docs.select(row_key().alias("key"), "text")
    maybe = maybe.select("key", "text", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(BLOOM_BITS)).alias("p"), F.pmod(F.xxhash64(F.lit(2), "key"), F.lit(BLOOM_BITS)).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some() -> Iterator[pa.RecordBatch]:
            own = bits.value
            for b in batches:
                hit = np.ones(b.num_rows, bool)
                for k in (2, 3):
                    at = b.column(k).to_numpy()
                    hit &= (own[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
                yield b.filter(pa.array(hit))

        for c, sets in _sets(some(), shingle):
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "set"])

    sets = maybe.mapInArrow(lean(run), "rep long, set binary")
    sizes = member.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    member = salted_join(member, sizes, "cluster", 16, "inner", "rep")
    rows = sets.join(member, "rep").dropDuplicates(["rep"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("rep", "set", "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def links(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rep", kind="stable", ignore_index=True)
        root = search([np.frombuffer(s, np.uint64) for s in own["set"]], percent)
        ids = own["rep"].to_numpy()
        return pd.DataFrame({"a": ids[root], "b": ids})[root != np.arange(len(ids))]

    return rows.groupBy("cluster", "lo", "hi").applyInPandas(lean_group(links), "a long, b long")


def join(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: ``component_id`` is the smallest id that links reach."""
    return keyed(docs, shingle, percent).select("doc_id", "n_shingles", "component_id")


def keyed(docs: DataFrame, shingle: int, percent: int, settled: int = 0) -> DataFrame:
    """``join`` with each row's ``key`` (see ``row_key``) and the ``component``, one of the component's keys. ``settled``: see ``components``."""
    spark = docs.sparkSession
    buckets = max(2 * partitions(spark), -(-text_bytes(docs) // BUCKET))
    small_batches(spark)
    packed = stored(class_and_signatures(docs, shingle, percent, buckets), "jaccard-signatures")
    every = stored(packed.where("bucket < 0").mapInArrow(lean(_unpack), "key long, blank boolean, n_shingles long, class long, sketch binary"), "jaccard-classes")
    runs = packed.where("bucket >= 0").groupBy("bucket").applyInArrow(lean_group(_runs), "run long, class long").distinct()
    known = every.where("class is not null").groupBy("class").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    # a class is in no more runs than its set has ranges
    runs = runs.join(known, "class").withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets)).cast("int"))
    met = runs.select("bucket", "run", "class", "n_shingles", "sketch").groupBy("bucket").applyInArrow(lean_group(_links_of_runs(percent)), "a long, b long").distinct()
    cluster = components(met, "jaccard-clusters", settled=settled)
    discard(packed)
    reps = every.where("class is not null").groupBy("class").agg(F.min(F.when(~F.col("blank"), F.col("key"))).alias("least"), F.min("key").alias("rep"))
    reps = reps.select("class", "least", F.coalesce("least", "rep").alias("rep"))
    member = stored(reps.join(cluster, reps["class"] == cluster["id"]).select("class", "rep", F.col("component").alias("cluster")), "jaccard-members")
    found = components(clusters_to_links(docs, member.select("rep", "cluster"), shingle, percent), "jaccard-components", settled=settled)
    linked = reps.join(found, reps["rep"] == found["id"]).select("class", "rep", "least", "component")
    # a null id's key may be the smallest of its component, whose smallest id is another then
    lows = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = salted_join(linked.select("class", "rep", "component"), lows, "component", 16, "inner", "rep").drop("rep")
    of = reps.join(linked, "class", "left").select("class", F.coalesce("component", "rep").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = salted_join(every.drop("sketch"), of, "class", 16, "left", "key").withColumn("doc_id", F.when(~F.col("blank"), F.col("key")))
    return out.select("key", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component", "key").alias("component"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
