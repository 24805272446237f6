"""Operator 8: token ids in a binary file format, by canonical length-limited Huffman coding.

Ids are counted over all documents; from the counts come code lengths of at most ``LIMIT`` bits (package-merge), and
from the lengths the canonical code. Documents are written in ascending order of id as blocks, each of which can be
decoded by itself: its bits, and a checkpoint with the bit offset of every ``STEP``-th id, from which decoding by one
table look-up per id can begin. A file is Parquet with a row per block (a splittable, atomically committed container);
the code is in a table of its own beside it.

Null text is the empty text, which has the end id alone. Repeated doc ids are kept, in any order among themselves.
Extra columns are ignored. An empty table gives empty files.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, lean, partitions, scratch_path, small_batches, stored

LIMIT, STEP, BLOCK_IDS = 20, 64, 1 << 18


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves, the others in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(1)
def _engines(tokenizer_file: str, pattern: str):
    """The tokenizers library for texts with special tokens; for all others a faster engine over the same vocabulary, whose ids are its merge order."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    special, letter = [x["content"] for x in spec["added_tokens"]], byte_letters()
    ranks = {bytes(letter[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return Tokenizer.from_file(tokenizer_file), tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), special


def tokenize(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int, kind: str = "<u2") -> DataFrame:
    """(doc_id, ids): ids packed as ``kind`` (which must hold them), ``end_id`` last; those of the tokenizers library without its special tokens."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, engine, special = _engines(tokenizer_file, pattern)
        end = np.array([end_id], kind).tobytes()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                c, ids = b.slice(k, 256), []
                for t in c.column(1):
                    t = t.as_py() or ""
                    x = library.encode(t, add_special_tokens=False).ids if any(s in t for s in special) else engine.encode_to_numpy(t, disallowed_special=())
                    ids.append(np.asarray(x).astype(kind).tobytes() + end)
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids binary")


def lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of at most ``limit`` bits that make the coded whole shortest: package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    merged, marks = weight, []
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        together = np.concatenate([weight, packages])
        by = np.argsort(together, kind="stable")
        marks.append(by < len(weight))  # at each place, whether a single id stands there
        merged = together[by]
    need, total = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for single in reversed(marks):
        ids = int(single[:need].sum())
        total[:ids] += 1
        need = 2 * (need - ids)
    total[:need] += 1
    out[order] = total
    return out


def canonical(lens: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes, code, last = np.zeros(len(lens), np.uint64), 0, 0
    for i in sorted(np.flatnonzero(lens), key=lambda i: (lens[i], i)):
        code <<= int(lens[i]) - last
        codes[i], last = code, int(lens[i])
        code += 1
    return codes


def pack(ids: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of ``ids``, and the bit offset of every STEP-th."""
    size = lens[ids].astype(np.int64)
    at = np.cumsum(size) - size
    total = int(size.sum())
    word, low = at >> 5, (at & 31)
    value = codes[ids] << (64 - low - size).astype(np.uint64)
    # in a 32-bit word the codes do not overlap, so their sum is exact as a double
    n = (total + 31) // 32 + 2
    bits = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return bits.astype(np.uint64).astype(">u4").tobytes(), at[::STEP].astype(np.int64)


def tables(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every LIMIT bits that may come next: the id, and the bits that it takes."""
    codes, ids = canonical(lens), np.flatnonzero(lens)
    symbol, taken = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    for i in ids.tolist():
        lo, n = int(codes[i]) << (LIMIT - int(lens[i])), 1 << (LIMIT - int(lens[i]))
        symbol[lo : lo + n], taken[lo : lo + n] = i, lens[i]
    return symbol, taken


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, symbol: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The ids of a block: from all checkpoints at once, one id of each at a step."""
    w = np.frombuffer(bits, ">u4").astype(np.uint64)
    at, out = checkpoints.astype(np.int64), np.zeros((len(checkpoints), STEP), np.uint32)
    for k in range(min(STEP, n)):
        word = np.minimum(at >> 5, len(w) - 2)
        next_ = ((w[word] << np.uint64(32) | w[word + 1]) >> (64 - LIMIT - (at & 31)).astype(np.uint64)) & np.uint64((1 << LIMIT) - 1)
        out[:, k] = symbol[next_]
        at = at + taken[next_]
    return out.reshape(-1)[:n]


def write(tokens: DataFrame, path: str, kind: str = "<u2") -> None:
    """Write ``tokens(doc_id, ids)`` under ``path``: ``code`` (id, bits) and ``blocks``, in ascending doc_id order over the files."""
    spark = tokens.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for b in batches:
            more = np.bincount(np.frombuffer(b"".join(x.as_py() for x in b.column(0)), kind).astype(np.int64))
            n = np.pad(n, (0, max(0, len(more) - len(n)))) + np.pad(more, (0, max(0, len(n) - len(more))))
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n[ids], pa.int64())], ["id", "n"])

    # the vocabulary's size bounds what comes to the driver
    counts = tokens.select("ids").mapInArrow(lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = (np.array(counts[c].to_pylist(), np.int64) for c in ("id", "n"))
    all_counts = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    all_counts[ids] = n
    lens = lengths(all_counts)
    spark.createDataFrame(pa.table({"id": pa.array(np.flatnonzero(lens), pa.int64()), "bits": pa.array(lens[np.flatnonzero(lens)], pa.int32())})).coalesce(1).write.parquet(f"{path}/code")
    code = spark.sparkContext.broadcast((lens, canonical(lens)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_lens, own_codes = code.value
        docs: list[int] = []
        parts: list[np.ndarray] = []
        done = held = 0

        def block() -> pa.RecordBatch:
            nonlocal docs, parts, held, done
            whole = np.concatenate(parts).astype(np.int64)
            bits, points = pack(whole, own_lens, own_codes)
            row = [[docs], [[len(p) for p in parts]], [done], [len(whole)], [bits], [points.astype("<i8").tobytes()]]
            done, held, docs, parts = done + len(whole), 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names)

        for b in batches:
            for d, x in zip(b.column(0), b.column(1), strict=True):
                docs.append(d.as_py())
                parts.append(np.frombuffer(x.as_py(), kind))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield block()
        if docs:
            yield block()

    names = ["doc_ids", "sizes", "before", "n_ids", "bits", "checkpoints"]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    spread = tokens.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    blocks = spread.mapInArrow(lean(encode), "doc_ids array<long>, sizes array<long>, before long, n_ids long, bits binary, checkpoints binary")
    blocks.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of each document in the files: ``start`` counts the ids of all documents before it."""
    code = spark.read.parquet(f"{path}/code").toArrow()
    lens = np.zeros(max(code["id"].to_pylist(), default=0) + 1, np.uint8)
    lens[code["id"].to_pylist()] = code["bits"].to_pylist()
    shipped = spark.sparkContext.broadcast(lens)
    blocks = spark.read.parquet(f"{path}/blocks")
    # a row for each writing task, in the files' order
    sums, offset, at = sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect()), {}, 0
    for part, n in sums:
        offset[part], at = at, at + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, taken = tables(shipped.value)
        for b in batches:
            for doc_ids, sizes, before, n, bits, points, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = unpack(bits, np.frombuffer(points, "<i8"), n, symbol, taken).astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                own = [ids[i:j].tobytes() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + before + offset[part], pa.int64()), pa.array(own, pa.binary())], ["doc_id", "start", "ids"])

    kept = blocks.select("doc_ids", "sizes", "before", "n_ids", "bits", "checkpoints", "part")
    return kept.mapInArrow(lean(decode), "doc_id long, start long, ids binary")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = stored(tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2), "token-ids")
    path = scratch_path(spark, "token-file")
    write(tokens, path)
    discard(tokens)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [x.as_py() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, path).mapInArrow(lean(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")
