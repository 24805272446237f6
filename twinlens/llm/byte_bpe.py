"""Operator 1: byte-level BPE encoding and decoding.

Words are the matches of the tokenizer's split pattern. Merges are folded by Spark higher-order functions over the
byte arrays of distinct words, with the ranks of pairs as one constant map (a perfect hash table in arrays, as Spark scans
a map's keys; a scalar of the plan, so that its text stays short). Each distinct word of all documents is folded once:

1. documents are dealt to chunks of about ``CHUNK`` bytes by a hash of the row; a chunk sends its distinct words, in the
   order of their hashes, to the buckets of words that ranges of the hash make;
2. a bucket folds its distinct words and sends each chunk the ids of that chunk's words, in the order in which they came;
3. the chunk, whose documents stay where they were dealt, takes the ids of its words, of its units (parts of texts whose
   words don't depend on what is around them) and of its documents; decoding takes the ids' binary pieces.

Buckets and chunks grow in number with the data, not in size. A word of more than ``FOLDED`` bytes is merged by a heap in
its bucket instead, as the fold takes time with the square of a word's length. Null text is encoded as the empty text,
which has no ids; extra columns are ignored unless named, and may have any name that does not start with an underscore;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import lean, lean_group, release, short_plans, small_batches, squeezed, stored, text_bytes

#: Bytes of text of a chunk of documents and of the text that a bucket of words stands for, on average.
CHUNK, BUCKET = 12 << 20, 16 << 20
#: Both, where executors hold the memory of other work.
SMALL = 4 << 20
#: Bytes of the longest word that is folded; words of a row.
FOLDED, ROW_WORDS = 1 << 10, 1 << 10
#: Units that are put together at once.
STEP = 1 << 20
#: The split pattern (fixed value) whose matches can be found piece by piece.
BY_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single space between what is no white space: no word reaches over it to the left.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_NONE = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken vocabulary file (on the driver: a vocabulary is a parameter, not data)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankMap(NamedTuple):
    """The ranks of pairs of ids as a constant of the plan, a perfect hash table: pair key k is in slot (k * mix + shift of its group) % slots.

    An id takes ``bits`` bits. ``whole`` has the pieces that no merges reach, and their ids.
    """

    table: Column
    bits: int
    groups: int
    slots: int
    whole: dict[str, int]


#: Multipliers of a pair's key (under 2**41 for ids of 20 bits): products stay below 2**63.
_MIX_GROUP, _MIX_SLOT = 2654435, 1640531


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces that merges alone make of ``word``."""
    p = [word[i : i + 1] for i in range(len(word))]
    while len(p) > 1:
        r, i = min((ranks.get(p[i] + p[i + 1], _NONE), i) for i in range(len(p) - 1))
        if r == _NONE:
            break
        p[i : i + 2] = [p[i] + p[i + 1]]
    return p


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> RankMap:
    """The constant of a vocabulary whose ids are its ranks and that holds every single byte.

    It is one row in the shared folder, read as a scalar: as a literal in the expression it would be megabytes in each
    text that the driver makes of the plan.
    """
    bits = (max(ranks.values()) + 2).bit_length()
    if bits > 20:
        raise ValueError("ids of more than 20 bits")
    pairs = {(ranks[b[:i]] << bits) + ranks[b[i:]] + 1: r for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks}
    groups, slots = _prime(len(pairs) // 3 + 1), _prime(len(pairs) * 4 // 3 + 2)
    members: dict[int, list[int]] = {}
    for k in pairs:
        members.setdefault(k * _MIX_GROUP % groups, []).append(k)
    table, shifts, taken, start = [0] * slots, [0] * groups, bytearray(slots), 0
    for g in sorted(members, key=lambda g: -len(members[g])):
        homes = [k * _MIX_SLOT % slots for k in members[g]]
        if len(set(homes)) < len(homes):
            raise ValueError("two pairs of a group share a slot")
        start = (start + 7919) % slots
        shifts[g] = next(d % slots for d in range(start, start + slots) if not any(taken[(h + d) % slots] for h in homes))
        for k, h in zip(members[g], homes, strict=True):
            taken[x := (h + shifts[g]) % slots] = 1
            table[x] = (k << bits) + pairs[k]
    whole = {b.decode("latin-1"): r for b, r in ranks.items() if len(b) > 1 and len(_merged(b, ranks)) > 1}
    row = pa.table({"single": [[ranks[bytes([i])] for i in range(256)]], "shift": [shifts], "pair": [table]})
    constant = stored(spark.createDataFrame(row), "bpe-ranks").select(F.struct("single", "shift", "pair"))
    return RankMap(constant.scalar(), bits, groups, slots, whole)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(words: Column, ranks: RankMap) -> Column:
    """Ids of each word of an array of strings. The constant is bound once."""
    return _let(ranks.table, lambda table: F.transform(words, lambda w: _fold_one(w, table, ranks)))


def _fold_one(word: Column, table: Column, ranks: RankMap) -> Column:
    """Merge the adjacent pair of least rank, leftmost first, until no pair has a rank.

    A symbol is one long: rank of the pair that it starts, its offset in the word, its id. So the least symbol is the
    one to merge, and its rank is the id of what comes of it.
    """
    bits, high = ranks.bits, 62 - ranks.bits
    ids, none = F.lit((1 << bits) - 1), F.lit((1 << bits) - 1).cast("long")
    low, offset = F.lit((1 << high) - 1), F.lit((1 << high) - (1 << bits))

    def key(a: Column, b: Column) -> Column:
        return F.shiftleft(a, bits) + b + 1

    def rank(k: Column) -> Column:
        """Where the slot holds another pair or none, or there is no pair (null), ``none``."""
        shift = F.get(table["shift"], (k * _MIX_GROUP % ranks.groups).cast("int"))
        found = F.get(table["pair"], ((k * _MIX_SLOT + shift) % ranks.slots).cast("int"))
        return F.least(found.bitwiseXOR(F.shiftleft(k, bits)), none)

    def merge(s: Column, _: Column) -> Column:
        def at(least: Column) -> Column:
            new, here = F.shiftright(least, high), least.bitwiseAND(offset)

            def joined(i: Column) -> Column:
                before, after = F.get(s, i - 1), F.get(s, i + 2)
                own = F.shiftleft(rank(key(new, after.bitwiseAND(ids))), high).bitwiseOR(here).bitwiseOR(new)
                left = F.shiftleft(rank(key(before.bitwiseAND(ids), new)), high).bitwiseOR(before.bitwiseAND(low))
                rest = F.slice(s, i + 3, F.size(s))
                return F.flatten(F.when(i > 0, F.array(F.slice(s, F.lit(1), i - 1), F.array(left, own), rest)).otherwise(F.array(F.array(own), rest)))

            # its index is the number of smaller offsets; array_position leaves its loop by an exception, which is slow in short words
            short = F.size(F.filter(s, lambda x: x.bitwiseAND(offset) < here))
            index = F.when(F.size(s) <= 64, short).otherwise(F.array_position(s, least).cast("int") - 1)
            return F.when(new == none, s).otherwise(_let(index, joined))

        return _let(F.array_min(s), at)

    def by_merges(c: Column) -> Column:
        first = F.transform(c, lambda x, i: F.shiftleft(rank(key(x, F.get(c, i + 1))), high).bitwiseOR(F.shiftleft(i.cast("long"), bits)).bitwiseOR(x))
        return F.aggregate(F.slice(c, F.lit(2), F.size(c)), first, merge, lambda s: F.transform(s, lambda x: x.bitwiseAND(ids).cast("int")))

    def of(chars: Column) -> Column:
        singles = F.transform(F.split(chars, ""), lambda x: F.get(table["single"], F.ascii(x)))
        if not ranks.whole:
            return _let(singles, by_merges)
        known = F.from_json(F.lit(json.dumps(ranks.whole)), "map<string,int>")
        return _let(F.try_element_at(known, chars), lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(_let(singles, by_merges)))

    return _let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), of)


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word: least rank first, leftmost first, by a heap over linked pieces."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if end[i] < 0 or (j := after[i]) >= n or end[j] != stop:
            continue  # one of the two pieces has been merged since
        end[i], end[j], after[i] = stop, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[word[i : end[i]]] for i in range(n) if end[i] > 0]


class Units(NamedTuple):
    """Documents as runs of units: document d is ``codes[stops[d]:stops[d + 1]]``, unit u the words at ``places[parts[u]:parts[u + 1]]``."""

    words: pa.LargeStringArray  # distinct, in the order of their hashes
    hashes: np.ndarray
    places: np.ndarray
    parts: np.ndarray
    codes: np.ndarray
    stops: np.ndarray


def units(texts: pa.Array, pattern: str) -> Units:
    """The units and the words of ``texts``.

    Under ``BY_SPACE`` no word goes beyond the space after it unless that space is part of a longer run, so units are
    what single spaces part, with the space before them. A text in which a space is part of a longer run of white space
    is parted where it can be; under other patterns a text is one unit.
    """
    find = regex.compile(pattern).findall
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n, found, counts, whole, odd = len(texts), [], [], {}, range(len(texts))
    codes, stops, known = np.empty(0, np.int64), np.zeros(n + 1, np.int64), 0
    if pattern == BY_SPACE and n:
        lists = pc.split_pattern(texts, " ")
        stops = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.values.dictionary_encode()
        codes, names = pieces.indices.to_numpy().astype(np.int64), pieces.dictionary.to_pylist()
        plain = np.array([bool(p) and not p[0].isspace() and not p[-1].isspace() for p in names], bool)
        odd = np.unique(np.searchsorted(stops, np.flatnonzero(~plain[codes]), "right") - 1).tolist()
        if plain.any():
            found = find(" " + " ".join([p for p, ok in zip(names, plain.tolist(), strict=True) if ok]))
            begin = np.flatnonzero(np.fromiter((w[0] == " " for w in found), bool, len(found)))
            each = np.zeros(len(names), np.int64)
            each[plain] = np.diff(np.append(begin, len(found)))
            counts = each.tolist()
        # a document's first piece has no space before it
        first, codes[stops[:-1]] = np.unique(codes[stops[:-1]], return_inverse=True)
        for p in first.tolist():
            own = find(names[p]) if plain[p] else []
            found += own
            counts.append(len(own))
        codes[stops[:-1]] += len(names)
        known = len(counts)
    if len(odd):
        runs, last = [], 0
        for d in odd:
            text = texts[d].as_py()
            keys = [text]
            if pattern == BY_SPACE:
                head, *others = _SAFE.split(text)
                keys = [head, *[" " + x for x in others]]
            runs += [codes[stops[last] : stops[d]], np.array([known + whole.setdefault(k, len(whole)) for k in keys], np.int64)]
            last = d + 1
        sizes = np.diff(stops)
        sizes[list(odd)] = [len(r) for r in runs[1::2]]
        codes = np.concatenate([*runs, codes[stops[last] : stops[n]]])
        stops = np.append(0, np.cumsum(sizes))
        for k in whole:
            own = find(k)
            found += own
            counts.append(len(own))
    coded = pa.array(found, pa.large_string()).dictionary_encode()
    words = coded.dictionary
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.empty(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    if (hashes[order[1:]] == hashes[order[:-1]]).any():
        order = np.array(sorted(range(len(words)), key=lambda i: (hashes[i], words[i].as_py())))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Units(words.take(pa.array(order)), hashes[order], place[coded.indices.to_numpy()], np.append(0, np.cumsum(counts, dtype=np.int64)), codes, stops)


def _bytes(offsets: np.ndarray, data) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), data if isinstance(data, pa.Buffer) else pa.py_buffer(data)])


def _layout(array: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a large binary or string array that starts at its buffers' start."""
    if not len(array):
        return np.zeros(1, np.int64), memoryview(b"")
    _, offsets, data = array.buffers()
    return np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1], memoryview(data or b"")


def pack(lengths: np.ndarray, data) -> bytes:
    """Items of given lengths as one blob: their number, lengths under 255 in a byte each, the others, the data."""
    return b"".join([np.uint32(len(lengths)).tobytes(), np.minimum(lengths, 255).astype("u1").tobytes(), lengths[lengths >= 255].astype("<u8").tobytes(), data])


def unpack(blob: bytes) -> tuple[np.ndarray, memoryview]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    lengths = np.frombuffer(blob, "u1", n, 4).astype(np.int64)
    large = np.flatnonzero(lengths == 255)
    lengths[large] = np.frombuffer(blob, "<u8", len(large), 4 + n)
    return lengths, memoryview(blob)[4 + n + 8 * len(large) :]


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Lengths and data of several blobs as of one."""
    parts = [unpack(b) for b in blobs]
    return np.concatenate([p[0] for p in parts] or [np.empty(0, np.int64)]), b"".join([p[1] for p in parts])


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(lengths, dtype=np.int64))


def _large(texts: pa.ChunkedArray) -> pa.Array:
    opened = zstandard.ZstdDecompressor().decompress
    return pa.array([opened(x.as_py()) if x.is_valid else b"" for x in texts], pa.large_binary()).cast(pa.large_string())


def _coded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str, keep: tuple[str, ...], make: Callable, more: str, small: bool = False) -> DataFrame:
    """``keep`` columns, and ``more`` columns that ``make`` makes of the ids of some documents (offsets, packed ids)."""
    spark = docs.sparkSession
    literal, shared = rank_map(spark, ranks), spark.sparkContext.broadcast(ranks)  # a vocabulary, a parameter
    release()
    narrow = max(ranks.values()) < 1 << 16
    small_batches(spark)
    short_plans(spark)
    total = text_bytes(docs, text)
    chunks, buckets = (max(2 * spark.sparkContext.defaultParallelism, -(-total // each)) for each in ((SMALL, SMALL) if small else (CHUNK, BUCKET)))
    names = list(keep)
    kept = docs.select(*names, F.col(text).alias("_text"))
    kinds = "".join(f"`{n}` {t}, " for n, t in kept.dtypes[:-1])
    plain = [F.col(f"`{n}`") for n, t in kept.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    dealt = kept.withColumn("_chunk", F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.lit(chunks)))
    dealt = dealt.select(*names, "_chunk", "_text").mapInArrow(lean(squeezed), f"{kinds}_chunk long, _text binary").repartition(chunks, "_chunk")

    def sent(table: pa.Table) -> pa.Table:
        found = units(_large(table["_text"]), pattern)
        bucket = ((found.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        offsets, data = _layout(found.words)
        lengths, own = np.diff(offsets), np.unique(bucket)
        low, high = np.searchsorted(bucket, own, "left").tolist(), np.searchsorted(bucket, own, "right").tolist()
        blobs = [pack(lengths[a:b], data[offsets[a] : offsets[b]]) for a, b in zip(low, high, strict=True)]
        return pa.table({"bucket": pa.array(own, pa.int64()), "chunk": pa.array([table["_chunk"][0].as_py()] * len(own), pa.int64()), "words": pa.array(blobs, pa.binary())})

    def distinct(table: pa.Table) -> pa.Table:
        """Rows of words to fold, then the ids of each long word, then each chunk's references to those in that order."""
        lengths, data = _joined(table["words"].to_pylist())
        each = [int(np.frombuffer(b.as_py()[:4], "<u4")[0]) for b in table["words"]]
        coded = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(_offsets(lengths)), pa.py_buffer(data)).dictionary_encode()
        words = coded.dictionary
        size = pc.binary_length(words).to_numpy()
        order = np.argsort(size > FOLDED, kind="stable")
        place = np.empty(len(order), "<i4")
        place[order] = np.arange(len(order))
        words, folded, known = words.take(pa.array(order)), int((size <= FOLDED).sum()), shared.value
        refs, at = place[coded.indices.to_numpy()], _offsets(np.array(each, np.int64))
        rows = [words[k : min(k + ROW_WORDS, folded)].to_pylist() for k in range(0, folded, ROW_WORDS)]
        given = [np.array(merged_long(w.as_py().encode(), known), "<u4").tobytes() for w in words[folded:]]
        r, g, c = len(rows), len(given), len(each)
        return pa.table({
            "bucket": pa.array([table["bucket"][0].as_py()] * (r + g + c), pa.int64()),
            "words": pa.array([*rows, *[None] * (g + c)], pa.list_(pa.string())),
            "given": pa.array([*[None] * r, *given, *[None] * c], pa.binary()),
            "row": pa.array(range(r + g + c), pa.int64()),
            "chunk": pa.array([*[None] * (r + g), *table["chunk"].to_pylist()], pa.int64()),
            "refs": pa.array([*[None] * (r + g), *[refs[at[i] : at[i + 1]].tobytes() for i in range(c)]], pa.binary()),
        })

    kind = "<u2" if narrow else "<u4"

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lengths, ids, folded = None, [], [], None
        for b in batches:
            out = []
            for i in range(b.num_rows):
                bucket, words, given, chunk, refs = (c[i] for c in b.columns)
                if bucket.as_py() != now:
                    now, lengths, ids, folded = bucket.as_py(), [], [], None
                if words.is_valid:
                    v = words.values
                    lengths.append(pc.list_value_length(v).to_numpy())
                    ids.append(v.flatten().to_numpy().astype(kind))
                elif given.is_valid:
                    ids.append(np.frombuffer(given.as_py(), "<u4").astype(kind))
                    lengths.append(np.array([len(ids[-1])]))
                else:
                    if folded is None:
                        folded = _bytes(_offsets(np.concatenate(lengths)) * np.dtype(kind).itemsize, np.concatenate(ids).tobytes())
                    offsets, data = _layout(folded.take(pa.array(np.frombuffer(refs.as_py(), "<i4"))))
                    out.append((chunk.as_py(), now, pack(np.diff(offsets) // np.dtype(kind).itemsize, data[: offsets[-1]])))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["_chunk", "bucket", "ids"])

    def assembled(table: pa.Table, words: pa.Table) -> pa.Table:
        found = units(_large(table["_text"]), pattern)
        table = table.select(names)
        lengths, data = _joined(words.sort_by("bucket")["ids"].to_pylist())
        if len(lengths) != len(found.words):
            raise ValueError("the words of a chunk are not those that its buckets had")
        word = _bytes(_offsets(lengths) * 4, np.frombuffer(data, kind).astype("<u4").tobytes())
        offsets, data = _layout(word.take(pa.array(found.places)))
        unit = _bytes(offsets[found.parts], pa.py_buffer(data))
        out, first, n = [], 0, len(table)
        while first < n:
            last = max(first + 1, int(np.searchsorted(found.stops, found.stops[first] + STEP, "right")) - 1)
            at = found.stops[first : last + 1]
            offsets, data = _layout(unit.take(pa.array(found.codes[at[0] : at[-1]])))
            made = make(offsets[at - at[0]], data)
            part = table.slice(first, last - first).combine_chunks()
            out.append(pa.table([*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns], *made], [*names, *more_names]))
            first = last
        return pa.concat_tables(out)

    more_names = [x.split()[0] for x in more.split(", ")]
    words = dealt.groupBy("_chunk").applyInArrow(lean_group(sent), "bucket long, chunk long, words binary")
    folds = words.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lean_group(distinct), "bucket long, words array<string>, given binary, row long, chunk long, refs binary")
    folds = folds.withColumn("_ranks", literal.table)  # functions of higher order take no subquery themselves
    folds = folds.select("bucket", fold(F.col("words"), literal._replace(table=F.col("_ranks"))).alias("words"), "given", "row", "chunk", "refs")
    if small:
        folds = folds.repartition(buckets, "bucket").sortWithinPartitions("bucket", "row")
    folds = folds.drop("row")
    ids = folds.mapInArrow(lean(back), "_chunk long, bucket long, ids binary")

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        out = assembled(left, right)
        release()
        return out

    return dealt.groupBy("_chunk").cogroup(ids.groupBy("_chunk")).applyInArrow(both, f"{kinds}{more}")


def _decoded(ids: memoryview, offsets: np.ndarray, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, memoryview]:
    """The concatenated pieces of packed ids: where each document's ids end, and the bytes."""
    at, data = _layout(pieces.take(pa.array(np.frombuffer(ids, "<u4"))))
    return at[offsets // 4], data


def _pieces(ranks: dict[bytes, int]) -> pa.LargeBinaryArray:
    table = [b""] * (max(ranks.values()) + 1)
    for b, r in ranks.items():
        table[r] = b
    return pa.array(table, pa.large_binary())


def _cut(offsets: np.ndarray, data: memoryview) -> list[memoryview]:
    at = offsets.tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


def _binary(offsets: np.ndarray, data: memoryview) -> pa.Array:
    return pa.array([bytes(x) for x in _cut(offsets, data)], pa.binary())


def _made(ranks, digest: bool) -> tuple[Callable, str]:
    """What is made of ids: them and the decoded bytes, or the digests that the query returns."""
    held: list[pa.LargeBinaryArray] = []

    def make(offsets: np.ndarray, data: memoryview) -> list[pa.Array]:
        if not held:
            held.append(_pieces(ranks.value))
        at, text = _decoded(data[offsets[0] : offsets[-1]], offsets - offsets[0], held[0])
        if not digest:
            return [_binary(offsets, data), _binary(at, text)]
        sha = [pa.array([hashlib.sha256(x).hexdigest() for x in _cut(*y)], pa.string()) for y in ((offsets, data), (at, text))]
        return [pa.array(np.diff(offsets) // 4, pa.int64()), *sha]

    return make, "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` (binary, little-endian unsigned 32-bit ids of the whole text), one row per row."""
    return _coded(docs, ranks, pattern, text, keep, lambda offsets, data: [_binary(offsets, data)], "ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], digest: bool = False) -> DataFrame:
    """Add ``decoded``: the concatenated pieces (binary); with ``digest`` the digests that the query returns instead of both. Null ids are none."""
    names = [c for c in encoded.columns if c != "ids"]
    kept = encoded.select(*names, "ids")
    make, more = _made(encoded.sparkSession.sparkContext.broadcast(ranks), digest)
    more_names = [x.split()[0] for x in more.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                c = b.slice(k, 256)
                ids = [x.as_py() or b"" for x in c.column(len(names))]
                made = make(_offsets(np.array([len(x) for x in ids], np.int64)), memoryview(b"".join(ids)))
                yield pa.RecordBatch.from_arrays([*c.columns[:-1], *made], [*names, *more_names])

    return kept.mapInArrow(lean(run), "".join(f"`{n}` {t}, " for n, t in kept.dtypes[:-1]) + more)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",), digest: bool = False, small: bool = False) -> DataFrame:
    """``decode`` of ``encode``, both in one Python step, so that ids travel once.

    ``small``: less memory for more shuffle. Chunks and buckets are smaller, and an exchange after the fold leaves no
    task with two Python workers. The rows are the same.
    """
    make, more = _made(docs.sparkSession.sparkContext.broadcast(ranks), digest)
    return _coded(docs, ranks, pattern, "text", keep, make, more, small)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_and_decode(docs, ranks, public_tokenizers.PATTERN, digest=True)
