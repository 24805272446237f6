"""Operator 10: removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id. Equal strings are
brought together before they are sorted: every string of that length has an anchor, the ``GRAM``-byte piece with the
least hash in it, which depends on its bytes alone. So

1. tasks send the hashes of their anchors, packed, a row per bucket; those that occur twice are put into a Bloom filter
   of fixed size, in which each bucket owns a segment (very frequent ones into a second);
2. around each anchor found there, the context that holds all strings with this anchor goes to the anchor's bucket,
   once per task if contexts are equal; a bucket sorts the suffixes of its contexts by the difference-cover algorithm
   (sampled triples are sorted and named, the names are sorted recursively, the remaining suffixes are merged in) and
   compares adjacent prefixes;
3. contexts of very frequent anchors (a passage of a third of all documents) would meet in one bucket, so their strings
   go by their own hash instead, once per task;
4. the covered ranges meet per document and are cut out.

Texts are UTF-8 bytes, null is empty; matches never cross documents; whole texts are read. Of documents with equal
ids none is smaller, so they do not cover each other, and each text of an id has its own ranges: a text is told apart
by a tag, a hash of it (64 bits of a null id's, TAG_BITS of another's). A null id is larger than all others. Extra columns are ignored
by ``spans`` and kept by ``cut``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import lean, lean_group, partitions, release, small_batches, squeezed
from .shingles import mix

GRAM, PIECE, HELD = 24, 1 << 18, 1 << 19
#: Bits of the filters of repeated and of frequent anchors; occurrences that make an anchor frequent.
SHARED_BITS, HOT_BITS, HOT = 1 << 26, 1 << 22, 1024
#: Contexts that are sorted together, beyond those of one anchor.
SORTED = 1 << 13
_U = np.uint64
_NULL_ID = np.iinfo(np.int64).max
#: A place is the offset in a text (31 bits), its tag, and whether its id is null, when the document's number is its tag.
TAG_BITS = 23
_TAG, _BLANK = 31, 31 + TAG_BITS
_KIND = "kind int, bucket int, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["kind", "bucket", "a", "b", "c", "d", "e"]


class Roller:
    """Hashes of substrings from one running sum: random byte values times powers of an odd base."""

    def __init__(self, size: int):
        self.values = np.random.default_rng(977).integers(1, 1 << 63, 256, np.uint64)
        power = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
        base = 0xD1342543DE82EF95
        self.powers, self.inverse = power(base), power(pow(base, -1, 1 << 64))

    def sums(self, a: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[a] * self.powers[: len(a)])])

    def hash(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Least (or greatest) of every ``width`` adjacent values, by doubling."""
    n = 1
    while 2 * n <= width:
        x, n = best(x[:-n], x[n:]), 2 * n
    return best(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def segments(texts: list[bytes], margin: int) -> Iterator[tuple[list[int], list[int], list[int], list[int], bytes]]:
    """Texts in groups of about PIECE bytes, long ones cut with overlapping margins: for each piece its text's place, its
    offset in the text and the core that it answers for; then the group's bytes."""
    group: list[tuple[int, int, int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t)), PIECE):
            lo, hi = max(0, s - margin), min(len(t), s + PIECE + margin)
            if held and held + hi - lo > PIECE:
                yield tuple(map(list, zip(*group, strict=True)))
                group, held = [], 0
            group.append((i, lo, s, min(len(t), s + PIECE), t[lo:hi]))
            held += hi - lo
    if group:
        yield tuple(map(list, zip(*group, strict=True)))


class Anchors:
    """The anchors of a group of pieces: place in the group, hash, and the bounds of the text there."""

    def __init__(self, roller: Roller, group: tuple, length: int):
        self.text, offset, core_from, core_to, parts = group
        data = b"".join(parts)
        self.bytes = np.frombuffer(data, np.uint8)
        size = np.array([len(p) for p in parts])
        end = np.cumsum(size)
        begin = end - size
        self.sums = roller.sums(self.bytes)
        width = length - GRAM + 1
        n = len(data) - GRAM + 1
        if len(data) < length:
            self.at = np.zeros(0, np.int64)
        else:
            h = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * roller.inverse[:n])
            least = sliding(h, width, np.minimum)
            for e in end.tolist():
                least[max(0, e - length + 1) : e] = 0  # these strings would cross texts
            pad = np.zeros(width - 1, np.uint64)
            self.at = np.flatnonzero((sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h) & (h != 0))
            self.hash = h[self.at]
        piece = np.searchsorted(end, self.at, "right")
        self.begin, self.end, self.shift = begin[piece], end[piece], np.array(offset)[piece] - begin[piece]
        self.of = np.array(self.text)[piece]
        own = self.at + self.shift
        kept = (own >= np.array(core_from)[piece]) & (own < np.array(core_to)[piece])
        for k in ("at", "begin", "end", "shift", "of"):
            setattr(self, k, getattr(self, k)[kept])
        self.hash = self.hash[kept] if len(kept) else np.zeros(0, np.uint64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(40)) % _U(buckets)).astype(np.int64)


def bits_of(h: np.ndarray, where: np.ndarray, own: int) -> list[np.ndarray]:
    """Two bit numbers of each hash (its low 40 bits), within its bucket's segment of ``own`` bits."""
    g = mix((h & _U((1 << 40) - 1)) + _U(0xA0761D6478BD642F))
    return [where * own + (x % _U(own)).astype(np.int64) for x in (g & _U(0xFFFFFFFF), g >> _U(32))]


def has(bits: np.ndarray, h: np.ndarray, buckets: int, total: int) -> np.ndarray:
    x, y = bits_of(h, bucket_of(h, buckets), total // buckets // 8 * 8)
    read = lambda i: bits[i >> 3] >> (i & 7).astype(np.uint8) & 1
    return (read(x) & read(y)).astype(bool)


def _rows(kind: int, buckets: int, where: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket, with its items of each column packed and compressed."""
    squeeze = zstandard.ZstdCompressor(1).compress
    order = np.argsort(where, kind="stable")
    cut = np.searchsorted(where[order], np.arange(buckets + 1))
    for k in range(0, buckets, 32):
        own = [i for i in range(k, min(buckets, k + 32)) if cut[i] < cut[i + 1]]
        if own:
            packed = [pa.array([squeeze(c[order[cut[i] : cut[i + 1]]].tobytes()) for i in own], pa.binary()) for c in columns]
            packed += [pa.array([b""] * len(own), pa.binary())] * (5 - len(columns))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own), pa.int32()), pa.array(own, pa.int32()), *packed], _NAMES)


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor().decompress
    return np.frombuffer(b"".join(open_(x.as_py()) for x in table.column(name)), kind)


def tag() -> Column:
    """What tells apart the texts of one id."""
    h = F.xxhash64("text")
    return F.when(F.col("doc_id").isNull(), h).otherwise(h.bitwiseAND(F.lit((1 << TAG_BITS) - 1)))


def ordered(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The documents' ids, for comparison: null ones are equal, and larger than others."""
    return np.where(place >> _BLANK & 1, _NULL_ID, doc)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Documents' numbers, what goes on top of the offsets to make places, and texts."""
    for b in batches:
        for k in range(0, b.num_rows, 512):
            c = b.slice(k, 512)
            tags = c.column(2).to_pylist()
            ids = np.array([t if i is None else i for i, t in zip(c.column(0).to_pylist(), tags, strict=True)], np.int64)
            top = np.array([1 << _BLANK if i is None else t << _TAG for i, t in zip(c.column(0).to_pylist(), tags, strict=True)], np.int64)
            yield ids, top, [(t.as_py() or "").encode("utf-8", "replace") for t in c.column(1)]


def shared_anchors(docs: DataFrame, length: int, buckets: int, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The filters of repeated and of frequent anchors, as bytes of fixed size."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, held, n = Roller(PIECE + 4 * length), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            low = h.view(np.uint8).reshape(-1, 8)[:, :5]  # 40 bits beside the bucket
            yield from _rows(0, buckets, bucket_of(h, buckets), np.ascontiguousarray(low), np.minimum(times, 255).astype(np.uint8))

        for _, _, texts in _texts(batches):
            for group in segments(texts, 2 * length):
                held.append(Anchors(roller, group, length).hash)
                n += len(held[-1])
                if n > 2 * HELD:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        low, times = _column(table, "a", np.uint8).reshape(-1, 5), _column(table, "b", np.uint8)
        h = np.zeros((len(low), 8), np.uint8)
        h[:, :5] = low
        h = h.view(np.uint64).ravel()
        order = np.argsort(h, kind="stable")
        h, times = h[order], times[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.add.reduceat(times.astype(np.int64), head)
        out = []
        for bits, least in ((SHARED_BITS, 2), (HOT_BITS, hot)):
            own = bits // buckets // 8 * 8
            marks = np.zeros(own, np.uint8)
            for at in bits_of(h[head[total >= least]], np.zeros(1, np.int64), own):
                marks[at] = 1
            out.append(np.packbits(marks, bitorder="little").tobytes())
        return pa.table({"bucket": table.column("bucket")[:1].cast(pa.int32()), "shared": pa.array([out[0]], pa.binary()), "hot": pa.array([out[1]], pa.binary())})

    sent = docs.select("doc_id", "text", tag()).mapInArrow(lean(send), _KIND).select("bucket", "a", "b")
    rows = sent.groupBy("bucket").applyInArrow(lean_group(meet), "bucket int, shared binary, hot binary").toArrow().to_pylist()
    out = []
    for name, bits in (("shared", SHARED_BITS), ("hot", HOT_BITS)):
        own = bits // buckets // 8
        whole = np.zeros(own * buckets, np.uint8)
        for r in rows:
            whole[r["bucket"] * own : (r["bucket"] + 1) * own] = np.frombuffer(r[name], np.uint8)
        out.append(whole)
    return out[0], out[1]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` (values of 1 or more) in order, by the difference cover {1, 2} mod 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(4, np.int64)])
    i1 = np.arange(1, n + (n % 3 == 1), 3)
    i2 = np.arange(2, n, 3)
    sample = np.concatenate([i1, i2])
    k = int(t.max()) + 1
    pair = t[:-1] * k + t[1:]
    if k * k * k < 1 << 62:
        triple = pair[sample] * k + t[sample + 2]
    else:
        triple = np.unique(pair, return_inverse=True)[1][sample] * k + t[sample + 2]
    names, name = np.unique(triple, return_inverse=True)
    order = np.argsort(name, kind="stable") if len(names) == len(name) else suffix_array(name + 1)
    sample_order = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sample_order] = np.arange(1, len(sample) + 1)
    top = len(sample) + 2
    i0 = np.arange(0, n, 3)
    i0 = i0[np.argsort(t[i0] * top + rank[i0 + 1], kind="stable")]
    twos = np.unique(pair, return_inverse=True)[1]
    if n % 3 == 1:  # the added empty sample suffix comes first
        sample_order = sample_order[1:]
    is1 = sample_order % 3 == 1
    s1, s2 = sample_order[is1], sample_order[~is1]
    before = np.searchsorted(t[s1] * top + rank[s1 + 1], t[i0] * top + rank[i0 + 1])
    before += np.searchsorted(twos[s2] * top + rank[s2 + 2], twos[i0] * top + rank[i0 + 2])
    out = np.empty(n, np.int64)
    at0 = before + np.arange(len(i0))
    rest = np.ones(n, bool)
    rest[at0] = False
    out[at0], out[rest] = i0, sample_order
    return out


def covered_by_suffixes(context: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the strings in the contexts (rows of a matrix, with their sizes) that a smaller document has as well."""
    full = context.shape[1]
    inside = np.arange(full)[None, :] < size[:, None]
    text = np.where(inside, context.astype(np.int64) + 2, 0)
    text = np.concatenate([text, np.zeros((len(text), 1), np.int64)], 1)
    use = np.concatenate([inside, np.ones((len(text), 1), bool)], 1)
    flat = np.where(text == 0, 1, text)[use]
    row = np.broadcast_to(np.arange(len(text))[:, None], use.shape)[use]
    off = np.broadcast_to(np.arange(full + 1)[None, :], use.shape)[use]
    order = suffix_array(flat)
    order = order[off[order] + length <= size[row[order]]]
    if not len(order):
        return order, order
    same = np.ones(len(order) - 1, bool)
    for k in range(length):  # adjacent prefixes; those that differ already are not looked at again
        live = np.flatnonzero(same)
        same[live] = flat[order[live] + k] == flat[order[live + 1] + k]
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(doc[row[order]], head)
    run = np.cumsum(np.concatenate([[0], ~same]))
    late = order[doc[row[order]] > least[run]]
    return row[late], off[late]


def _firsts(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the smallest document of each key, and rows of the others."""
    order = np.lexsort((doc, *keys))
    head = np.zeros(len(doc), bool)
    head[:1] = True
    for k in keys:
        head[1:] |= k[order][1:] != k[order][:-1]
    least = doc[order][np.flatnonzero(head)][np.cumsum(head) - 1]
    first = doc[order] == least
    return order[first], order[~first]


def spans(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """(doc_id, tag, starts, ends): the ranges to remove, packed 64-bit integers in order, for every document that has some."""
    spark = docs.sparkSession
    buckets = 6 * partitions(spark)
    small_batches(spark)
    # ranges go to fewer buckets, as each of the others may have some for each of these
    meeting = max(8, buckets // 24)
    filters = spark.sparkContext.broadcast(shared_anchors(docs, length, buckets, hot))
    release()
    width, full = length - GRAM + 1, 2 * length - GRAM

    def covers(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Ranges, those of a document joined where they overlap, to the documents' buckets."""
        if len(doc):
            doc, start, end = joined(doc, start, end)
            yield from _rows(2, meeting, bucket_of(mix(doc.view(np.uint64)), meeting), end, doc, start)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(PIECE + 4 * length)
        shared, hot = filters.value
        held: list[tuple] = []
        windows: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, c, doc, start, size, context = (np.concatenate(x) for x in zip(*held, strict=True))
                first, late = _firsts((c, h), ordered(doc, start))  # by anchor, so that like contexts are compressed together
                yield from covers(doc[late], start[late], start[late] + size[late])
                yield from _rows(0, buckets, bucket_of(h[first], buckets), h[first], c[first], doc[first], start[first] << 8 | size[first], context[first])
            if windows:
                h, doc, start = (np.concatenate(x) for x in zip(*windows, strict=True))
                _, one = np.unique(np.stack([doc, start], 1), axis=0, return_index=True)
                h, doc, start = h[one], doc[one], start[one]
                first, late = _firsts((h,), ordered(doc, start))
                yield from covers(doc[late], start[late], start[late] + length)
                yield from _rows(1, buckets, bucket_of(h[first], buckets), h[first], doc[first], start[first])
            held.clear(), windows.clear()

        for ids, top, texts in _texts(batches):
            for group in segments(texts, 2 * length):
                x = Anchors(roller, group, length)
                on = has(shared, x.hash, buckets, SHARED_BITS)
                at, h, lo, hi, shift, doc = x.at[on], x.hash[on], x.begin[on], x.end[on], x.shift[on] + top[x.of[on]], ids[x.of[on]]
                start, end = np.maximum(lo, at - width + 1), np.minimum(hi, at + length)
                often = has(hot, h, buckets, HOT_BITS)
                cold = ~often
                s, e = start[cold], end[cold]
                place = s[:, None] + np.arange(full)
                context = np.where(place < e[:, None], x.bytes[np.minimum(place, len(x.bytes) - 1)], 0).astype(np.uint8)
                held.append((h[cold], (roller.hash(x.sums, s, e) + (at[cold] - s).astype(np.uint64)).astype(np.uint32), doc[cold], s + shift[cold], e - s, context))
                for j in range(width):
                    w = at[often] - j
                    ok = (w >= lo[often]) & (w + length <= hi[often])
                    if ok.any():
                        windows.append((roller.hash(x.sums, w[ok], w[ok] + length), doc[often][ok], w[ok] + shift[often][ok]))
                n += len(at) + 4 * int(often.sum())
                if n > HELD // 4:
                    yield from flush()
                    n = 0
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        if kind == 2:
            doc, start, end = _column(table, "b", np.int64), _column(table, "c", np.int64), _column(table, "a", np.int64)
        elif kind == 1:
            h, doc, start = _column(table, "a", np.uint64), _column(table, "b", np.int64), _column(table, "c", np.int64)
            _, late = _firsts((h,), ordered(doc, start))
            doc, start, end = doc[late], start[late], start[late] + length
        else:
            h, c, doc, figures = _column(table, "a", np.uint64), _column(table, "b", np.uint32), _column(table, "c", np.int64), _column(table, "d", np.int64)
            start, size, context = figures >> 8, figures & 255, _column(table, "e", np.uint8).reshape(-1, full)
            first, late = _firsts((h, c), ordered(doc, start))
            found = [(doc[late], start[late], start[late] + size[late])]
            # anchors with one context are done; of the others, contexts with a string that occurs twice are sorted
            order = first[np.lexsort((c[first], h[first]))]
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            kinds = np.add.reduceat(np.concatenate([[1], (c[order][1:] != c[order][:-1]) | new[1:]]).astype(np.int64), np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
            left = order[(kinds > 1)[np.cumsum(new) - 1]] if len(order) else order
            # strings of different anchors differ, so some anchors at a time are sorted
            ends = np.flatnonzero(np.concatenate([h[left][1:] != h[left][:-1], [True]])) + 1 if len(left) else left
            at = 0
            while at < len(left):
                stop = int(ends[min(np.searchsorted(ends, at + SORTED), len(ends) - 1)])
                part = left[at:stop]
                found += _within(context[part], size[part], doc[part], start[part], length)
                at = stop
            doc, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        batches = list(covers(doc, start, end))
        return pa.Table.from_batches(batches, _SCHEMA) if batches else _SCHEMA.empty_table()

    def per_document(table: pa.Table) -> pa.Table:
        doc, start, end = joined(_column(table, "b", np.int64), _column(table, "c", np.int64), _column(table, "a", np.int64))
        top = start >> _TAG
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (top[1:] != top[:-1])]))
        parts = [np.split(x - (top << _TAG), head[1:]) for x in (start, end)]
        null = (top[head] >> TAG_BITS & 1).astype(bool)
        return pa.table({"doc_id": pa.array(doc[head], pa.int64(), mask=null), "tag": pa.array(np.where(null, doc[head], top[head]), pa.int64()), "starts": pa.array([x.tobytes() for x in parts[0]], pa.binary()), "ends": pa.array([x.tobytes() for x in parts[1]], pa.binary())})

    ranges = docs.select("doc_id", "text", tag()).mapInArrow(lean(send), _KIND).groupBy("kind", "bucket").applyInArrow(lean_group(meet), _KIND)
    return ranges.select("bucket", "a", "b", "c").groupBy("bucket").applyInArrow(lean_group(per_document), "doc_id long, tag long, starts binary, ends binary")


_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in "abcde")])


def _within(context: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> list[tuple]:
    """Covered ranges of documents' contexts, each a row of the matrix.

    What of a context recurs is found by hash; equal stretches of that kind are merged into the smallest document's;
    the suffixes of those that still share a string are sorted, and adjacent prefixes compared.
    """
    if not len(context):
        return []
    roller = Roller(context.shape[1])
    sums = np.zeros((len(context), context.shape[1] + 1), np.uint64)
    np.cumsum(roller.values[context] * roller.powers[: context.shape[1]], axis=1, out=sums[:, 1:])
    n = context.shape[1] - length + 1
    h = mix((sums[:, length:] - sums[:, :n]) * roller.inverse[:n])
    ok = np.arange(n)[None, :] + length <= size[:, None]
    _, name, times = np.unique(h[ok], return_inverse=True, return_counts=True)
    again = np.zeros((len(h), n + 2), np.int8)
    again[:, 1:-1][ok] = times[name] > 1
    row, lo = np.nonzero(np.diff(again, axis=1) == 1)
    hi = np.nonzero(np.diff(again, axis=1) == -1)[1] - 1 + length
    whole = mix((sums[row, hi] - sums[row, lo]) * roller.inverse[lo] + (hi - lo).astype(np.uint64))
    ids = ordered(doc, start)
    first, late = _firsts((whole,), ids[row])
    found = [(doc[row[late]], start[row[late]] + lo[late], start[row[late]] + hi[late])]
    # of one document's equal stretches one is enough to be compared, and all share its answer
    row, lo, hi, whole = row[first], lo[first], hi[first], whole[first]
    _, one, of = np.unique(whole, return_index=True, return_inverse=True)
    many = hi[one] - lo[one] - length + 1
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    _, name, times = np.unique(h[np.repeat(row[one], many), np.repeat(lo[one], many) + at], return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(np.bincount(np.repeat(np.arange(len(one)), many), times[name] > 1, len(one)))
    if len(open_):
        x = one[open_]
        place = lo[x][:, None] + np.arange(context.shape[1])
        part = np.where(place < hi[x][:, None], context[row[x][:, None], np.minimum(place, context.shape[1] - 1)], 0).astype(np.uint8)
        r, off = covered_by_suffixes(part, hi[x] - lo[x], ids[row[x]], length)
        # each answer holds for all places of that document's stretch
        by = np.argsort(of, kind="stable")
        cut_ = np.searchsorted(of[by], np.arange(len(one) + 1))
        each = cut_[open_[r] + 1] - cut_[open_[r]]
        spot = by[np.repeat(cut_[open_[r]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
        begin = start[row[spot]] + lo[spot] + np.repeat(off, each)
        found.append((doc[row[spot]], begin, begin + length))
    return found


def joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges in order, those of a document that overlap or touch as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if len(doc):
        # a running greatest end within a document: documents are set apart by adding their number times a large step
        top = start >> _TAG
        other = np.concatenate([[False], (doc[1:] != doc[:-1]) | (top[1:] != top[:-1])])
        number, low, high = np.cumsum(other), start - (top << _TAG), end - (top << _TAG)
        step = int(high.max()) + 1
        reach = np.maximum.accumulate(high + number * step)
        new = np.concatenate([[True], low[1:] + number[1:] * step > reach[:-1]]) | other
        head = np.flatnonzero(new)
        doc, start, end = doc[head], start[head], np.maximum.reduceat(end, head)
    return doc, start, end


def _keep(text: bytes, starts: bytes | None, ends: bytes | None) -> tuple[bytes, list[tuple[int, int]]]:
    cut = list(zip(np.frombuffer(starts or b"", np.int64).tolist(), np.frombuffer(ends or b"", np.int64).tolist(), strict=True))
    out, at = [], 0
    for a, b in cut:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), cut


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``found``, where a text has ranges. ``text`` is compressed bytes, so that less is shuffled."""
    found = found.withColumnsRenamed({"doc_id": "_doc", "tag": "_found"})
    own = docs.withColumn("_tag", tag()).select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], "_tag", "text")
    own = own.mapInArrow(lean(squeezed), ", ".join(f"`{n}` {t}" for n, t in own.dtypes[:-1]) + ", text binary")
    return own.join(found, (F.col("_tag") == F.col("_found")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc", "_found", "_tag")


def cut(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``. What the cuts leave of split characters goes as well."""
    found = spans(docs, length).withColumnsRenamed({"starts": "_starts", "ends": "_ends"})
    both = with_spans(docs, found)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts = []
            for t, s, e in zip(b.column(at), b.column(len(names)), b.column(len(names) + 1), strict=True):
                t, s = t.as_py(), s.as_py()
                texts.append(None if t is None else _keep(open_(t), s, e.as_py())[0].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 : len(names)]], names)

    return both.select(*names, "_starts", "_ends").mapInArrow(lean(run), docs.schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = with_spans(docs, spans(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for i, t, s, e in zip(*b.columns, strict=True):
                text = open_(t.as_py()) if t.is_valid else b""
                kept, ranges = _keep(text, s.as_py(), e.as_py())
                out.append((i.as_py(), len(text), len(text) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.select("doc_id", "text", "starts", "ends").mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
