"""The ten operators and the pipeline against brute force, on small tables with nulls, empties, ties and repeated rows."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.llm import byte_bpe, embedding_dedup, jaccard_join, language_id, mixing, suffix_dedup, token_file, top_k, url_filter, warc
from twinlens.llm.common import components

P = pytest.importorskip("public_tokenizers")
RANDOM = random.Random(5)
WORDS = ["".join(RANDOM.choices("abcdeé ", k=RANDOM.randint(2, 6))).strip() or "x" for _ in range(300)]


def text(n: int) -> str:
    return " ".join(RANDOM.choices(WORDS, k=n))


BASE = text(400)
NEAR = BASE.split(" ")
NEAR[200] = "zzz"
TEXTS = [None, "", " \n\t", "a", "a b", "A  B", BASE, BASE, " ".join(NEAR), text(50) + BASE[300:600] + text(50), BASE[300:700], "!" * 300, "=" * 120 + text(5), text(3000), "<|endoftext|> x", "日本語 テキスト 😀", "1234567890" * 12, text(49), text(30) + "    x"] + [text(20) for _ in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "hot", "hot"][i % 5], "extra") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_bpe(docs, none):
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.decode(byte_bpe.encode(docs.drop("ids"), ranks, P.PATTERN), ranks).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        t = TEXTS[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain.encode_ordinary(t)
        assert bytes(r["decoded"]) == t.encode()
    assert byte_bpe.encode(none, ranks, P.PATTERN).count() == 0


def test_bpe_long_words_white_space_and_query(spark, tmp_path):
    """Words on both sides of the fold's bound, one of a megabyte, runs of white space of many kinds, repeated rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    odd = ["a", "Zé", "7", "!", "'s", "'ll", " ", "  ", "\n", "\t ", "\x85", "\xa0", "\u3000", "\x1c", "\0", "日本", "😀"]
    texts = [letters(n) for n in (1023, 1024, 1025, 3000)] + [" ".join(letters(1100) for _ in range(4)), letters(1_000_000), "=" * 5000, None, "", " ", *("".join(rng.choices(odd, k=rng.randrange(40))) for _ in range(400))]
    texts += texts[:40]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "n_tokens": [1] * len(texts)}), f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in byte_bpe.op1_byte_bpe(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = plain.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[0] + rng.normal(size=(60, 16)) * 0.15
    x[200:210] = x[1]
    rows = [(i, v.tolist(), "label") for i, v in enumerate(x)] + [(900, None, "a"), (901, [0.0] * 16, "a"), (902, [1.0, None], "a"), (903, [float("nan")] * 16, "a"), (904, [], "a"), (905, x[0].tolist(), "b"), (906, (2 * x[0]).tolist(), "b")]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    ok = [(i, np.array(v)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, u = [i for i, _ in ok], np.array([v / np.linalg.norm(v) for _, v in ok])
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = embedding_dedup.forest(near)
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"]) == (near[k].sum(), ids[label[k]])
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(900, 905)) and len(got) == len(rows)


def test_mixing(docs, none, spark):
    con = duckdb.connect()
    pdf = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    con.sql("create table documents as select doc_id, text, source from pdf")
    want = {r[0]: r for r in con.sql("select doc_id, size, source_size, target, taken from (" + mixing.OP3_SQL + ")").fetchall()}
    got = mixing.copies(docs).collect()
    for r in got:
        assert (r["doc_id"], r["size"], r["source_size"], r["target"], r["copies"] * r["size"]) == want[r["doc_id"]]
    sizes = {r["source"]: r["source_size"] for r in got}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    goal, left, free = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        for s in list(free):
            goal[s] += share * weight[s]
        left = sum(max(0.0, goal[s] - 3 * sizes[s]) for s in free)
        for s in list(free):
            if goal[s] >= 3 * sizes[s]:
                goal[s] = 3.0 * sizes[s]
                free.discard(s)
    for r in got:
        assert r["target"] == pytest.approx(goal[r["source"]])
    assert mixing.mix(docs).count() == sum(r["copies"] for r in got) and mixing.mix(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(120, 12)), 2)
    x[50:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (250, [float("inf")] * 12), (300, [0.0] * 12), (350, [1.0])]
    got = top_k.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in ints if i % 50 == 0):
        near = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(near, 1)}
    assert {tuple(r) for r in got} == want


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard(docs, none, n, percent):
    sets = {i: shingles(t, n) for i, t in enumerate(TEXTS)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = jaccard_join.join(docs, n, percent).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(s), root[i]) for i, s in sets.items()}
    assert jaccard_join.join(none).count() == 0


def test_jaccard_random_sets():
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        base = np.sort(rng.integers(1, 1 << 63, 200, np.uint64))
        sets = [np.sort(np.unique(np.concatenate([rng.permutation(base)[: 200 - k], rng.integers(1, 1 << 63, k, np.uint64)]))) for k in range(0, 40)]
        for a in sets:
            for b in sets:
                inter = len(np.intersect1d(a, b))
                if 100 * inter >= percent * (len(a) + len(b) - inter):
                    assert len(np.intersect1d(jaccard_join.signatures(a, percent), jaccard_join.signatures(b, percent)))


def test_warc(spark, tmp_path):
    bodies = [None, "", "<p>x</p>", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 3, "é" * 1000, "<p>x</p>", "a\r\n\r\nb", "tail WARC/1.1\r\n"]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    rows = warc.records(pages)
    warc.write(rows, path)
    got = warc.read(spark, path).select(warc.field("WARC-Record-ID").alias("id"), warc.field("WARC-Type").alias("type"), "body").collect()
    assert len(got) == len(bodies)
    for r in got:
        i = int(re.search(r"\d+", r["id"])[0])
        assert r["type"] == ("revisit" if i in (1, 5) else "response")
        assert bytes(r["body"]) == (b"" if i in (1, 5) else (bodies[i] or "").encode())
    for r in rows.select("page_id", "payload_digest").collect():
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1((bodies[r["page_id"]] or "").encode()).digest()).decode()


def test_language(spark):
    lang = {"en": "the and of to in that was with for which", "de": "der die und das nicht mit sich auf eine dem", "fr": "les des une dans pour que sur avec pas est", "es": "los las una por con para del como pero sus"}
    rows = [(i, " ".join(RANDOM.choices(lang[a].split(), k=40)), a, "s") for i, a in enumerate(list(lang) * 40)] + [(900, None, "en", "s"), (901, "123 !!", "en", "s"), (902, "und", None, "s"), (903, "", "fr", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = language_id.train(d.where("doc_id % 4 <> 2 or doc_id >= 900"))
    got = {r["doc_id"]: r for r in language_id.predict(d, m).collect()}
    assert np.mean([got[i]["lang_pred"] == a for i, _, a, _ in rows[:160]]) > 0.98
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 903)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.predict(d, language_id.train(d.where("false"))).collect()} == {"und"}


def test_token_file(docs, none, spark, tmp_path):
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    path = f"file://{tmp_path}/t"
    token_file.write(token_file.tokenize(docs, P.path("byte_bpe_50k.json"), P.PATTERN, 2), path)
    got = token_file.read(spark, path).orderBy("doc_id").collect()
    assert len(got) == len(TEXTS)
    for i, r in enumerate(got):
        ids = tok.encode(TEXTS[i] or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (i, at, ids)
        at += len(ids)
    token_file.write(token_file.tokenize(none, P.path("byte_bpe_50k.json"), P.PATTERN, 2), f"{path}0")
    assert token_file.read(spark, f"{path}0").count() == 0


def test_huffman():
    rng = np.random.default_rng(2)
    for limit, n in ((20, 3000), (20, 1), (20, 2)):
        counts = np.zeros(5000, np.int64)
        counts[rng.choice(5000, n, replace=False)] = (rng.pareto(0.6, n) * 5).astype(np.int64) + 1
        lens = token_file.lengths(counts, limit)
        assert lens.max() <= limit and sum(2.0 ** -int(x) for x in lens if x) <= 1
        ids = rng.choice(np.flatnonzero(counts), 1000)
        bits, points = token_file.pack(ids, lens, token_file.canonical(lens))
        assert token_file.unpack(bits, points, len(ids), *token_file.tables(lens)).tolist() == ids.tolist()


def test_url_filter(spark):
    captures = spark.createDataFrame([(1, "http://a.b.example.com/x", 5), (2, "https://u@B.Example.com:8/", 20), (3, None, 5), (4, "no url", 5), (5, "http://other.net", None), (1, "http://a.b.example.com/x", 5)], "page_id long, url string, day int")
    entries = spark.createDataFrame([("example.com", 3, "block"), ("b.example.com", 10, "allow"), ("b.example.com", 19, "drop"), (None, 1, "block"), ("other.net", 0, "block")], "pattern string, day int, action string")
    got = [(r["page_id"], r["pattern"], r["blocked"]) for r in url_filter.apply(captures, entries).collect()]
    want = [(1, "example.com", True)] * 2 + [(2, "example.com", True), (3, None, False), (4, None, False), (5, None, False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(r["page_id"], r["blocked"]) for r in url_filter.apply(captures, entries.where("false")).collect()} == {(i, False) for i in range(1, 6)}


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffixes(docs, none, hot):
    seen, want = set(), {}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        gone, own = bytearray(len(b)), []
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
            own.append(b[k : k + 50])
        seen.update(own)
        want[i] = bytes(gone)
    got = {r["doc_id"]: r for r in suffix_dedup.spans(docs, hot=hot).collect()}
    for i, gone in want.items():
        mine = bytearray(len(gone))
        if i in got:
            for a, b in zip(np.frombuffer(got[i]["starts"], np.int64), np.frombuffer(got[i]["ends"], np.int64), strict=True):
                mine[a:b] = b"\1" * (b - a)
        assert bytes(mine) == gone, i
    cut = {r["doc_id"]: r["text"] for r in suffix_dedup.cut(docs).collect()}
    assert cut[7] == "" and cut[0] is None and cut[6] == BASE and suffix_dedup.cut(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (200, 160)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 150: 150, 160: 150, 200: 150} | {300 + i: 300 for i in range(30)}


def test_pipeline_and_crc(docs):
    import corpus_pipeline

    d = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        d = f(d.sparkSession, d, "")
        assert d.columns == docs.columns
    assert zlib.crc32(b"7") % 4 == docs.select((F.crc32(F.lit("7").cast("binary")) % 4).alias("x")).first()["x"]
