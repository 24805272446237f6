"""Operators do the whole job where tables are large, texts long or ids null or repeated."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinlens.llm import byte_bpe, embedding_dedup, jaccard_join, mixing, suffix_dedup, warc
from twinlens.plans import catalog


def test_embedding_filters_at_size():
    """At the plan of a million vectors (and of few dimensions) every vector has all filters, and near pairs share some."""
    rng = np.random.default_rng(5)
    for dim in (2, 8, 64):
        x, g = rng.standard_normal((2, 2000, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        g -= (g * x).sum(1)[:, None] * x
        g /= np.linalg.norm(g, axis=1)[:, None]
        a, b = (embedding_dedup.decode(v, *embedding_dedup.plan(1_000_000, dim)) for v in (x, 0.951 * x + np.sqrt(1 - 0.951**2) * g))
        assert all(len(np.unique(f)) == embedding_dedup.CODES * embedding_dedup.BEST for f in a)
        assert (a[:, :, None] == b[:, None, :]).any((1, 2)).all()


def test_token_edits_of_long_texts(spark, tmp_path):
    rng = random.Random(4)
    texts = ["the cat sat with them", "", None, *(" ".join(f"{rng.choice(['th', 'w', 'the'])}{rng.randrange(400)}" for _ in range(n)) for n in (90, 200, 700))]
    pq.write_table(pa.table({"conv_id": pa.array(range(len(texts)), pa.int64()), "turn": pa.array([0] * len(texts), pa.int32()), "text": pa.array(texts, pa.string())}), f"{tmp_path}/conversations.parquet")

    def distance(a: list, b: list) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    got = {r["conv_id"]: r for r in catalog.QUERIES["token_edit_distance_all"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and got[2]["distance"] is None
    for i, t in enumerate(texts):
        if t is not None:
            a, b = t.split(), t.replace("th", "z").split()
            want = distance(a, b)
            assert got[i]["distance"] == want and got[i]["pct"] == (pytest.approx(want / len(a) * 100) if a else None)


def test_warc_long_url_and_damage(spark, tmp_path):
    urls = ["http://h/0", "data:," + "x" * 200_000, "http://h/2", "http://h/" + "WARC/1.1\r\n" * 20_000, "http://h/4"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write(warc.records(pages).coalesce(1), path)
    got = {r["uri"]: bytes(r["body"]) for r in warc.read(spark, path).select(warc.field("WARC-Target-URI").alias("uri"), "body").collect()}
    assert got == {u.replace("\r", "%0D").replace("\n", "%0A"): f"<p>{i}</p>".encode() for i, u in enumerate(urls)}
    (file,) = (tmp_path / "w").glob("part-*")
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.gz").write_bytes(gzip.compress(gzip.decompress(file.read_bytes())[:-10]))
    with pytest.raises(Exception, match="do not end at its size"):
        warc.read(spark, f"file://{tmp_path}/cut").collect()


def test_warc_repeated_and_null_ids_and_large_pages(spark, tmp_path, monkeypatch):
    """The rows of op6 with ids that repeat or are null, and pages beyond the bound of the common files."""
    monkeypatch.setattr(warc, "LARGE", 5000)
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    rows = [(1, "A"), (2, "B"), (5, "A"), (5, "B"), (5, "R"), (5, "R"), (None, "A"), (None, "N"), (None, "N"), (7, None), (8, ""), *((20 + i, "é" * 4000 + str(i % 5)) for i in range(9))]
    pq.write_table(pa.table({"page_id": pa.array([i for i, _ in rows], pa.int64()), "url": ["http://h/"] * len(rows), "html": pa.array([h for _, h in rows], pa.string())}), f"{tmp_path}/pages.parquet")
    got = warc.op6_warc(spark, str(tmp_path)).collect()
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, h in rows:
        body, of = (h or "").encode(), first.get(h or "")
        later = of is not None and i != of
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if later else "response", of if later else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.records(empty), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_null_ids(spark):
    """Null ids, alone and as exact and near copies, through the Jaccard join, its pipeline stage and the mix."""
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    a, b, c, d = text(), text(), text(), text()
    near = lambda t: t.rsplit(" ", 1)[0] + " zz"
    rows = [(5, a), (None, a), (7, near(a)), (None, near(a)), (None, b), (None, b), (None, near(b)), (None, c), (3, d), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.join(docs, 3, 90).collect()), key=str)
    assert got == sorted([(5, 5), (None, 5), (7, 5), (None, 5), *[(None, None)] * 6, (3, 3)], key=str)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    ids, texts = [i for i, _ in kept], [t for _, t in kept]
    assert len(kept) == 6 and {i for i in ids if i is not None} == {3, 5} and texts.count("") == 2 and c in texts and (b in texts) + (near(b) in texts) == 1
    few = docs.where("text <> ''").dropDuplicates(["text"])
    assert len(mixing.copies(few).collect()) == few.count()
    assert {r["text"] for r in mixing.mix(few).collect()} == {r["text"] for r in few.collect()}


def test_repeated_and_null_ids_are_cut_apart(spark, tmp_path):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    p, q = word(120), word(120)
    rows = [(1, p + q), (2, word(40) + p + "x"), (2, word(300)), (None, word(70) + q), (None, word(400)), (None, q + word(50))]
    want = [p + q, rows[1][1][:40] + "x", rows[2][1], rows[3][1][:70], rows[4][1], rows[5][1][120:]]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]}), f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["text"] for r in suffix_dedup.cut(docs).collect()) == sorted(want)
    got = sorted(r["kept_sha256"] for r in suffix_dedup.op10_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == sorted(hashlib.sha256(t.encode()).hexdigest() for t in want)


def test_pipeline_rows(spark, tmp_path):
    """The rows that ``run`` returns, stage by stage, against brute force on small documents."""
    import public_tokenizers as P
    import tiktoken

    rng = random.Random(12)
    letters = {"en": "the of and to in that was with for is", "fr": "le de et les des que une pour dans est"}
    own = {k: v.split() + ["".join(rng.choices("aeiourstln", k=6)) + k for _ in range(400)] for k, v in letters.items()}
    prose = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    rows = [(i, lang := ("en", "fr")[i % 2], prose(lang, 120)) for i in range(60)]
    passage = prose("en", 40)
    rows += [(100, "en", rows[0][2]), (101, "fr", rows[1][2].rsplit(" ", 1)[0] + " xx"), (102, "en", prose("en", 60) + " " + passage), (103, "en", prose("en", 70) + " " + passage), (104, None, None), (105, "en", ""), (106, "en", "12 34 !"), (None, "fr", prose("fr", 90))]
    rng.shuffle(rows)
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[2] for r in rows], pa.string()), "lang": pa.array([r[1] for r in rows], pa.string()), "source": [("a", "b", None)[i % 3] for i in range(len(rows))], "n_chars": [len(r[2] or "") for r in rows]}), f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clash = ["score", "lang_pred", "_row", "n_shingles", "key", "size", "component_id", "copy", "ids", "taken"]
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("n_chars").cast("string")) for c in clash})
    kept = {}
    now, want = docs, {i: t for i, _, t in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), docs.schema)
        assert now.columns == docs.columns and all(r[c].startswith(c) for r in now.collect() for c in clash)
        kept[name] = [(r["doc_id"], r["text"]) for r in now.collect()]
    # no text, no letter
    want = {i: t for i, t in want.items() if i not in (104, 105, 106)}
    assert sorted(kept["language_id"], key=str) == sorted(want.items(), key=str)
    # of each group of near copies the smallest id
    sets = {i: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} for i, t in want.items()}
    real = sorted(i for i in want if i is not None)
    gone = {b for a in real for b in real if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert gone == {100, 101}
    want = {i: t for i, t in want.items() if i not in gone}
    assert sorted(kept["jaccard_join"], key=str) == sorted(want.items(), key=str)
    # strings of 50 bytes that start in a document before
    order, seen, cut = sorted(want, key=lambda i: (i is None, i or 0)), set(), {}
    for i in order:
        data = want[i].encode()
        grams = [data[k : k + 50] for k in range(len(data) - 49)]
        covered = {x for k, g in enumerate(grams) if g in seen for x in range(k, k + 50)}
        cut[i] = bytes(c for k, c in enumerate(data) if k not in covered).decode("utf-8", "ignore")
        seen.update(grams)
    assert len(cut[103]) < len(want[103])
    assert sorted(kept["suffix_dedup"], key=str) == sorted(cut.items(), key=str)
    # the mix repeats or leaves out documents, whole
    assert set(kept["mixing"]) <= set(cut.items()) and len(kept["mixing"]) > 20
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pq.write_table(docs.toArrow(), f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], bytes(r["decoded"]), np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    ids = lambda t: plain.encode_ordinary(t)
    assert sorted(got, key=str) == sorted(((i, t.encode(), ids(t), len(ids(t))) for i, t in kept["mixing"]), key=str)


def test_without_some_ids(spark):
    """The join behind a Bloom filter leaves out exactly the ids given, whatever the filter lets through."""
    rows = spark.range(3000).selectExpr("id", "concat('t', id) as text")
    out = jaccard_join.without(rows, spark.range(0, 3000, 7), "id").collect()
    assert sorted(r["id"] for r in out) == [i for i in range(3000) if i % 7]
    assert jaccard_join.without(rows, spark.range(0), "id").count() == 3000


def test_components_of_few_edges_in_one_task(spark):
    """What one task settles is what the rounds give and brute force finds: chains, stars, loops, copies, nothing."""
    from twinlens.llm.common import components

    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(-40, 40)]
    star = [(1000, i) for i in range(901, 960)]
    edges = [(5000, 5000), *chain, *star, *star[:5], *((rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(140))]
    rng.shuffle(edges)
    low = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in low:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    frame = spark.createDataFrame(edges, "a long, b long")
    for settled in (len(edges), 10):  # in one task, too many for it
        assert sorted(map(tuple, components(frame, "t", settled=settled).collect())) == sorted(low.items())
    assert components(frame.where("a is null"), "t", settled=10).count() == 0


def test_pipeline_near_duplicates_asks_little_of_the_driver(spark):
    """Jobs of the stage do not grow with rounds over the few links of a chain of near copies; plans' texts are bounded."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 200]), "s") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.conf.unset("spark.sql.maxPlanStringLength")
    last = lambda: spark.range(1).rdd.count() and max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = last()
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    jobs = last() - before
    assert [r["doc_id"] for r in kept] == [0]
    assert jobs < 60, jobs
    assert int(spark.conf.get("spark.sql.maxPlanStringLength")) <= 1 << 16
