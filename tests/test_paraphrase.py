import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from twinlens.functions import text as T
from twinlens.operators import paraphrase as P
from twinlens.plans import catalog


def test_choice_is_the_online_loops_and_in_time(spark, tmp_path):
    """240 long messages: the time of comparing them grew with the square of a text's distinct tokens (minutes here)."""
    rng = random.Random(3)
    odd = ["one", "", None, " \t ", "a b　c d\x1ce", "I cannot help with that, and a few more words", *(" ".join(f"w{i}" for i in range(n)) for n in (20, 60))]
    texts = [*odd, *(" ".join(f"word{rng.randrange(900)}" for _ in range(290)) for _ in range(240))]
    pq.write_table(pa.table({"conv_id": pa.array(range(len(texts)), pa.int64()), "turn": pa.array([i % 4 for i in range(len(texts))], pa.int32()), "text": pa.array(texts, pa.string())}), f"{tmp_path}/conversations.parquet")
    began = time.monotonic()
    rows = catalog.QUERIES["paraphrase_select"](spark, str(tmp_path)).collect()
    took = time.monotonic() - began
    got = {r["sample_id"]: tuple(r)[1:] for r in rows}
    ids = {i * 1000 + i % 4: t for i, t in enumerate(texts) if t and t.split()}
    assert len(rows) == len(got) and set(got) == set(ids)
    for i, t in list(ids.items())[:20]:
        replies = iter([" ".join(w + "x" if k % j == 0 else w for k, w in enumerate(t.split())) for j in (20, 10, 7, 4, 3)])
        want = P.calibrated(t, i % 4 * 10 + 5.0, lambda p, s: next(replies), str.split, P.refuses, 1.0, 4)  # noqa: B023
        assert got[i] == (pytest.approx(want.actual_edit_pct, abs=1e-9), want.refused, want.retries_used)
    assert took < 60


def test_distance_in_blocks(monkeypatch):
    rng = random.Random(1)
    for few in (1, 2, 7, 64):
        monkeypatch.setattr(T, "FEW", few)
        for _ in range(300):
            a, b = ([rng.randrange(3) for _ in range(rng.randrange(25))] for _ in range(2))
            assert T.distance(a, b) == P.edit_distance(a, b)


def test_word_edits_are_the_token_edits(spark):
    texts = ["", " ", "a b c", "a b　c", "é x\x85y a b", "x\x1fy z", None, "a a a b"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    bad = rows.limit(1).select(F.expr("cast(X'6120FF2062' as string)").alias("a"), F.lit("a � c").alias("b"))
    assert all(r[0] == (r[1] > 0) for r in rows.where("a is not null").select(T.has_words(F.col("a")), F.size(T.words(F.col("a")))).collect())
    for r in rows.union(bad).select(T.word_edit_pct(F.col("a"), F.col("b")), T.token_edit_pct(T.words(F.col("a")), T.words(F.col("b")))).collect():
        assert r[0] == r[1]
