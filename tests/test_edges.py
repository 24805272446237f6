"""Commands, study files, sources, the service's retries, the bootstrap's engines, and streams."""

import io
import json
import logging
import urllib.error

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinlens import ConfigError, cli
from twinlens.config import StudyConfig
from twinlens.models import http
from twinlens.operators import bootstrap as B
from twinlens.sources.tables import as_frame, load_yaml, read_table
from twinlens.streaming.operators import annotate, drops_by_window

LABELS = "row_pos long, label_orig string, label_target string, label_base string"


def labels(spark, n=120):
    rng = np.random.default_rng(3)
    o, t, b = (rng.integers(0, 2, n) for _ in range(3))
    return spark.createDataFrame([(i, str(o[i]), str(t[i]), str(b[i])) for i in range(n)], LABELS)


def test_engines_are_named_and_never_switched(spark, monkeypatch):
    df = labels(spark)
    exact = B.bootstrap_diff(df, ["flip_rate"], n_bootstrap=50)[0]
    other = B.bootstrap_diff(df, ["flip_rate"], n_bootstrap=50, engine="multinomial")[0]
    assert (exact.extra["engine"], other.extra["engine"]) == ("exact", "multinomial")
    assert exact.statistic == pytest.approx(other.statistic)
    monkeypatch.setattr(B, "MAX_BROADCAST_ROWS", 100)
    with pytest.raises(ConfigError, match="multinomial"):
        B.bootstrap_diff(df, ["flip_rate"], n_bootstrap=50)
    assert B.bootstrap_diff(df, ["flip_rate"], n_bootstrap=50, engine="multinomial")[0].ci_low == other.ci_low
    with pytest.raises(ConfigError, match="unknown"):
        B.bootstrap_diff(df, ["flip_rate"], engine="auto")


def test_sources(spark, tmp_path):
    plain = pd.DataFrame({"x": [5, 6]})
    assert as_frame(spark, plain).columns == ["x"]
    for index in (pd.Index(["a", "b"]), pd.RangeIndex(2, name="k"), pd.RangeIndex(3, 5)):
        got = as_frame(spark, plain.set_axis(index)).orderBy("x")
        assert got.columns == ["sample_key", "x"] and [r[0] for r in got.collect()] == list(index)
    with pytest.raises(ConfigError, match="already"):
        as_frame(spark, pd.DataFrame({"sample_key": [1]}, index=["a"]))
    df = spark.range(2)
    assert as_frame(spark, df) is df
    (tmp_path / "t.CSV").write_text("id,q\n1,a\n2,b\n")
    t = read_table(spark, f"{tmp_path}/t.CSV")
    assert dict(t.dtypes) == {"id": "int", "q": "string"} and t.count() == 2
    t.write.parquet(f"{tmp_path}/t.pq")
    assert read_table(spark, f"{tmp_path}/t.pq").count() == 2
    with pytest.raises(ConfigError, match="unsupported"):
        read_table(spark, "t.tsv")
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ConfigError, match="mapping"):
        load_yaml(f"{tmp_path}/l.yaml")


FILE = {"data": "d.csv", "key": "id", "perturb_column": "q", "target_perturbation": "m:f", "prompt_template": "{q}", "target_model": {"type": "hash"}, "paraphrase_model": {"type": "hash"}, "metrics": ["flip_rate"], "classes": ["A", "B"]}


def test_study_files():
    assert StudyConfig.model_validate(FILE).bootstrap_engine == "exact"
    wrong = ({"metrics": []}, {"extract_label": "m:g"}, {"classes": None}, {"direction_column": "d"}, {"bootstrap_engine": "auto"}, {"unknown": 1},
             {"classes": None, "extract_label": "m:g", "direction_column": "d", "outcome_class_column": "o", "alternative": "less"})
    for change in wrong:
        with pytest.raises(ValueError):
            StudyConfig.model_validate(FILE | change)


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init", "p", "--directional"]) == 0
    assert cli.main(["init", "p"]) == 1 and "exist" in capsys.readouterr().err
    monkeypatch.chdir(tmp_path / "p")
    monkeypatch.syspath_prepend(str(tmp_path / "p"))
    (tmp_path / "p" / "data.csv").write_text("id,text,direction,outcome\n" + "".join(f"{i},he said {i} is his and he knew,{1 if i % 2 else -1},{'AB'[i % 2]}\n" for i in range(6)))
    assert cli.main(["validate", "config.yaml"]) == 0
    assert cli.main(["validate", "no.yaml"]) == 1
    assert cli.main(["run", "config.yaml", "--dry-run"]) == 0
    assert cli.main(["run", "config.yaml", "-o", "r.txt"]) == 1 and "unsupported output" in capsys.readouterr().err
    config = tmp_path / "p" / "config.yaml"
    config.write_text(config.read_text().replace("data: data.csv", f"data: {tmp_path}/p/data.csv"))  # the session's own folder is another
    cli.run("config.yaml", "r.json", spark=spark)
    out = json.load(open("r.json"))
    assert {r["metric"] for r in out["results"]} == {"jsd", "flip_rate"} and out["metadata"]["n_input"] == 6
    assert out["metadata"]["refused_samples_cut"] is False


def fails(code):
    return urllib.error.HTTPError("u", code, "no", None, io.BytesIO(b'{"error": {"code": "c"}}'))


def test_service_retries(monkeypatch, caplog):
    slept = []
    monkeypatch.setattr(http.time, "sleep", slept.append)
    good = {"system_fingerprint": "f", "choices": [{"message": {"content": "hi"}}]}
    answers = [good, fails(429), fails(503), TimeoutError(), ConnectionError(), good | {"system_fingerprint": "g"}]

    def send(url, payload, timeout):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    m = http.ChatModel("m", send=send, backoff_cap=4.0)
    with caplog.at_level(logging.WARNING, "twinlens"):
        assert m.generate(["p"], [1]) == ["hi"]
    assert slept == [1.0, 2.0, 4.0, 4.0] and "fingerprint changed from f to g" in caplog.text
    answers[:] = [fails(400), good]
    with pytest.raises(urllib.error.HTTPError):
        m.generate(["p"], [1])
    assert len(answers) == 1 and len(slept) == 4
    short = http.ChatModel("m", send=send, max_retries=1)
    answers[:] = [fails(500), fails(500), good]
    with pytest.raises(urllib.error.HTTPError):
        short.generate(["p"], [1])
    assert len(answers) == 1
    assert http.error_code('{"error": {"code": "c"}}') == "c" and http.error_code("<html>") is None


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "he went"), ("2024-01-01 00:01:00", "nothing"), ("2024-01-01 00:02:00", " "), ("2024-01-01 00:03:00", None)]
    spark.createDataFrame(rows, "ts string, q string").selectExpr("to_timestamp(ts) ts", "q").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, q string").parquet(f"{tmp_path}/in")
    out = annotate(stream, "q", lambda c: F.replace(c, F.lit("he "), F.lit("she ")))
    for name, df, mode in (("rows_", out, "append"), ("drops_", drops_by_window(out, "ts"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    got = {r["q"]: (r["drop_reason"], r["target_edit_pct"]) for r in spark.table("rows_").collect()}
    assert got == {"he went": (None, 50.0), "nothing": ("zero_edit", 0.0), " ": ("tokenization_failed", None), None: ("tokenization_failed", None)}
    assert {r["drop_reason"]: r["n"] for r in spark.table("drops_").collect()} == {None: 1, "zero_edit": 1, "tokenization_failed": 2}
