import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens import ConfigError, StageNotRunError, Study
from twinlens.models.http import ChatModel
from twinlens.models.lexical import HashModel, ScriptedModel
from twinlens.operators import bootstrap as B, tests as S


def paraphraser():
    return ScriptedModel(texts=lambda p, s: " ".join(w if i else w + "x" for i, w in enumerate(p.split("\n\n")[-1].split())), name="p")


def shout(t):
    return t.replace("beta", "BETA")


def label(t):
    return t if t in "AB" else None


@pytest.fixture()
def data(spark):
    rows = [(i, f"alpha beta gamma delta {i} eps zeta eta", "A" if i % 2 else "B", 1 if i % 3 else -1) for i in range(12)] + [(99, "nothing to change here", "A", 1)]
    return spark.createDataFrame(rows, "id long, q string, outcome string, d int")


def make(data, **kw):
    args = {"key": "id", "perturb_column": "q", "target_perturbation": shout, "prompt_template": "{q}?", "target_model": HashModel, "paraphrase_model": paraphraser, "classes": ["A", "B"], "tolerance": 50.0, "n_bootstrap": 50}
    return Study(data, **(args | kw))


def test_classification_study(spark, data, tmp_path):
    s = make(data, direction_column="d", outcome_class_column="outcome", alternative="greater", cache_dir=f"file://{tmp_path}/cache")
    r = s.run_all(["jsd", "kl", "flip_rate", "mi", "regression"])
    assert [x.metric for x in r.results] == ["jsd", "kl", "flip_rate", "mi", "regression"]
    assert s.drop_counts["zero_edit"] == 1 and r.results[0].n == 12
    assert s.baselines_df.where("abs(target_edit_pct - 12.5) > 1e-9").count() == 0
    r.to_json(f"{tmp_path}/r.json")
    assert len(json.load(open(f"{tmp_path}/r.json"))["results"]) == 5
    assert r.summary_table(spark).count() == 5 and len(r.merge(r).metadata["merged_from"]) == 2
    s.save(f"file://{tmp_path}/saved")
    t = Study.load(spark, f"file://{tmp_path}/saved")
    assert t.test(["jsd"]).results[0].statistic == pytest.approx(r.results[0].statistic)
    t.reset_inference()
    with pytest.raises(StageNotRunError):
        t.run_inference()
    again = make(data, direction_column="d", outcome_class_column="outcome", alternative="greater", cache_dir=f"file://{tmp_path}/cache", paraphrase_model=lambda: ScriptedModel(texts=None, name="p"))
    assert again.generate_baselines().where("baseline_refused or baseline_perturbed = ''").count() == 0  # all from the cache


def test_free_form(data):
    s = make(data, classes=None, extract_label=label)
    s.run_inference()
    kept = s.inference_df.count()
    assert kept + s.drop_counts["extraction_returned_none"] == 12
    s.reextract(lambda t: 1 / 0)
    assert s.inference_df.count() == kept and s.drop_counts["extraction_raised"] == 3 * kept


def test_checks(spark, data):
    for kw in ({"classes": None}, {"perturb_column": "no"}, {"direction_column": "d"}, {"prompt_template": "{zzz}"}):
        with pytest.raises(ConfigError):
            make(data, **kw)
    with pytest.raises(ConfigError, match="repeated"):
        make(data.union(data))
    with pytest.raises(ConfigError, match="zero"):
        make(data.withColumn("d", F.lit(0)), direction_column="d", outcome_class_column="outcome", alternative="less")
    with pytest.raises(ConfigError, match="no class"):
        make(data.withColumn("outcome", F.lit("C")), direction_column="d", outcome_class_column="outcome", alternative="less")


def test_bootstrap_matches_a_plain_resampler(spark):
    rng = np.random.default_rng(0)
    n = 150
    o = rng.integers(0, 2, n)
    t, b = (np.where(rng.random(n) < p, 1 - o, o) for p in (0.3, 0.1))
    df = spark.createDataFrame([(i, str(o[i]), str(t[i]), str(b[i])) for i in range(n)], "row_pos long, label_orig string, label_target string, label_base string")
    got = B.bootstrap_diff(df.repartition(3), ["flip_rate", "phi"], n_bootstrap=200, seed=5)
    state, diffs = np.random.RandomState(5), []
    for _ in range(200):
        i = state.randint(0, n, size=n)
        diffs.append((o[i] != t[i]).mean() - (o[i] != b[i]).mean())
    diffs = np.array(diffs)
    assert got[0].statistic == pytest.approx((o != t).mean() - (o != b).mean(), abs=1e-12)
    assert got[0].p_value == pytest.approx(min(1, 2 * min((diffs <= 1e-15).mean(), (diffs >= -1e-15).mean())), abs=1e-12)
    assert (got[0].ci_low, got[0].ci_high) == pytest.approx(tuple(np.percentile(diffs, [2.5, 97.5])), abs=1e-12)
    assert got[1].statistic is not None


def test_level_regression_matches_stacked_least_squares(spark):
    rng = np.random.default_rng(1)
    g = 60
    d, z, u = np.where(np.arange(g) % 2, 1.0, -1.0), rng.normal(size=g), rng.normal(size=g)
    yb, yt = z + u, z + u + 0.3 * d + rng.normal(size=g) / 5
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(d, z, yt, yb)], "d double, z double, yt double, yb double")
    f = S.fit_level(df, *(F.col(c) for c in ("d", "z", "yt", "yb")))
    x = np.concatenate([np.stack([np.ones(g), z, np.zeros(g)], 1), np.stack([np.ones(g), z, d], 1)])
    y = np.concatenate([yb, yt])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e, inv = y - x @ beta, np.linalg.inv(x.T @ x)
    s = x[:g] * e[:g, None] + x[g:] * e[g:, None]
    v = inv @ (s.T @ s) @ inv * (g / (g - 1)) * ((2 * g - 1) / (2 * g - 3))
    assert (f.beta, f.se, f.df) == pytest.approx((beta[2], np.sqrt(v[2, 2]), 2 * g - 3))


def test_chat_model():
    top = [{"token": " Yes", "logprob": -1.0}, {"token": " Yes", "logprob": -9.0}, {"token": " No", "logprob": -2.0}]
    send = lambda url, payload, timeout: {"system_fingerprint": "f", "choices": [{"message": {"content": "hi"}, "logprobs": {"content": [{"top_logprobs": top}]}}]}
    m = ChatModel("m", send=send)
    assert m.generate(["p"], [1]) == ["hi"] and "f" in m.cache_id
    p = m.score_classes(["p"], ["No", "Yes"], [1])
    assert p[0, 1] == pytest.approx(1 / (1 + np.exp(-1)))
    assert np.isnan(m.score_classes(["p"], ["No", "Maybe"], [1])).all()
    m.close()
    with pytest.raises(RuntimeError):
        m.generate(["p"], [1])
