import math

import pytest
from pyspark.sql import functions as F

from twinlens.errors import ConfigError
from twinlens.functions import arrays as A, text as T
from twinlens.models.lexical import LexicalTokenizer
from twinlens.operators import paraphrase as P, special


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def arr(*v):
    return F.array(*map(F.lit, map(float, v)))


def test_divergences(spark):
    assert one(spark, A.kl(arr(0.5, 0.5), arr(0.25, 0.75))) == pytest.approx(0.5 * math.log(2) + 0.5 * math.log(2 / 3))
    assert one(spark, A.kl(arr(1, 0), arr(0.5, 0.5))) == pytest.approx(math.log(2))
    assert 1 < one(spark, A.kl(arr(0.5, 0.5), arr(1, 0))) < math.inf
    assert one(spark, A.jsd(arr(0.3, 0.7), arr(0.3, 0.7))) == 0
    assert one(spark, A.jsd(arr(1, 0), arr(0.5, 0.5))) == pytest.approx(0.5 * math.log(4 / 3) + 0.5 * (0.5 * math.log(2 / 3) + 0.5 * math.log(2)))


@pytest.mark.parametrize(("a", "b", "d"), [([1, 2, 3], [1, 2, 3], 0), ([1, 2, 3, 4], [1, 9, 3, 5], 2), ([], [1, 2, 3], 3), ([], [], 0), ([1, 2], [1, 2, 7], 1)])
def test_token_edits(spark, a, b, d):
    x, y = (F.array(*map(F.lit, v)).cast("array<int>") for v in (a, b))
    assert one(spark, T.token_edit_distance(x, y)) == d
    assert P.edit_distance(a, b) == d


def test_refusals(spark):
    yes = ["I can’t help with that", "As an AI, I", "Sorry, but no. I'm sorry, but I cannot", "Unfortunately, I won't", "sorry I can't", "I refuse to help", "well, i cant to help you", "I wont to assist"]
    no = ["As an aid to you", "As an AI. Fine", "He cannot help", "", "I can't wait"]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string")
    for ascii_only in (True, False):
        got = [r[0] for r in rows.select(T.is_refusal(F.col("t"), ascii_only)).collect()]
        assert got == [True] * len(yes) + [False] * len(no)
    assert [P.refuses(t) for t in yes + no] == [True] * len(yes) + [False] * len(no)


def test_templates(spark):
    assert one(spark, T.render("{{{a}}} {b}", {"a": F.lit("{b}"), "b": F.lit(None)})) == "{{b}} None"
    for bad in ("{}", "{0}", "{a.b}", "{a[0]}", "{a!r}", "{a:x}", "{"):
        with pytest.raises(ConfigError):
            T.render(bad, {"a": F.lit("")})
    with pytest.raises(ConfigError, match="missing"):
        T.render("{missing}", {"a": F.lit("")})


def test_seeds(spark):
    for s in ("abc", 'a"b\\', "é"):
        assert one(spark, T.seed_column(42, F.lit(s), "target")) == T.derive_seed(42, s, "target")
    with pytest.raises(TypeError):
        T.derive_seed(42, True)


def test_t_distribution():
    assert special.t_ppf(0.975, 19) == pytest.approx(2.09302405440831, abs=1e-10)
    assert special.t_cdf(1.0, 1) == pytest.approx(0.75)
    assert special.normal_ppf(0.975) == pytest.approx(1.959963984540054)


def test_paraphrase_loop():
    words = " ".join(f"w{i}" for i in range(10))
    changed = lambda k: " ".join(f"x{i}" if i < k else f"w{i}" for i in range(10))
    answers = iter(["I cannot help with that", changed(1)])
    got = P.calibrated(words, 10, lambda p, s: next(answers), str.split, P.refuses)
    assert (got.retries_used, got.refused, got.actual_edit_pct) == (2, False, 10)
    answers = iter([changed(1), changed(4)])
    got = P.calibrated(words, 20, lambda p, s: next(answers), str.split, P.refuses, max_retries=1)
    assert (got.text, got.retries_used) == (changed(1), 2)
    got = P.calibrated(words, 20, lambda p, s: "I cannot help with that", str.split, P.refuses, max_retries=2)
    assert got == P.Paraphrase(words, 0.0, 3, True)
    with pytest.raises(ValueError):
        P.calibrated(" ", 5, lambda p, s: "", str.split, P.refuses)


def test_long_token_edits(spark):
    """Pairs with more distinct tokens than the JVM's way takes, beside short and null ones."""
    long_ = [f"t{i}" for i in range(T.FEW + 200)]
    other = ["x", *long_[:300], *long_[310:], "y"]
    rows = spark.createDataFrame([(long_, other), (["a"], ["b"]), (None, ["b"]), (long_, [])], "a array<string>, b array<string>")
    got = [r[0] for r in rows.select(T.token_edit_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [12, 1, None, len(long_)]
    assert T.distance(long_, other) == P.edit_distance(long_, other) == 12


def test_one_rule_for_white_space(spark):
    t = " a b　c d\x1ce\x85f\n"
    assert one(spark, T.words(F.lit(t))) == t.split() == LexicalTokenizer().encode(t)


def test_metrics_config_and_merge():
    """Metrics that callers add, directional options without classes, and whose metadata a merged report has."""
    from twinlens.config import StudyConfig
    from twinlens.errors import ConfigError
    from twinlens.operators import bootstrap, validate
    from twinlens.report import Report

    with pytest.raises(ConfigError, match="unknown"):
        validate.check_metrics(["own"], "free_form", False)
    bootstrap.METRICS["own"] = bootstrap.flip_metric
    try:
        validate.check_metrics(["own", "flip_rate"], "free_form", False)
    finally:
        del bootstrap.METRICS["own"]
    with pytest.raises(ConfigError, match="needs classification"):
        validate.check_metrics(["jsd"], "free_form", False)
    base = {"data": "d.csv", "key": "id", "perturb_column": "t", "target_perturbation": "m:f", "prompt_template": "{t}", "target_model": {"type": "hash"}, "paraphrase_model": {"type": "hash"}, "metrics": ["mi"]}
    way = {"direction_column": "x", "outcome_class_column": "x", "alternative": "less"}
    assert StudyConfig(**base, classes=["A"], **way).direction_column == "x"
    for bad in ({"extract_label": "m:g", **way}, {"classes": ["A"], "alternative": "less"}):
        with pytest.raises(ValueError, match="directional|together"):
            StudyConfig(**base, **bad)
    merged = Report([], {"n": 1}).merge(Report([], {"n": 2, "only": 3}))
    assert merged.metadata == {"n": 1, "merged_from": [{"n": 1}, {"n": 2, "only": 3}]}
