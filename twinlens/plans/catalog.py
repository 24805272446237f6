"""Queries over the test tables, one for each operator, and the SQL that must give the same rows.

The tables hold no model outputs, so the arms are softmaxes of parts of ``embeddings``; texts come from ``documents`` and
``conversations``; label pairs also from ``lineitem`` and ``labels``. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import arrays as A, responses as R, text as T
from ..operators import aggregates as G, arms, bootstrap, paraphrase, tests, validate as V
from ..operators.tests import TestResult
from ..report import Report

CLASSES = ["A", "B", "C", "D"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r9(c: Column) -> Column:
    return F.round(c, 9) + F.lit(0.0)


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def arm_columns(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as a classification study: three probability arms, labels, direction and outcome."""
    e = table(spark, d, "embeddings")
    raw = lambda k: F.transform(F.slice("embedding", 4 * k + 1, 4), lambda x: x.cast("double") * 8)
    e = e.select(F.col("vec_id").alias("sample_id"), *(A.softmax(raw(k)).alias(f"probs_{s}") for k, s in enumerate(arms.ARMS.values())), "label")
    return e.select("*", *(A.argmax_label(F.col(f"probs_{s}"), CLASSES).alias(f"label_{s}") for s in arms.ARMS.values()), F.when(F.col("sample_id") % 2 == 0, 1).otherwise(-1).alias("direction"), F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("label") % 4 + 1).cast("int")).alias("outcome"))


# the same arms in SQL
_E = """
WITH raw AS (SELECT vec_id AS sample_id, label, list_transform(embedding[1:4], lambda x: x::DOUBLE * 8) AS a,
  list_transform(embedding[5:8], lambda x: x::DOUBLE * 8) AS b, list_transform(embedding[9:12], lambda x: x::DOUBLE * 8) AS c FROM embeddings),
ex AS (SELECT sample_id, label, list_transform(a, lambda x: exp(x - list_max(a))) AS a, list_transform(b, lambda x: exp(x - list_max(b))) AS b,
  list_transform(c, lambda x: exp(x - list_max(c))) AS c FROM raw),
e AS (SELECT sample_id, label, list_transform(a, lambda x: x / list_sum(a)) AS po, list_transform(b, lambda x: x / list_sum(b)) AS pt,
  list_transform(c, lambda x: x / list_sum(c)) AS pb FROM ex),
s AS (SELECT *, ['A','B','C','D'][list_position(po, list_max(po))] AS lo, ['A','B','C','D'][list_position(pt, list_max(pt))] AS lt,
  ['A','B','C','D'][list_position(pb, list_max(pb))] AS lb, CASE WHEN sample_id % 2 = 0 THEN 1 ELSE -1 END AS direction,
  label % 4 + 1 AS k, ['A','B','C','D'][label % 4 + 1] AS outcome FROM e)"""


def _kl(p: str, q: str) -> str:
    clip = lambda x: f"greatest(least({x}, 1.0::DOUBLE), 1e-12::DOUBLE)"
    return f"list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * (ln({clip('z[1]')}) - ln({clip('z[2]')})) ELSE 0::DOUBLE END))"


def _jsd(p: str, q: str) -> str:
    m = f"list_transform(list_zip({p}, {q}), lambda y: (y[1] + y[2]) / 2)"
    return f"({_kl(p, m)} + {_kl(q, m)}) / 2"


@query(_E + f" SELECT sample_id, round({_kl('po', 'pt')}, 9) + 0.0 AS kl_target, round({_kl('po', 'pb')}, 9) + 0.0 AS kl_baseline FROM s")
def kl_divergence(spark, d):
    e = arm_columns(spark, d)
    return e.select("sample_id", r9(A.kl(F.col("probs_orig"), F.col("probs_target"))).alias("kl_target"), r9(A.kl(F.col("probs_orig"), F.col("probs_base"))).alias("kl_baseline"))


@query(_E + f" SELECT sample_id, round({_jsd('po', 'pt')}, 9) + 0.0 AS jsd_target, round({_jsd('po', 'pb')}, 9) + 0.0 AS jsd_baseline FROM s")
def js_divergence(spark, d):
    e = arm_columns(spark, d)
    return e.select("sample_id", r9(A.jsd(F.col("probs_orig"), F.col("probs_target"))).alias("jsd_target"), r9(A.jsd(F.col("probs_orig"), F.col("probs_base"))).alias("jsd_baseline"))


@query(_E + " SELECT count(*) AS n, count(*) FILTER (WHERE least(list_min(po), list_min(pt), list_min(pb)) < 1e-12) AS clipped FROM s")
def clip_counts(spark, d):
    return arm_columns(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(A.any_clipped(F.col("probs_orig"), F.col("probs_target"), F.col("probs_base"))).alias("clipped"))


@query(_E + " SELECT sample_id, round(po[1], 9) AS p1, round(po[2], 9) AS p2, round(po[3], 9) AS p3, round(po[4], 9) AS p4 FROM s")
def softmax_scores(spark, d):
    return arm_columns(spark, d).select("sample_id", *(F.round(F.get("probs_orig", F.lit(i)), 9).alias(f"p{i + 1}") for i in range(4)))


@query(_E + " SELECT sample_id, lo AS label_orig, lt AS label_target, lb AS label_base FROM s")
def argmax_label(spark, d):
    return arm_columns(spark, d).select("sample_id", "label_orig", "label_target", "label_base")


@query(_E + " SELECT sample_id, outcome, round(po[k], 9) AS p, round(ln(greatest(least(po[k], 1.0), 1e-12)), 9) AS logp, k - 1 AS place FROM s")
def outcome_log_probability(spark, d):
    e = arm_columns(spark, d)
    p = A.class_probability(F.col("probs_orig"), CLASSES, F.col("outcome"))
    return e.select("sample_id", "outcome", F.round(p, 9).alias("p"), F.round(A.clipped_log(p), 9).alias("logp"), arms.class_index(F.col("outcome"), CLASSES).alias("place"))


@query("SELECT vec_id AS sample_id, round(embedding[3]::DOUBLE, 6) AS a, round(embedding[8]::DOUBLE, 6) AS b, embedding IS NULL AS missing FROM embeddings")
def gather_logits(spark, d):
    e = table(spark, d, "embeddings")
    g = A.gather(F.col("embedding").cast("array<double>"), [2, 7])
    return e.select(F.col("vec_id").alias("sample_id"), F.round(F.get(g, F.lit(0)), 6).alias("a"), F.round(F.get(g, F.lit(1)), 6).alias("b"), A.missing(F.col("embedding").cast("array<double>")).alias("missing"))


def _paired_sql(f) -> str:
    return _E + f", x AS (SELECT {f('po', 'pt')} - {f('po', 'pb')} AS v FROM s) SELECT count(*) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, round(avg(v) / (stddev_samp(v) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM x"


def _paired(spark, d, f):
    e = arm_columns(spark, d)
    m = tests.paired_moments(e, f(F.col("probs_orig"), F.col("probs_target")), f(F.col("probs_orig"), F.col("probs_base")))
    return m.select("n", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), F.round("t", 6).alias("t"), "df")


@query(_paired_sql(_jsd))
def paired_t_jsd(spark, d):
    return _paired(spark, d, A.jsd)


@query(_paired_sql(_kl))
def paired_t_kl(spark, d):
    return _paired(spark, d, A.kl)


@query(_E + " SELECT round(avg((lo <> lt)::INT), 9) AS flip_rate, count(*) AS n FROM s")
def flip_rate(spark, d):
    out = G.flip_rate(arm_columns(spark, d), "label_orig", "label_target")
    return out.select(F.round("flip_rate", 9).alias("flip_rate"), "n")


@query("""WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS c FROM lineitem GROUP BY 1, 2),
m AS (SELECT c / sum(c) OVER () AS p, sum(c) OVER (PARTITION BY x) / sum(c) OVER () AS px, sum(c) OVER (PARTITION BY y) / sum(c) OVER () AS py, c FROM c)
SELECT round(sum(p * (ln(p) - ln(px * py))), 9) + 0.0 AS mi, sum(c)::BIGINT AS n FROM m""")
def mutual_information(spark, d):
    return G.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(r9(F.col("mi")).alias("mi"), "n")


@query("""WITH t AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE a, count(*) FILTER (WHERE quality = 1 AND toxic = 0)::DOUBLE b,
count(*) FILTER (WHERE quality = 0 AND toxic = 1)::DOUBLE c, count(*) FILTER (WHERE quality = 0 AND toxic = 0)::DOUBLE d FROM labels)
SELECT round((a * d - b * c) / sqrt((a + b) * (c + d) * (a + c) * (b + d)), 9) AS phi, 'ok' AS status FROM t""")
def phi_coefficient(spark, d):
    return G.phi_coefficient(table(spark, d, "labels"), "quality", "toxic").select(F.round("phi", 9).alias("phi"), "status")


@query("""SELECT o_orderpriority AS priority, round(avg((substr(o_orderstatus, 1, 1) <> substr(o_orderpriority, 3, 1))::INT), 9) AS flip_rate, count(*) AS n FROM orders GROUP BY 1""")
def flip_rate_by_group(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.substring("o_orderstatus", 1, 1).alias("a"), F.substring("o_orderpriority", 3, 1).alias("b"))
    return G.flip_rate(o, "a", "b", ["priority"]).select("priority", F.round("flip_rate", 9).alias("flip_rate"), "n")


_LOGS = ", g AS (SELECT *, ln(greatest(least(po[k], 1.0), 1e-12)) AS yo, ln(greatest(least(pt[k], 1.0), 1e-12)) AS yt, ln(greatest(least(pb[k], 1.0), 1e-12)) AS yb FROM s)"


def _logs(spark, d):
    e = arm_columns(spark, d)
    return e, {s: A.clipped_log(A.class_probability(F.col(f"probs_{s}"), CLASSES, F.col("outcome"))) for s in arms.ARMS.values()}


@query(_E + _LOGS + """, m AS (SELECT count(*) AS n, sum(direction * direction)::DOUBLE AS xx, sum(direction * (yt - yb)) AS xy, sum((yt - yb) * (yt - yb)) AS yy FROM g),
f AS (SELECT n, xy / xx AS beta, xx, yy, yy - xy / xx * xy AS rss FROM m)
SELECT n, round(beta, 6) AS beta, round(sqrt(rss / (n - 1) / xx), 6) AS se, round(beta / sqrt(rss / (n - 1) / xx), 6) AS t, round(1 - rss / yy, 6) AS r_squared FROM f""")
def ols_difference(spark, d):
    e, y = _logs(spark, d)
    m = tests.difference_moments(e, F.col("direction"), y["target"] - y["base"])
    return m.select("n", *(F.round(c, 6).alias(c) for c in ("beta", "se", "t", "r_squared")))


@query(_E + _LOGS + """, q AS (SELECT yo AS z, direction::DOUBLE AS d, yt, yb FROM g),
m AS (SELECT count(*)::DOUBLE AS g, 2.0 * count(*) AS n, 2 * sum(z) AS z1, 2 * sum(z * z) AS z2, sum(d) AS d1, sum(d * d) AS d2, sum(z * d) AS zd,
  sum(yt + yb) AS y0, sum(z * (yt + yb)) AS y1, sum(d * yt) AS y2 FROM q),
i AS (SELECT *, n * (z2 * d2 - zd * zd) - z1 * (z1 * d2 - zd * d1) + d1 * (z1 * zd - z2 * d1) AS det FROM m),
v AS (SELECT *, (z2 * d2 - zd * zd) / det AS i00, (d1 * zd - z1 * d2) / det AS i01, (z1 * zd - d1 * z2) / det AS i02,
  (n * d2 - d1 * d1) / det AS i11, (z1 * d1 - n * zd) / det AS i12, (n * z2 - z1 * z1) / det AS i22 FROM i),
b AS (SELECT *, i00 * y0 + i01 * y1 + i02 * y2 AS b0, i01 * y0 + i11 * y1 + i12 * y2 AS b1, i02 * y0 + i12 * y1 + i22 * y2 AS b2 FROM v),
u AS (SELECT q.*, b.*, yb - b0 - b1 * z AS ub, yt - b0 - b1 * z - b2 * d AS ut FROM q, b),
w AS (SELECT any_value(n) AS n, any_value(g) AS g, any_value(b1) AS b1, any_value(b2) AS b2,
  sum(power((i02 + i12 * z) * (ub + ut) + i22 * d * ut, 2)) AS v2 FROM u)
SELECT round(b1, 6) AS b1, round(b2, 6) AS beta, round(sqrt(v2 * (g / (g - 1)) * ((n - 1) / (n - 3))), 6) AS se, n::BIGINT AS n_obs FROM w""")
def ols_level_clustered(spark, d):
    e, y = _logs(spark, d)
    r = tests.level_fit(e, F.col("direction"), y["orig"], y["target"], y["base"])
    return spark.createDataFrame([(round(r["b1"], 6), round(r["b2"], 6), round(r["se2"], 6), int(r["n_obs"]))], "b1 double, beta double, se double, n_obs long")


def perturbed(spark, d) -> DataFrame:
    """Documents whose lower-case 'the' is exchanged; every seventh stays as it is, every eleventh is blank."""
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 5, "").otherwise(F.col("text")).alias("original"))
    t = t.withColumn("target_perturbed", F.when(F.col("doc_id") % 7 == 3, F.col("original")).otherwise(F.concat(F.replace("original", F.lit("the"), F.lit("that")), F.lit(" so"))))
    reason = F.when(F.col("target_perturbed").eqNullSafe(F.col("original")), "zero_edit").when(F.size(T.words(F.col("original"))) <= 0, "tokenization_failed")
    return t.withColumn("drop_reason", reason)


_P = """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN '' ELSE text END AS original FROM documents),
p AS (SELECT *, CASE WHEN doc_id % 7 = 3 THEN original ELSE replace(original, 'the', 'that') || ' so' END AS target_perturbed FROM t),
r AS (SELECT *, CASE WHEN target_perturbed IS NOT DISTINCT FROM original THEN 'zero_edit' WHEN NOT regexp_matches(original, '[^ \\t\\n\\x0B\\f\\r]') THEN 'tokenization_failed' END AS drop_reason FROM p)"""


@query(_P + " SELECT doc_id, md5(target_perturbed) AS digest FROM r WHERE drop_reason IS NULL")
def perturb_zero_edit_filter(spark, d):
    return perturbed(spark, d).where("drop_reason is null").select("doc_id", F.md5(F.col("target_perturbed").cast("binary")).alias("digest"))


@query(_P + " SELECT " + ", ".join(f"count(*) FILTER (WHERE drop_reason = '{x}') AS {x}" for x in G.DROP_REASONS) + " FROM r")
def drop_counts(spark, d):
    return G.drop_counts(perturbed(spark, d))


@query(_P + ", n AS (SELECT count(*) AS n FROM r), k AS (SELECT unnest(" + str(G.DROP_REASONS) + ") AS reason) SELECT k.reason, count(r.doc_id) AS count, round(count(r.doc_id) / any_value(n.n), 9) AS rate FROM k CROSS JOIN n LEFT JOIN r ON r.drop_reason = k.reason GROUP BY k.reason")
def drop_counts_table(spark, d):
    return G.drop_counts_table(perturbed(spark, d)).select("reason", "count", F.round("rate", 9).alias("rate"))


def _edits(spark, d):
    c = table(spark, d, "conversations").repartition(spark.sparkContext.defaultParallelism)
    return c.select("conv_id", "turn", T.words(F.col("text")).alias("a"), T.words(F.replace("text", F.lit("th"), F.lit("z"))).alias("b"))


# SQL's string distance counts bytes and has no letters for all tokens of a long text, so tests hold these against the two-row DP
@query()
def token_edit_distance(spark, d):
    return _edits(spark, d).select("conv_id", "turn", T.token_edit_distance(F.col("a"), F.col("b")).alias("distance"))


@query()
def token_edit_pct(spark, d):
    return _edits(spark, d).select("conv_id", "turn", F.round(T.token_edit_pct(F.col("a"), F.col("b")), 9).alias("pct"))


@query()
def token_edit_distance_all(spark, d):
    """Distance and percentage of every row, whatever its number of distinct tokens; tests hold them against the two-row DP."""
    c = _edits(spark, d).select("conv_id", "turn", F.size("a").alias("n"), T.token_edit_distance(F.col("a"), F.col("b")).alias("distance"))
    return c.select("conv_id", "turn", "distance", F.when(F.col("n") > 0, F.col("distance") / F.col("n") * 100.0).alias("pct"))


_INJECT = """CASE conv_id % 6 WHEN 0 THEN 'I cannot help with that. ' || text WHEN 1 THEN 'Unfortunately, I won''t. ' || text
  WHEN 2 THEN text || ' My apologies, I can''t.' WHEN 3 THEN 'As an AI, no. ' || text ELSE text END"""


@query(f"""WITH t AS (SELECT conv_id, turn, lower(trim({_INJECT})) AS t FROM conversations)
SELECT conv_id, turn, regexp_matches(t, '^({"|".join(T.REFUSAL_PHRASES).replace("'", "''")})') OR regexp_matches(t, '^as an ai([,\\s]|$)') OR regexp_matches(t, '^as a language model([,\\s]|$)')
  OR regexp_matches(t, '\\bi''?m sorry,? but i (cannot|can not|can''t|won''t)\\b') OR regexp_matches(t, '\\bunfortunately,? i (cannot|can''?t|won''?t)\\b')
  OR regexp_matches(t, '\\bmy apologies,? i (cannot|can''?t)\\b') OR regexp_matches(t, '\\bi (am unable|am not able|won''?t|can''?t|refuse) to (help|assist|do)\\b')
  OR regexp_matches(t, '^sorry,? i (cannot|can''?t|won''?t)\\b') AS refusal FROM t""")
def refusal_flag(spark, d):
    k, t = F.col("conv_id") % 6, F.col("text")
    text = F.when(k == 0, F.concat(F.lit("I cannot help with that. "), t)).when(k == 1, F.concat(F.lit("Unfortunately, I won't. "), t)).when(k == 2, F.concat(t, F.lit(" My apologies, I can't."))).when(k == 3, F.concat(F.lit("As an AI, no. "), t)).otherwise(t)
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_refusal(text, ascii_only=True).alias("refusal"))


@query("""WITH a AS (SELECT doc_id AS sample_id, k AS attempt, ((doc_id * 7 + k * 13) % 40)::DOUBLE AS actual, (doc_id % 20 + 10)::DOUBLE AS target FROM documents, (SELECT unnest([1,2,3,4,5]) AS k)),
r AS (SELECT *, abs(actual - target) AS dev, row_number() OVER (PARTITION BY sample_id ORDER BY actual > target, abs(actual - target), attempt) AS n FROM a)
SELECT sample_id, attempt, actual AS actual_pct, dev AS deviation FROM r WHERE n = 1""")
def best_undershoot(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("attempt"))
    t = t.select("sample_id", "attempt", F.lit("").alias("text"), ((F.col("sample_id") * 7 + F.col("attempt") * 13) % 40).cast("double").alias("actual_pct"), (F.col("sample_id") % 20 + 10).cast("double").alias("target_pct"))
    return paraphrase.best_undershoot(t).select("sample_id", "attempt", "actual_pct", "deviation")


@query()
def paraphrase_select(spark, d):
    """Candidates of each message change every j-th token; tests hold the choice against the online loop."""
    t = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), F.col("text").alias("original"))
    t = t.where(T.has_words(F.col("original"))).repartition("sample_id")  # before candidates are made, so that these stay where their samples are
    samples = t.withColumn("target_edit_pct", (F.col("sample_id") % 4 * 10 + 5).cast("double"))
    every = F.explode(F.array(*(F.struct(F.lit(k).alias("attempt"), F.lit(j).alias("j")) for k, j in enumerate((20, 10, 7, 4, 3), 1)))).alias("c")
    cand = t.select("sample_id", T.words(F.col("original")).alias("words")).select("sample_id", every, "words").select("sample_id", "c.attempt", F.array_join(F.transform("words", lambda w, i: F.when(i % F.col("c.j") == 0, F.concat(w, F.lit("x"))).otherwise(w)), " ").alias("text"))
    out = paraphrase.select_paraphrase(samples, cand, tolerance=1.0, max_retries=4)
    return out.select("sample_id", F.round("baseline_edit_pct", 9).alias("baseline_edit_pct"), "baseline_refused", "retries_used")


@query("""SELECT doc_id, (('0x' || substr(sha256('[42, "' || doc_id || '"]'), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT AS seed FROM documents""")
def derive_seed(spark, d):
    return table(spark, d, "documents").select("doc_id", T.seed_column_ascii(42, F.col("doc_id").cast("string")).alias("seed"))


@query("""SELECT vec_id AS sample_id, sha256('{"classes":"[\\"A\\", \\"B\\"]","mode":"classification","model":"m","prompt":"p' || vec_id || '","seed":"' || (vec_id * 3) || '","stage":"1"}') AS key FROM embeddings""")
def cache_key(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), T.inference_key(F.concat(F.lit("p"), F.col("vec_id").cast("string")), "m", "classification", ["A", "B"], F.col("vec_id") * 3).alias("key"))


@query("""SELECT n_nationkey, 'In ' || n_name || ' {' || n_regionkey || '}: ' || coalesce(n_name, 'None') AS prompt FROM nation""")
def prompt_render(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", T.render("In {n_name} {{{n_regionkey}}}: {n_name}", {c: F.col(c) for c in n.columns}, dict(n.dtypes)).alias("prompt"))


@query("""SELECT conv_id, turn, nullif(regexp_extract(upper(text) || ' B', '\\b([A-D])\\b', 1), '') AS label FROM conversations""")
def label_extract(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.extract_letter(F.concat(F.upper("text"), F.lit(" B"))).alias("label"))


@query("""SELECT conv_id, turn, coalesce(nullif(regexp_extract(text, '\\b([A-D])\\b', 1), ''), 'old') AS label FROM conversations""")
def reextract_labels(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(T.extract_letter(F.col("text")), F.lit("old")).alias("label"))


@query("""SELECT n_nationkey, array_to_string(list_transform(string_split(trim('the ' || n_name), ' '), lambda w: CASE lower(w) WHEN 'the' THEN 'a' WHEN 'france' THEN 'spain' ELSE w END), ' ') AS t FROM nation""")
def word_swap(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.swap_words(F.concat(F.lit("the "), "n_name"), {"the": "a", "france": "spain"}).alias("t"))


@query(_E + ", u AS (SELECT sample_id, unnest([{'arm': 'original', 'l': lo}, {'arm': 'target', 'l': lt}, {'arm': 'baseline', 'l': lb}]) AS r FROM s) SELECT sample_id, r.arm AS arm, r.l AS label FROM u")
def arm_fanout(spark, d):
    return arms.fan_out(arm_columns(spark, d), {"original": "label_orig", "target": "label_target", "baseline": "label_base"}, value="label")


@query(_E + " SELECT sample_id, lo AS label_orig, lt AS label_target, lb AS label_base FROM s")
def arm_pivot(spark, d):
    return arms.fan_in(arm_fanout(spark, d), "label")


_WORK = "WITH w AS (SELECT doc_id AS key FROM documents), c AS (SELECT doc_id AS key, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE n_chars END AS value FROM documents WHERE doc_id % 2 = 0)"


def _cache(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("key")), t.where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 6 != 0, F.col("n_chars")).alias("value"))


@query(_WORK + " SELECT w.key, c.value, c.key IS NOT NULL AS hit FROM w LEFT JOIN c ON w.key = c.key")
def cache_hits(spark, d):
    return arms.lookup(*_cache(spark, d)).select("key", "value", "hit")


@query(_WORK + " SELECT key FROM w WHERE key NOT IN (SELECT key FROM c)")
def cache_misses(spark, d):
    return arms.missing_work(*_cache(spark, d))


@query(_WORK + " SELECT key FROM w WHERE key IN (SELECT key FROM c)")
def cache_probe(spark, d):
    return arms.present(*_cache(spark, d))


@query("""WITH t AS (SELECT vec_id AS sample_id, round(embedding[1]::DOUBLE, 6) AS a, round(embedding[2]::DOUBLE, 6) AS b FROM embeddings)
SELECT sample_id, CASE WHEN sample_id % 5 <> 4 THEN round(exp(a) / (exp(a) + exp(b)), 9) END AS p_a, sample_id % 5 = 4 AS missing, 'ok ' || sample_id AS content FROM t""")
def response_parse(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), *(F.round(F.get("embedding", F.lit(i)).cast("double"), 6).alias(c) for i, c in enumerate("ab")))
    tok = lambda t, p: F.concat(F.lit('{"token":"'), t, F.lit('","logprob":'), p.cast("string"), F.lit("}"))
    second = F.when(F.col("sample_id") % 5 == 4, "B").otherwise(" B")
    top = F.concat_ws(",", tok(F.lit(" A"), F.col("a")), tok(F.lit(" A"), F.lit(-50.0)), tok(second, F.col("b")))
    js = F.concat(F.lit('{"choices":[{"message":{"content":"ok '), F.col("sample_id").cast("string"), F.lit('"},"logprobs":{"content":[{"token":"x","logprob":0,"top_logprobs":['), top, F.lit("]}]}}]}"))
    e = e.withColumn("response", js)
    p = A.softmax(R.class_logprobs(R.top_logprobs(F.col("response")), ["A", "B"]))
    return e.select("sample_id", F.round(F.get(p, F.lit(0)), 9).alias("p_a"), p.isNull().alias("missing"), R.generation_text(F.col("response")).alias("content"))


@query("""SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN 'nan' WHEN isinf(value) THEN 'inf' WHEN value = 0 THEN 'zero' END AS kind FROM events""")
def validate_direction(spark, d):
    return table(spark, d, "events").select("event_id", V.direction_kind(F.col("value")).alias("kind"))


@query("SELECT event_type AS value, count(*) AS count FROM events WHERE coalesce(event_type NOT IN ('click', 'view'), true) GROUP BY 1")
def validate_outcome(spark, d):
    return V.outcome_offenders(table(spark, d, "events"), "event_type", ["click", "view"])


@query("SELECT user_id AS id, count(*) AS count FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return V.duplicate_ids(table(spark, d, "events"), "user_id")


@query("SELECT substr(n_name, 1, 1) AS first_token, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 1")
def class_collisions(spark, d):
    return table(spark, d, "nation").groupBy(F.substring("n_name", 1, 1).alias("first_token")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""WITH t AS (SELECT doc_id, (doc_id % 30)::DOUBLE AS t, (doc_id % 29)::DOUBLE AS b, doc_id % 53 AS k, doc_id % 53 = 51 AS f FROM documents)
SELECT count(*) AS n, round(avg(t), 6) AS target_mean, round(stddev_samp(t), 6) AS target_sd, round(avg(b), 6) AS baseline_mean, round(stddev_samp(b), 6) AS baseline_sd,
round(avg((abs(b - t) <= 0.5)::INT), 6) AS within_tolerance, count(*) FILTER (WHERE k > 50) AS retries_hit, count(*) FILTER (WHERE f) AS refused FROM t""")
def edit_stats(spark, d):
    i = F.col("doc_id")
    t = table(spark, d, "documents").select((i % 30).cast("double").alias("target_edit_pct"), (i % 29).cast("double").alias("baseline_edit_pct"), (i % 53).alias("retries_used"), (i % 53 == 51).alias("baseline_refused"))
    return G.edit_stats(t).select("n", *(F.round(c, 6).alias(c) for c in ("target_mean", "target_sd", "baseline_mean", "baseline_sd", "within_tolerance")), "retries_hit", "refused")


_OBSERVED = ", f AS (SELECT avg((lo <> lt)::INT) - avg((lo <> lb)::INT) AS v FROM s)"


@query(_E + _OBSERVED + " SELECT 'flip_rate' AS metric, round(v, 9) AS statistic, (SELECT count(*) FROM s) AS n FROM f")
def bootstrap_observed(spark, d):
    r = _boot(spark, d, ["flip_rate"], 20)[0]
    return spark.createDataFrame([(r.metric, round(r.statistic, 9), r.n)], "metric string, statistic double, n long")


def _boot(spark, d, metrics, n=1000):
    return bootstrap.bootstrap_diff(arm_columns(spark, d), metrics, order="sample_id", n_bootstrap=n)


def _boot_query(metric):
    def run(spark, d):
        e = arm_columns(spark, d).withColumns({f"label_{s}": F.when(F.col(f"label_{s}").isin("A", "B"), "lo").otherwise("hi") for s in arms.ARMS.values()})
        diffs, _, _ = bootstrap.resamples(e, [metric], "sample_id", ("label_orig", "label_target", "label_base"), 1000, 42)
        return bootstrap.summary(diffs)

    run.__name__ = f"bootstrap_{metric}"
    return query()(run)


for _m in bootstrap.METRICS:
    _boot_query(_m)


@query(_E + f", x AS (SELECT {_jsd('po', 'pt')} - {_jsd('po', 'pb')} AS v FROM s) SELECT 'jsd' AS metric, 'paired_t' AS test, round(avg(v) / (stddev_samp(v) / sqrt(count(*))), 6) AS statistic, count(*) AS n, 7::BIGINT AS n_dropped, false AS degenerate FROM x")
def summary_table(spark, d):
    e = arm_columns(spark, d)
    r = tests.paired_t(e, A.jsd(F.col("probs_orig"), F.col("probs_target")), A.jsd(F.col("probs_orig"), F.col("probs_base")), "jsd")
    return Report([r], {"n_input": r.n + 7}).summary_table(spark).select("metric", "test", F.round("statistic", 6).alias("statistic"), "n", "n_dropped", "degenerate")


@query("SELECT 'n_input' AS key, count(*)::VARCHAR AS value FROM documents UNION ALL SELECT 'mode', '\"classification\"' UNION ALL SELECT 'rate', 'null'")
def metadata_kv(spark, d):
    n = table(spark, d, "documents").count()
    return spark.createDataFrame(Report([], {"n_input": n, "mode": "classification", "rate": float("nan")}).metadata_rows(), "key string, value string")


@query("SELECT event_id, CASE WHEN isfinite(value) THEN value END AS value FROM events")
def json_safe(spark, d):
    return table(spark, d, "events").select("event_id", R.json_safe(F.col("value")).alias("value"))


@query("SELECT metric, statistic FROM (VALUES ('jsd', 1.0::DOUBLE), ('kl', 2.0), ('jsd', 1.0)) v(metric, statistic)")
def report_merge(spark, d):
    one, two = (TestResult(m, "paired_t", s, 0.5, "two_sided", 3) for m, s in (("jsd", 1.0), ("kl", 2.0)))
    return Report([one, two], {"seed": 1}).merge(Report([one], {"seed": 2})).summary_table(spark).select("metric", "statistic")


@query(_E + """, p AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS row_pos FROM s) SELECT sample_id, row_pos FROM p""")
def row_positions(spark, d):
    from ..sources.tables import with_position

    return with_position(arm_columns(spark, d).select("sample_id"), "sample_id").select("sample_id", "row_pos")


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def value_counts(spark, d):
    return G.value_counts(table(spark, d, "events"), "event_type").select(F.col("value").alias("event_type"), "count")
