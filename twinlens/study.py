"""A counterfactual study: perturb, calibrate a paraphrase, ask the model three times, test.

Stages are DataFrames. What a model or user function made is written before anything branches off it, as it may not be
repeatable; the written tables live under spark.checkpoint.dir or the study's own cache folder.
"""

from __future__ import annotations

import json
import logging
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .errors import ConfigError, StageNotRunError, TwinlensError
from .functions import arrays as A, text as T
from .models.base import ModelBackend, Tokenizer
from .models.lexical import LexicalTokenizer
from .operators import aggregates, paraphrase as P, tests, validate as V
from .operators.arms import ARMS
from .operators.bootstrap import ENGINES, METRICS, bootstrap_diff
from .report import Report
from .sources.tables import KeyedCache, with_position

log = logging.getLogger("twinlens")
SHOWN_FAILURES, LOGGED, LISTED = 3, 10, 10_000


def guarded(fn: Callable, c: Column, kind: str = "string") -> Column:
    """A user function over a column, in Arrow batches: struct<value, error>. A Column function is used as it is."""
    if getattr(fn, "native", False):
        return F.struct(fn(c).alias("value"), F.lit(None).cast("string").alias("error"))

    @F.pandas_udf(f"value {kind}, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            try:
                out.append((fn(t), None))
            except Exception as e:  # becomes a drop with a reason
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"])

    return run.asNondeterministic()(c)


def native(fn: Callable[[Column], Column]) -> Callable:
    """Mark a Column function, so that it stays in the JVM."""
    fn.native = True
    return fn


class Study:
    """One study over ``data``: ``key`` names the unique id column, ``target_model`` and ``paraphrase_model`` are factories."""

    def __init__(self, data: DataFrame, *, key: str, perturb_column: str, target_perturbation: Callable, prompt_template: str, target_model: Callable[[], ModelBackend] | None = None, paraphrase_model: Callable[[], ModelBackend] | None = None, tokenizer: Tokenizer | None = None, classes: list[str] | None = None, extract_label: Callable | None = None, direction_column: str | None = None, outcome_class_column: str | None = None, alternative: str | None = None, tolerance: float = 0.5, max_retries: int = 50, seed: int = 42, n_bootstrap: int = 1000, bootstrap_engine: str = "exact", cache_dir: str | None = None):
        self.mode = V.check_mode(classes, extract_label)
        if bootstrap_engine not in ENGINES:
            raise ConfigError(f"unknown bootstrap engine {bootstrap_engine!r}: use one of {ENGINES}")
        V.check_columns(data, perturb_column)
        if key not in data.columns:
            raise ConfigError(f"id column {key!r} is not among {data.columns}")
        V.check_unique(data, key)
        self.directional = V.check_directional(data, direction_column, outcome_class_column, alternative, classes, key)
        self.spark, self.data, self.key, self.perturb_column = data.sparkSession, data, key, perturb_column
        self.target_perturbation, self.template = target_perturbation, prompt_template
        T.render(prompt_template, {c: F.col(c) for c in data.columns})
        self.target_model, self.paraphrase_model, self.tokenizer = target_model, paraphrase_model, tokenizer or LexicalTokenizer()
        self.classes, self.extract_label = classes, extract_label
        self.direction_column, self.outcome_class_column, self.alternative = direction_column, outcome_class_column, alternative
        self.tolerance, self.max_retries, self.seed, self.n_bootstrap, self.bootstrap_engine, self.cache_dir = tolerance, max_retries, seed, n_bootstrap, bootstrap_engine, cache_dir
        self.cache_ids = {"tokenizer": self.tokenizer.cache_id, "target_model": self._identity(target_model), "paraphrase_model": self._identity(paraphrase_model)}
        self.loaded_ids: dict | None = None
        self.allow_cache_id_mismatch = False
        self.drop_counts = dict.fromkeys(aggregates.DROP_REASONS, 0)
        self._baselines: DataFrame | None = None
        self._inference: DataFrame | None = None
        if classes is not None and target_model is not None:
            with target_model() as m:
                m.validate_classes(classes)

    @staticmethod
    def _identity(factory: Callable | None) -> str | None:
        if factory is None:
            return None
        with factory() as m:
            return m.cache_id

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        root = self.cache_dir or self.spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = self.spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ConfigError("cache_dir or spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="twinlens-study-")
            self.spark.conf.set("spark.checkpoint.dir", root)
        path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _check_identity(self, *roles: str) -> None:
        for r in roles:
            if r != "tokenizer" and getattr(self, r) is None:
                raise StageNotRunError(f"this stage needs {r}; the study was loaded without it")
            if self.loaded_ids and self.loaded_ids.get(r) != self.cache_ids[r]:
                message = f"{r} is {self.cache_ids[r]!r}, the saved study's was {self.loaded_ids.get(r)!r}"
                if not self.allow_cache_id_mismatch:
                    raise ConfigError(message)
                log.warning(message)

    @property
    def baselines_df(self) -> DataFrame | None:
        return self._baselines

    @property
    def refused_df(self) -> DataFrame | None:
        """Ids of all samples with a refused baseline; the report lists the ``LISTED`` smallest and says if there are more."""
        return self._baselines.where("baseline_refused").select("sample_id") if self._baselines is not None else None

    @property
    def inference_df(self) -> DataFrame | None:
        return self._inference

    def generate_baselines(self) -> DataFrame:
        """Perturbed texts, edit percentages and calibrated paraphrases of the samples that can have them."""
        if self._baselines is not None:
            return self._baselines
        self._check_identity("tokenizer", "paraphrase_model")
        rows = self.data.withColumns({"sample_id": F.col(self.key), "original": F.col(self.perturb_column)})
        rows = rows.withColumn("_t", guarded(self.target_perturbation, F.col("original")))
        rows = rows.withColumns({"target_perturbed": F.col("_t.value"), "_error": F.col("_t.error")}).drop("_t")
        rows = rows.withColumns({"_o": self.tokenizer.as_column(F.col("original")), "_p": self.tokenizer.as_column(F.col("target_perturbed"))})
        reason = F.when(F.col("_error").isNotNull(), "tokenization_failed").when(F.col("target_perturbed").eqNullSafe(F.col("original")), "zero_edit")
        reason = reason.when(F.col("_o").isNull() | F.col("_p").isNull() | (F.size("_o") == 0), "tokenization_failed")
        rows = self._write(rows.withColumns({"drop_reason": reason, "target_edit_pct": T.token_edit_pct(F.col("_o"), F.col("_p"))}).drop("_o", "_p"), "perturbed")
        self._count(rows, ("zero_edit", "tokenization_failed"))
        kept = rows.where("drop_reason is null").drop("drop_reason", "_error")
        kept = kept.withColumn("seed", T.seed_column(self.seed, F.col("sample_id").cast("string")))
        ids = self.cache_ids
        kept = kept.withColumn("key", T.paraphrase_key(F.col("original"), F.col("target_perturbed"), F.col("target_edit_pct"), ids["paraphrase_model"], ids["tokenizer"], self.tolerance, self.max_retries, F.col("seed")))
        made = self._through_cache(kept, "paraphrase", "baseline_perturbed string, baseline_edit_pct double, baseline_refused boolean, retries_used int", lambda d: P.generate_paraphrases(d, self.paraphrase_model, self.tokenizer.encode, self.tolerance, self.max_retries))
        self._baselines = self._write(made.drop("key", "seed"), "baselines")
        refused = self._baselines.where("baseline_refused").count()
        if refused:
            log.warning("%s samples had every paraphrase refused and keep their original", refused)
        return self._baselines

    def _through_cache(self, work: DataFrame, space: str, schema: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        names = [f.split()[0] for f in schema.split(", ")]
        if not self.cache_dir:
            return make(work)
        cache = KeyedCache(self.spark, f"{self.cache_dir.rstrip('/')}/{space}", schema)
        known = cache.read()
        fresh = self._write(make(work.join(known.select("key"), "key", "left_anti")), f"fresh-{space}")
        cache.append(fresh.select("key", *names).dropDuplicates(["key"]))
        return work.join(known, "key").select(*fresh.columns).unionByName(fresh)

    def _count(self, rows: DataFrame, reasons: tuple[str, ...]) -> None:
        got = aggregates.drop_counts(rows).first()
        self.drop_counts |= {r: got[r] for r in reasons}

    def run_inference(self) -> DataFrame:
        """Class probabilities or texts of the three prompts of each sample, with their labels."""
        if self._inference is not None:
            return self._inference
        self._check_identity("target_model")
        base = self.generate_baselines()
        kinds = dict(self.data.dtypes)
        texts = {"original": "original", "target": "target_perturbed", "baseline": "baseline_perturbed"}
        rows = base
        for arm, c in texts.items():
            columns = {n: F.col(n) for n in self.data.columns} | {self.perturb_column: F.col(c)}
            rows = rows.withColumn(f"_prompt_{arm}", T.render(self.template, columns, kinds))
        pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"_prompt_{a}").alias("prompt")) for a in texts))).alias("w")
        work = rows.select("sample_id", pairs).select("sample_id", "w.arm", "w.prompt")
        work = work.withColumn("seed", T.seed_column(self.seed, F.col("sample_id").cast("string"), F.col("arm")))
        work = work.withColumn("key", T.inference_key(F.col("prompt"), self.cache_ids["target_model"], self.mode, self.classes, F.col("seed")))
        value = "probs array<double>" if self.classes else "generation string"
        long = self._write(self._through_cache(work, f"inference-{self.mode}", value, self._ask), "answers")
        name = value.split()[0]
        wide = long.groupBy("sample_id").agg(*(F.max_by(name, F.when(F.col("arm") == a, 1)).alias(f"{name}_{s}") for a, s in ARMS.items()))
        rows = base.join(wide, "sample_id")
        rows = self._label_scores(rows) if self.classes else self._label_texts(rows)
        self._count(rows, ("openai_missing_class",) if self.classes else ("extraction_returned_none", "extraction_raised"))
        self._all_rows = rows
        self._inference = self._write(rows.where("drop_reason is null").drop("drop_reason"), "inference")
        return self._inference

    def _ask(self, work: DataFrame) -> DataFrame:
        factory, classes = self.target_model, self.classes
        kind = "probs array<double>" if classes else "generation string"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with factory() as m:
                for b in batches:
                    prompts, seeds = b["prompt"].tolist(), [int(s) for s in b["seed"]]
                    if classes:
                        p = m.score_classes(prompts, classes, seeds)
                        yield b.assign(probs=[None if x is None or pd.isna(x).any() else list(map(float, x)) for x in p])
                    else:
                        yield b.assign(generation=m.generate(prompts, seeds))

        work = work.select("sample_id", "arm", "prompt", "seed", "key")
        return work.mapInPandas(run, f"sample_id {work.dtypes[0][1]}, arm string, prompt string, seed long, key string, {kind}")

    def _label_scores(self, rows: DataFrame) -> DataFrame:
        gone = A.missing(F.col("probs_orig")) | A.missing(F.col("probs_target")) | A.missing(F.col("probs_base"))
        return rows.withColumns({f"label_{s}": A.argmax_label(F.col(f"probs_{s}"), self.classes) for s in ARMS.values()} | {"drop_reason": F.when(gone, "openai_missing_class")})

    def _label_texts(self, rows: DataFrame) -> DataFrame:
        rows = self._write(rows.withColumns({f"_{s}": guarded(self.extract_label, F.col(f"generation_{s}")) for s in ARMS.values()}), "labels")
        first = F.coalesce(*(F.when(F.col(f"_{s}.error").isNotNull(), "extraction_raised").when(F.col(f"_{s}.value").isNull(), "extraction_returned_none") for s in ARMS.values()))
        for r in rows.where(F.coalesce(*(F.col(f"_{s}.error") for s in ARMS.values())).isNotNull()).select("sample_id", F.coalesce(*(F.col(f"_{s}.error") for s in ARMS.values())).alias("e")).limit(LOGGED).collect():
            log.warning("extract_label failed on sample %s: %s", r["sample_id"], r["e"])
        return rows.withColumns({"drop_reason": first} | {f"label_{s}": F.col(f"_{s}.value") for s in ARMS.values()}).drop(*(f"_{s}" for s in ARMS.values()))

    def test(self, metrics: list[str], regression_model: str = "difference") -> Report:
        """One result for each of ``metrics``: scalar moments in one pass, all label metrics in one bootstrap."""
        if regression_model not in ("difference", "level"):
            raise ConfigError("regression_model must be 'difference' or 'level'")
        V.check_metrics(metrics, self.mode, self.directional)
        if self._inference is None:
            raise StageNotRunError("run_inference has not run")
        df = self._inference
        n = df.count()
        if n < 2:
            raise TwinlensError(self._too_few(n))
        arms = {s: F.col(f"probs_{s}") for s in ARMS.values()}
        found: dict[str, tests.TestResult] = {}
        clipped = 0
        if self.classes:
            diffs = {m: f(arms["orig"], arms["target"]) - f(arms["orig"], arms["base"]) for m, f in (("jsd", A.jsd), ("kl", A.kl)) if m in metrics}
            d = df.select(A.any_clipped(*arms.values()).alias("clip"), *(c.alias(m) for m, c in diffs.items()))
            got = d.agg(F.count_if("clip").alias("clip"), *(f(m).alias(f"{m}_{k}") for m in diffs for k, f in (("mean", F.avg), ("sd", F.stddev_samp), ("lo", F.min), ("hi", F.max)))).first()
            clipped = got["clip"]
            for m in diffs:
                flat = got[f"{m}_lo"] == got[f"{m}_hi"] or not got[f"{m}_sd"]
                found[m] = tests.paired_t_from(m, n, got[f"{m}_mean"], got[f"{m}_sd"], None if flat else got[f"{m}_mean"] / (got[f"{m}_sd"] / n**0.5))
        labels = [m for m in dict.fromkeys(metrics) if m in METRICS]
        if labels:
            placed = with_position(df.select("sample_id", "label_orig", "label_target", "label_base"), "sample_id")
            found |= {r.metric: r for r in bootstrap_diff(placed, labels, n_bootstrap=self.n_bootstrap, seed=self.seed, engine=self.bootstrap_engine)}
        if "regression" in metrics:
            found["regression"] = self._regression(df, regression_model, n)
        return Report([found[m] for m in metrics], self._metadata(n, clipped))

    def _regression(self, df: DataFrame, model: str, n: int) -> tests.TestResult:
        y = {s: A.clipped_log(A.class_probability(F.col(f"probs_{s}"), self.classes, F.col(self.outcome_class_column))) for s in ARMS.values()}
        d = F.col(self.direction_column).cast("double")
        fit = tests.fit_difference(df, d, y["target"] - y["base"]) if model == "difference" else tests.fit_level(df, d, y["orig"], y["target"], y["base"])
        return tests.regression_test(fit, self.alternative, n)

    def _too_few(self, n: int) -> str:
        out = f"{n} samples are left of {self.data.count()}, two are needed; drops: {self.drop_counts}"
        if n == 0 and not self.classes and getattr(self, "_all_rows", None) is not None:
            some = self._all_rows.orderBy("sample_id").limit(SHOWN_FAILURES).select("generation_orig").collect()
            out += "; texts without a label: " + "; ".join(repr(t if len(t) <= 200 else t[:200] + "…") for (t,) in some)
        return out

    def _metadata(self, n: int, clipped: int) -> dict:
        stats = aggregates.edit_stats(self._baselines, self.tolerance, self.max_retries).first().asDict()
        refused = [r[0] for r in self.refused_df.orderBy("sample_id").limit(LISTED).collect()]
        n_input = self.data.count()
        return {"n_input": n_input, "n_tested": n, "mode": self.mode, "classes": self.classes, "seed": self.seed, "n_bootstrap": self.n_bootstrap, "bootstrap_engine": self.bootstrap_engine, "tolerance": self.tolerance, "max_retries": self.max_retries, "perturb_column": self.perturb_column, "prompt_template": self.template, "cache_ids": self.cache_ids, "drop_counts": dict(self.drop_counts), "refusal_count": stats["refused"], "refusal_rate": stats["refused"] / n_input if n_input else 0.0, "refused_samples": refused, "refused_samples_cut": stats["refused"] > LISTED, "edit": stats, "n_rows_clipped": clipped, "direction_column": self.direction_column, "outcome_class_column": self.outcome_class_column, "alternative": self.alternative, "version": T.PACKAGE_VERSION}

    def run_all(self, metrics: list[str], regression_model: str = "difference") -> Report:
        self.generate_baselines()
        self.run_inference()
        return self.test(metrics, regression_model)

    def reset_baselines(self) -> None:
        self._baselines = self._inference = None
        self.drop_counts = dict.fromkeys(aggregates.DROP_REASONS, 0)

    def reset_inference(self) -> None:
        self._inference = None
        self.drop_counts |= dict.fromkeys(("extraction_returned_none", "extraction_raised", "openai_missing_class"), 0)

    def reextract(self, extract_label: Callable) -> DataFrame:
        """New labels from the stored texts: an arm that fails keeps its old label; counts are per arm."""
        if self.mode != "free_form":
            raise ConfigError("only free-form studies have texts to extract labels from")
        if self._inference is None:
            raise StageNotRunError("run_inference has not run")
        rows = self._write(self._inference.withColumns({f"_{s}": guarded(extract_label, F.col(f"generation_{s}")) for s in ARMS.values()}), "reextract")
        raised = sum((F.count_if(F.col(f"_{s}.error").isNotNull()) for s in ARMS.values()), F.lit(0))
        none = sum((F.count_if(F.col(f"_{s}.error").isNull() & F.col(f"_{s}.value").isNull()) for s in ARMS.values()), F.lit(0))
        got = rows.agg(raised.alias("raised"), none.alias("none")).first()
        self.drop_counts |= {"extraction_raised": got["raised"], "extraction_returned_none": got["none"]}
        self.extract_label = extract_label
        self._inference = self._write(rows.withColumns({f"label_{s}": F.coalesce(F.col(f"_{s}.value"), F.col(f"label_{s}")) for s in ARMS.values()}).drop(*(f"_{s}" for s in ARMS.values())), "inference")
        return self._inference

    SAVED = ("mode", "key", "perturb_column", "template", "classes", "direction_column", "outcome_class_column", "alternative", "tolerance", "max_retries", "seed", "n_bootstrap", "bootstrap_engine", "directional", "drop_counts", "cache_ids")

    def save(self, path: str) -> None:
        """Data, frames, settings and counters, as Parquet and JSON: no functions, no models, no code."""
        frames = {"data": self.data, "baselines": self._baselines, "inference": self._inference}
        for name, df in frames.items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        config = {k: getattr(self, k) for k in self.SAVED} | {"frames": [k for k, v in frames.items() if v is not None]}
        self.spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, target_model=None, paraphrase_model=None, target_perturbation=None, extract_label=None, tokenizer=None, allow_cache_id_mismatch: bool = False) -> Study:
        config = {"bootstrap_engine": "exact"} | json.loads(spark.read.text(f"{path}/config").first()[0])  # not in older studies
        self = cls.__new__(cls)
        for k in cls.SAVED:
            setattr(self, k, config[k])
        frames = {k: spark.read.parquet(f"{path}/{k}") for k in config["frames"]}
        self.spark, self.data, self._baselines, self._inference = spark, frames["data"], frames.get("baselines"), frames.get("inference")
        self.target_model, self.paraphrase_model, self.target_perturbation, self.extract_label = target_model, paraphrase_model, target_perturbation, extract_label
        self.tokenizer, self.cache_dir, self.allow_cache_id_mismatch = tokenizer or LexicalTokenizer(), None, allow_cache_id_mismatch
        self.loaded_ids = config["cache_ids"]
        self.cache_ids = {"tokenizer": self.tokenizer.cache_id, "target_model": cls._identity(target_model), "paraphrase_model": cls._identity(paraphrase_model)}
        return self
