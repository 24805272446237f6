"""Commands: validate, init, run."""

from __future__ import annotations

import argparse
import os
import sys

from pydantic import ValidationError
from pyspark.cloudpickle import register_pickle_by_value

from . import set_log_level
from .config import StudyConfig, model_factory, resolve
from .errors import TwinlensError
from .sources.tables import load_yaml, read_table

TEMPLATE = """data: data.csv
key: id
perturb_column: text
target_perturbation: perturbations:perturb
prompt_template: "{text}\\nAnswer:"
target_model: {type: hash}
paraphrase_model: {type: hash}
"""
MODES = {"classification": "classes: [A, B]\nmetrics: [jsd, flip_rate]\n", "free_form": "extract_label: perturbations:label\nmetrics: [flip_rate, mi]\n"}
DIRECTIONAL = "direction_column: direction\noutcome_class_column: outcome\nalternative: greater\n"
FUNCTIONS = '''"""Functions of this study."""

import re

SWAP = {"he": "she", "she": "he", "his": "her", "her": "his"}


def perturb(text: str) -> str:
    return " ".join(SWAP.get(w.lower(), w) for w in text.split())


def label(response: str) -> str | None:
    found = re.search(r"\\b([A-D])\\b", response)
    return found[1] if found else None
'''
README = "# A counterfactual study\n\nPut the table into `data.csv`, edit `config.yaml` and `perturbations.py`, then `python -m twinlens.cli run config.yaml`.\n"
OUTPUTS = (".json", ".xlsx")


def _load(path: str) -> StudyConfig:
    return StudyConfig.model_validate(load_yaml(path))


def _functions(c: StudyConfig) -> None:
    sys.path.insert(0, os.getcwd())
    for spec in (c.target_perturbation, c.extract_label):
        if spec:
            resolve(spec)
    for m in (c.target_model, c.paraphrase_model):
        model_factory(m)


def _ship(c: StudyConfig) -> None:
    """Modules beside the study are sent with its functions, as executors do not have them."""
    here = os.path.join(os.path.realpath(os.getcwd()), "")
    for spec in (c.target_perturbation, c.extract_label, c.target_model.type, c.paraphrase_model.type):
        module = sys.modules.get((spec or "").partition(":")[0])
        if module and os.path.realpath(getattr(module, "__file__", None) or "").startswith(here):
            register_pickle_by_value(module)


def validate(path: str, imports: bool = True) -> None:
    c = _load(path)
    if imports:
        _functions(c)


def init(directory: str, mode: str = "classification", directional: bool = False) -> None:
    """A new project; files that are there are not overwritten."""
    body = TEMPLATE + MODES[mode] + (DIRECTIONAL if directional else "")
    files = {"config.yaml": body, "perturbations.py": FUNCTIONS, "README.md": README}
    there = [f for f in files if os.path.exists(os.path.join(directory, f))]
    if there:
        raise TwinlensError(f"{there} exist in {directory}")
    os.makedirs(directory, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(directory, name), "w", encoding="utf-8") as f:
            f.write(text)


def run(path: str, output: str, cache_dir: str | None = None, dry_run: bool = False, spark=None) -> None:
    from pyspark.sql import SparkSession

    from .study import Study

    if not output.lower().endswith(OUTPUTS):  # before the work, not after it
        raise TwinlensError(f"unsupported output {output!r}: use one of {OUTPUTS}")
    c = _load(path)
    _functions(c)
    if dry_run:
        return
    _ship(c)
    spark = spark or SparkSession.builder.appName("twinlens").getOrCreate()
    study = Study(
        read_table(spark, c.data), key=c.key, perturb_column=c.perturb_column, target_perturbation=resolve(c.target_perturbation), prompt_template=c.prompt_template,
        target_model=model_factory(c.target_model), paraphrase_model=model_factory(c.paraphrase_model), classes=c.classes, extract_label=resolve(c.extract_label) if c.extract_label else None,
        direction_column=c.direction_column, outcome_class_column=c.outcome_class_column, alternative=c.alternative, tolerance=c.tolerance, max_retries=c.max_retries, seed=c.seed, n_bootstrap=c.n_bootstrap, bootstrap_engine=c.bootstrap_engine, cache_dir=cache_dir or c.cache_dir,
    )
    report = study.run_all(c.metrics, c.regression_model)
    print(report)
    report.to_json(output) if output.lower().endswith(".json") else report.to_excel(output)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="twinlens")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate")
    v.add_argument("config")
    v.add_argument("--no-import", action="store_true")
    i = sub.add_parser("init")
    i.add_argument("directory")
    i.add_argument("--mode", choices=list(MODES), default="classification")
    i.add_argument("--directional", action="store_true")
    r = sub.add_parser("run")
    r.add_argument("config")
    r.add_argument("-o", "--output", default="report.json")
    r.add_argument("--cache-dir")
    r.add_argument("--dry-run", action="store_true")
    r.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    a = p.parse_args(argv)
    try:
        if a.command == "validate":
            validate(a.config, not a.no_import)
        elif a.command == "init":
            init(a.directory, a.mode, a.directional)
        else:
            set_log_level(a.log_level)
            run(a.config, a.output, a.cache_dir, a.dry_run)
    except (TwinlensError, ValidationError, ImportError, AttributeError, ValueError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
