"""Steps of an analysis, run in order in one session; each is a function of the session and the input folder."""

from __future__ import annotations

from collections.abc import Iterable

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalogue
from ..functions.frames import guarded
from .store import Store, hadoop_path, signature

STEPS = ("sites", "input_audit", "transitions", "model_predictions", "model_overlap", "model_tpr", "tpr_by_k", "model_four_tests", "corrected_in_window", "joint_results", "full_results_table")


def chosen(first: str | None = None, last: str | None = None, only: Iterable[str] | None = None) -> list[str]:
    """The steps to run, in order: all, those from `first` to `last`, or `only` some."""
    names = [*STEPS]
    for name in (first, last, *(only or ())):
        if name is not None and name not in names:
            raise ValueError(f"no step {name}")
    if only is not None:
        return [n for n in names if n in set(only)]
    return names[names.index(first) if first else 0 : names.index(last) + 1 if last else None]


#: Relations that steps share: whichever of them a step reads, it reads from the store.
SHARED = ("lines", "sites", "distances", "formcounts", "predictions")

def guards() -> dict[str, tuple[Column, str]]:
    """By step: what must hold of each row of its result, and what the failure says otherwise; nothing runs after a step that fails."""
    return {"input_audit": (F.coalesce("sound", F.lit(True)), "an antecedent inside the window isn't in its context")}


def run(spark: SparkSession, sf_dir: str, out: str, only: Iterable[str] | None = None, force: bool = False, *, first: str | None = None, last: str | None = None, form: str = "parquet") -> list[str]:
    """Write the chosen steps' results to out, as Parquet or CSV; the names of the steps that ran. Stops at the first failure.

    Steps that were done for the same rules, input files and form are left unless force. Lines, sites, distances and predictions are found once for all steps and later runs, in `_relations` below out.
    """
    root = out.rstrip("/")
    store, done = Store(spark, f"{root}/_relations"), []
    of_input = signature(spark, *[f"{sf_dir}/{t}.parquet" for t in catalogue.TABLES])
    for name in chosen(first, last, only):
        path = f"{root}/{name}"
        key = hashlib.sha256(f"{catalogue.spark_text(name)}{of_input}{form}".encode()).hexdigest()[:24]
        marker, system = hadoop_path(spark, f"{root}/_done/{name}-{key}")
        if not force and system.exists(marker) and system.exists(hadoop_path(spark, f"{path}/_SUCCESS")[0]):
            continue
        rows: DataFrame = catalogue.QUERIES[name](spark, sf_dir, store, SHARED)
        if name in guards():
            rows = guarded(rows, *guards()[name])
        rows.write.mode("overwrite").option("header", True).format(form).save(path)
        system.mkdirs(marker)
        done.append(name)
    return done
