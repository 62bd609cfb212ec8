"""Command line: group (folder to report), predict (folder to predictions), score (predictions against a manifest)."""

from __future__ import annotations

import argparse
import os
from dataclasses import fields, replace

from pyspark.sql import SparkSession

from vistaspark.config import EngineConfig, Thresholds
from vistaspark.operators.cluster import groups_report
from vistaspark.operators.evaluate import exact_set_score
from vistaspark.plans.grouping import group, group_core
from vistaspark.progress import progress
from vistaspark.sources import images, sheets, tables
from vistaspark.sources.workspace import ship_package


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vistaspark")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("group")
    g.add_argument("folder")
    g.add_argument("output")
    g.add_argument("--recursive", action="store_true")
    g.add_argument("--skip-contact-sheets", action="store_true")
    g.add_argument("--max-size", type=int, default=1024)
    g.add_argument("--features-per-variant", type=int, default=2500)
    g.add_argument("--max-candidates", type=int, default=40)
    g.add_argument("--disable-pruning", action="store_true")
    g.add_argument("--pair-cache")
    g.add_argument("--jobs", type=int)
    for f in fields(Thresholds):
        g.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    w = sub.add_parser("predict")
    w.add_argument("folder")
    w.add_argument("output")
    w.add_argument("--jobs", type=int)
    for f in fields(EngineConfig):
        if f.name != "thresholds":
            kind = str if f.default is None else (lambda x: x not in ("0", "false", "")) if isinstance(f.default, bool) else type(f.default)
            w.add_argument("--" + f.name.replace("_", "-"), type=kind, default=f.default)
    s = sub.add_parser("score")
    s.add_argument("predictions")
    s.add_argument("manifest")
    s.add_argument("--output")
    return p


def summary(row) -> str:
    return "\n".join([
        f"predicted_groups={row['predicted_groups']}", f"reference_groups={row['truth_groups']}", f"exact_matches={row['exact_matches']}",
        f"missed_groups={row['truth_groups'] - row['exact_matches']}", f"extra_groups={row['predicted_groups'] - row['exact_matches']}", f"score={row['score']:.6f}"])


#: Libraries that would start a thread for each core inside every task.
THREADS = ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")


def session(jobs: int | None) -> SparkSession:
    """A session whose Python workers compute in one thread a task; ``jobs``: tasks at a time where this machine is all there is."""
    builder = SparkSession.builder.appName("vistaspark")
    for name in THREADS:
        builder = builder.config(f"spark.executorEnv.{name}", "1")
        os.environ.setdefault(name, "1")
    if jobs is not None:
        builder = builder.master(f"local[{max(1, jobs)}]")
    return builder.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session(getattr(a, "jobs", None))
    ship_package(spark)
    with progress(spark.sparkContext, a.command):
        return _run(spark, a)


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "group":
        t = Thresholds(**{f.name: getattr(a, f.name) for f in fields(Thresholds)})
        cfg = replace(EngineConfig(), thresholds=t, max_size=a.max_size, features_per_variant=a.features_per_variant, max_candidates=a.max_candidates, disable_pruning=a.disable_pruning, pair_cache_path=a.pair_cache)
        found = images.read_images(spark, a.folder, a.recursive)
        assigned, scores, _ = group_core(found, cfg)
        tables.write_report(groups_report(assigned), f"{a.output}/angle_groups")
        tables.write_pair_scores(scores, f"{a.output}/pair_scores")
        if not a.skip_contact_sheets:
            sheets.write_sheets(sheets.contact_sheets(found, assigned), f"{a.output}/review")
    elif a.command == "predict":
        cfg = EngineConfig(**{f.name: getattr(a, f.name) for f in fields(EngineConfig) if f.name != "thresholds"})
        found = images.read_images(spark, a.folder, False, images.WRAPPER_SUFFIXES)
        tables.write_predictions(group(found, cfg).select("group_id", "filename"), a.output)
    else:
        text = summary(exact_set_score(tables.read_groups(spark, a.predictions), tables.read_groups(spark, a.manifest)).first())
        print(text)
        if a.output:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
