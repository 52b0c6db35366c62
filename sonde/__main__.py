"""Command line: python -m sonde {preprocess,split,process,kmeans,detect,search,query} ..."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from sonde.functions.contracts import Params, declared_categorical
from sonde.operators.splitting import CUTS
from sonde.plans import detectors, preparation
from sonde.plans.search import Grid, search


def session(name: str, workers: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.legacy.parquet.nanosAsLong", "false")
    return builder.master(f"local[{workers}]").getOrCreate() if workers else builder.getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sonde", description=__doc__)
    top.add_argument("--workers", default="", help="run on this many local cores instead of a cluster")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("preprocess")
    p.add_argument("dataset", choices=("swat", "hai", "esa"))
    p.add_argument("--source", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--recordings", nargs="*", default=[])
    p.add_argument("--labelled")
    p.add_argument("--labels")
    p.add_argument("--target-only", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p = sub.add_parser("split")
    p.add_argument("dataset", choices=tuple(CUTS))
    p.add_argument("--source", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--overwrite", action="store_true")
    p = sub.add_parser("process")
    p.add_argument("dataset", choices=tuple(CUTS))
    p.add_argument("--split-dir", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--categorical", required=True, help="a YAML or JSON file with a list for each dataset")
    p.add_argument("--overwrite", action="store_true")
    for name in ("kmeans", "detect", "search"):
        p = sub.add_parser(name)
        p.add_argument("--split-dir", required=True)
        p.add_argument("--reports-dir", required=True)
        p.add_argument("--dataset", required=True)
        p.add_argument("--categorical", required=True)
        p.add_argument("--window-steps", type=int)
        p.add_argument("--params", help="a YAML or JSON file with settings")
        if name == "kmeans":
            p.add_argument("--models-dir", required=True)
            p.add_argument("--k", type=int, nargs="*")
        if name == "detect":
            p.add_argument("--stage", choices=("select", "final"), default="select")
            p.add_argument("--selected", help="a search report whose best run is used")
            p.add_argument("--min-similarity", type=float)
        if name == "search":
            p.add_argument("--runs", type=int, default=15)
            p.add_argument("--seed", type=int, default=42)
    p = sub.add_parser("query", help="run a query of the catalogue and show its first rows")
    p.add_argument("name")
    p.add_argument("folder")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session(f"sonde-{a.command}", a.workers)
    if a.command == "preprocess":
        if a.dataset == "swat":
            job = preparation.SwatPreprocessor(spark, a.source, a.out, a.dataset)
        elif a.dataset == "hai":
            job = preparation.HaiPreprocessor(spark, a.source, a.out, a.dataset, recordings=a.recordings, labelled=a.labelled, labels=a.labels)
        else:
            job = preparation.EsaPreprocessor(spark, a.source, a.out, a.dataset, target_only=a.target_only)
        print(job.run(a.overwrite))
    elif a.command == "split":
        first = preparation.ESA_START if a.dataset == "esa" else None
        print(preparation.Splitter(spark, a.source, a.out, *CUTS[a.dataset], name=a.dataset, first=first).run(a.overwrite))
    elif a.command == "process":
        kind = preparation.EsaProcessor if a.dataset == "esa" else preparation.Processor
        print(kind(spark, a.split_dir, a.out, a.dataset, declared_categorical(a.dataset, a.categorical)).run(a.overwrite))
    elif a.command == "query":
        from sonde.plans.queries import QUERIES

        QUERIES[a.name](spark, a.folder).show(20, truncate=False)
    else:
        values = Params.load(a.params).to_dict() if a.params else {}
        common = {"categorical": declared_categorical(a.dataset, a.categorical), "dataset": a.dataset, "window_steps": a.window_steps}
        flat = {k: v for k, v in values.items() if k in detectors.DEFAULTS}
        if a.command == "kmeans":
            report = detectors.train_k_means(spark, a.split_dir, a.models_dir, a.reports_dir, **common, **flat, **({"k_values": a.k} if a.k else {}))
        elif a.command == "detect":
            chosen = json.loads(Path(a.selected).read_text())["best"] if a.selected else None
            network = detectors.network_settings({**values, **((chosen or {}).get("config") or {})})
            extra = {**flat, **({"min_similarity": a.min_similarity} if a.min_similarity is not None else {})}
            report = detectors.train_detector(spark, a.split_dir, a.reports_dir, stage=a.stage, selected=chosen, network=network, **common, **extra)
        else:
            grid = Grid(values.get("grid") or {}, a.dataset)

            def trial(config: dict) -> dict:
                given = {k: v for k, v in config.items() if k in detectors.DEFAULTS}
                got = detectors.train_detector(spark, a.split_dir, a.reports_dir, network=detectors.network_settings({**values, **config}), **common, **{**flat, **given})
                return {**got["metrics"]["validation"], "epoch": got["epoch"], "edges": got["graph"]["edges"]}

            report = search(trial, grid.drawn(a.runs, a.seed), Path(a.reports_dir) / f"search_{a.dataset}.json")
        print(json.dumps(report.get("best") or report.get("metrics") or report.get("test"), default=str))


if __name__ == "__main__":
    main()
