"""Training procedures: the K-Means baseline and the graph detector.

`prepare` turns parts into scaled windows; `train_k_means` chooses k on validation and reports
on test; `train_detector` builds the neighbourhood graph, its clusters, placements and
subgraphs, fits the autoencoder and scores all parts. Stage "select" never reads the test
part; stage "final" adds the normal windows of validation and runs a fixed number of epochs.
"""

from __future__ import annotations

import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.functions import staging
from sonde.functions.contracts import TIME, Params, feature_columns, label_column, same_features
from sonde.functions.ordered import number_rows
from sonde.operators import centroids, density, metrics, neighbours, placement, scaling, subgraphs, windowing
from sonde.plans import autoencoder
from sonde.sources import readers, writers

DEFAULTS = {
    "k_values": [2, 4, 8, 16, 32, 64], "max_iter": 50, "seed": 42, "contaminated_refit": False, "scale_windows": True,
    "window_steps": {"swat": 60, "hai": 30, "esa": 33}, "min_coverage": 0.5,
    "bits": 16, "permutations": 10, "band": 20, "min_similarity": {"swat": 0.9858, "hai": 0.7367, "esa": 0.95},
    "min_pts": 10, "label_change_rate": 0.05, "attach_to": "clustered", "train_examples": None,
}


def settings(file: Params | None = None, **given) -> dict:
    """Defaults, then a file's values, then what is given and not None."""
    return DEFAULTS | (file.to_dict() if file else {}) | {k: v for k, v in given.items() if v is not None}


def of_dataset(value, dataset: str):
    return value.get(dataset.split("_")[0]) if isinstance(value, dict) else value


def prepare(spark: SparkSession, files: dict[str, str], categorical: list[str], window_steps: int, parts: tuple[str, ...], features: list[str] | None = None, scale: bool = True, statistics: dict | None = None, min_coverage: float = 0.0) -> dict:
    """Windows of each part: frames of (_id, datetime, y, _vec), the feature names and the scaling."""
    frames, names, label = {}, None, None
    first = spark.read.parquet(files[parts[0]])
    period = windowing.sampling_period(first)
    for p in parts:
        df = spark.read.parquet(files[p])
        label = label_column(df.columns)
        frames[p], names = windowing.window(df, feature_columns(df.columns), window_steps, label, categorical, min_coverage, period)
        frames[p] = staging.save(frames[p].withColumnRenamed(label, "y"), f"windows-{p}")
    if features is not None:
        same_features(features, names)
    if scale and statistics is None:
        statistics = scaling.window_statistics(frames[parts[0]], names)
    out = {}
    for p, df in frames.items():
        scaled = scaling.apply_scaling(df, statistics) if scale else df
        vectors = windowing.packed(scaled, names, [TIME, "y"])
        out[p] = staging.save(number_rows(vectors, [TIME], "_id"), f"objects-{p}")
    return {"frames": out, "features": names, "label": label, "statistics": statistics, "period": period, "rows": {p: df.count() for p, df in out.items()}}


def train_k_means(spark: SparkSession, split_dir: str, models_dir: str, reports_dir: str, categorical: list[str], dataset: str | None = None, **given) -> dict:
    cfg = settings(**given)
    name, files = readers.discover(split_dir)
    name = dataset or name
    ready = prepare(spark, files, categorical, of_dataset(cfg["window_steps"], name), ("train", "validation", "test"), scale=cfg["scale_windows"], min_coverage=cfg["min_coverage"])
    train, validation, test = (ready["frames"][p] for p in ("train", "validation", "test"))
    tried = []
    for k in cfg["k_values"]:
        found = centroids.fit(train, k, cfg["seed"], cfg["max_iter"])
        tried.append((metrics.metrics(centroids.scored(validation, found), [TIME]), k))
    best, k = max(tried, key=lambda t: (t[0]["roc_auc"] is not None, t[0]["roc_auc"] or 0.0))
    more = validation if cfg["contaminated_refit"] else validation.filter("y = 0")
    refit = train.unionByName(more)
    found = centroids.fit(refit, k, cfg["seed"], cfg["max_iter"])
    result = metrics.metrics(centroids.scored(test, found), [TIME], best["threshold"])
    contract = {"model": "kmeans", "k": k, "centroids": found, "features": ready["features"], "statistics": ready["statistics"], "threshold": best["threshold"], "window_steps": of_dataset(cfg["window_steps"], name), "fit_rows": refit.count()}
    writers.write_json(contract, Path(models_dir) / f"kmeans_{name}.json")
    report = {"dataset": name, "k": k, "validation": best, "test": result, "tried": [{"k": kk, **m} for m, kk in tried]}
    writers.write_json(report, Path(reports_dir) / f"kmeans_{name}.json")
    return report


def _queries(objects: DataFrame, own: bool) -> DataFrame:
    """What is placed: training objects must not be placed on themselves."""
    return objects.select(F.col("_id").alias("_row"), "_vec", (F.col("_id") if own else F.lit(-1).cast("long")).alias("_ex"))


def detector_graph(objects: DataFrame, width: int, cfg: dict, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, edges, cores) of the training objects."""
    graph = neighbours.NeighbourhoodGraph(cfg["bits"], cfg["permutations"], cfg["band"], of_dataset(cfg["min_similarity"], name), cfg["seed"])
    edges = staging.save(graph.edges(objects, width), "edges")
    cores = staging.save(density.core_objects(edges, cfg["min_pts"]), "cores")
    return density.find_clusters(objects.select(F.col("_id").alias("_node")), edges, cores, cfg["label_change_rate"]), edges, cores


def train_detector(spark: SparkSession, split_dir: str, reports_dir: str, categorical: list[str], stage: str = "select", selected: dict | None = None, dataset: str | None = None, network: autoencoder.Settings | None = None, **given) -> dict:
    if stage not in ("select", "final"):
        raise ValueError(f"no stage {stage!r}")
    if stage == "final" and not selected:
        raise ValueError("the final stage needs what the search selected")
    began = time.time()
    cfg = settings(**{**((selected or {}).get("config") or {}), **given})
    if cfg["attach_to"] not in ("clustered", "core"):
        raise ValueError("attach_to has to be 'clustered' or 'core'")
    network = (network or autoencoder.Settings()).checked()
    name, files = readers.discover(split_dir)
    name = dataset or name
    parts = ("train", "validation") if stage == "select" else ("train", "validation", "test")
    ready = prepare(spark, files, categorical, of_dataset(cfg["window_steps"], name), parts, min_coverage=cfg["min_coverage"])
    frames, width = ready["frames"], len(ready["features"])
    train = frames["train"]
    if stage == "final":
        # normal windows of validation join; they keep numbers of their own after those of train
        normal = frames["validation"].filter("y = 0").withColumn("_id", F.col("_id") + ready["rows"]["train"])
        train = staging.save(train.unionByName(normal), "objects-final")
    state, edges, cores = detector_graph(train, width, cfg, name)
    pool = placement.placement_pool(train, state, cores, cfg["attach_to"])
    own = staging.save(placement.place(_queries(train, True), pool), "placed")
    placement.audit(own, _queries(train, True), pool, seed=cfg["seed"])
    held = staging.save(subgraphs.content(train, state, edges), "clusters")
    threshold = of_dataset(cfg["min_similarity"], name)

    def graphs(placed: DataFrame, objects: DataFrame, leave_out: bool) -> DataFrame:
        asked = subgraphs.questions(placed, state, objects, "y", leave_out)
        return staging.save(subgraphs.packed(asked, held, threshold, network.max_members, network.max_hops), "graphs")

    examples = graphs(own, train, True)
    if cfg["train_examples"]:
        examples = examples.sample(False, min(1.0, cfg["train_examples"] / max(1, examples.count())), cfg["seed"])
    found = {}
    for p in parts[1:]:
        queries = _queries(frames[p], False)
        if stage == "final" and p == "validation":
            # windows that joined the pool must not be placed on themselves
            queries = queries.withColumn("_ex", F.col("_row") + ready["rows"]["train"])
        found[p] = graphs(staging.save(placement.place(queries, pool), "placed"), frames[p], False)

    def scored(p: str, model: autoencoder.GraphAutoEncoder) -> DataFrame:
        joined = frames[p].select("_id", TIME, "y").join(autoencoder.scores(found[p], model).withColumnRenamed("_row", "_id"), "_id", "left")
        return staging.save(metrics.fill_scores(joined), f"scores-{p}")

    stop = (lambda m: metrics.ranking(scored("validation", m)).first()["average_precision"] or 0.0) if stage == "select" else None
    fixed = (selected or {}).get("epoch") if stage == "final" else None
    model, best, epoch = autoencoder.fit(examples, width, network, stop, fixed)
    carried = (selected or {}).get("threshold") if stage == "final" else None
    results = {"validation": metrics.metrics(scored("validation", model), [TIME], carried)}
    if stage == "final":
        results["test"] = metrics.metrics(scored("test", model), [TIME], results["validation"]["threshold"])
    report = {
        "model": "graph autoencoder", "dataset": name, "stage": stage, "rows": ready["rows"], "features": ready["features"],
        "config": {k: cfg[k] for k in ("bits", "permutations", "band", "min_pts", "label_change_rate", "attach_to", "seed")} | {"min_similarity": threshold},
        "network": autoencoder.settings_dict(network), "graph": density.summarise(state).first().asDict() | {"edges": edges.count(), "cores": cores.count()},
        "placement": placement.placement_stats(own).first().asDict(), "best": best, "epoch": epoch, "threshold": results["validation"]["threshold"],
        "metrics": results, "seconds": round(time.time() - began, 1),
    }
    folder = Path(reports_dir) / stage
    writers.write_json(report, folder / f"detector_{name}_{stage}.json")
    autoencoder.save_model(model, folder / f"detector_{name}_{stage}.weights.json", {"features": ready["features"], "threshold": report["threshold"], "min_similarity": threshold})
    return report


def network_settings(values: dict, base: autoencoder.Settings | None = None) -> autoencoder.Settings:
    """Settings with the values that name one of them; hops follow layers unless they are given."""
    known = {k: v for k, v in values.items() if k in autoencoder.Settings.__dataclass_fields__}
    if "layers" in known and "max_hops" not in known:
        known["max_hops"] = known["layers"]
    return replace(base or autoencoder.Settings(), **known)
