"""Whole procedures on small recordings."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonde.functions.contracts import Params, declared_categorical, feature_columns, label_column, same_features
from sonde.plans import autoencoder, detectors, preparation
from sonde.plans.search import Grid, search
from sonde.streaming import windows as streams


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Three parts of a sine with a state, where positives sit apart."""
    folder = tmp_path_factory.mktemp("parts")
    rng = np.random.default_rng(0)
    for k, (part, n) in enumerate((("train", 480), ("validation", 240), ("test", 240))):
        t = np.arange(n)
        y = ((t % 80 >= 60) & (t % 80 < 72)).astype(int) if part != "train" else np.zeros(n, int)
        a = np.sin(t / 7) + rng.normal(scale=0.05, size=n) + 4 * y
        rows = [(int(10_000 * k + i), float(x), float(x * 2 + rng.normal(scale=0.3)), int(i // 9 % 3), int(v)) for i, x, v in zip(t, a, y, strict=True)]
        df = spark.createDataFrame(rows, "s long, a double, b double, state int, is_y int")
        df.select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("datetime"), "a", "b", "state", "is_y").write.parquet(f"{folder}/demo_{part}.parquet")
    return str(folder)


def test_k_means(spark, parts, tmp_path):
    report = detectors.train_k_means(spark, parts, str(tmp_path / "m"), str(tmp_path / "r"), ["state"], k_values=[2, 4], window_steps=4)
    assert report["k"] in (2, 4) and report["test"]["roc_auc"] > 0.9
    contract = json.loads((tmp_path / "m" / "kmeans_demo.json").read_text())
    assert len(contract["centroids"]) == report["k"] and contract["features"][0] == "a_mean"


def test_detector_stages(spark, parts, tmp_path):
    network = autoencoder.Settings(hidden=8, latent=4, batch_size=16, max_epochs=2, patience=2, replicas=2, learning_rate=0.01)
    given = {"window_steps": 4, "bits": 8, "permutations": 3, "band": 6, "min_similarity": 0.7, "min_pts": 2}
    first = detectors.train_detector(spark, parts, str(tmp_path), ["state"], network=network, **given)
    assert set(first["metrics"]) == {"validation"} and first["graph"]["clusters"] > 0
    last = detectors.train_detector(spark, parts, str(tmp_path), ["state"], stage="final", selected={"config": given, "epoch": 1, "threshold": first["threshold"]}, network=network)
    assert set(last["metrics"]) == {"validation", "test"} and last["best"] is None and last["epoch"] == 1
    assert last["metrics"]["test"]["threshold"] == first["threshold"]
    assert (tmp_path / "final" / "detector_demo_final.json").exists()
    with pytest.raises(ValueError):
        detectors.train_detector(spark, parts, str(tmp_path), ["state"], attach_to="any", **given)
    with pytest.raises(ValueError):
        detectors.train_detector(spark, parts, str(tmp_path), ["state"], stage="final")


def test_hops_follow_layers():
    assert detectors.network_settings({"layers": 3, "other": 1}).max_hops == 3
    assert detectors.network_settings({"layers": 3, "max_hops": 4}).max_hops == 4


def test_settings_precedence():
    assert detectors.settings(Params({"bits": 20}), bits=None)["bits"] == 20
    assert detectors.settings(Params({"bits": 20}), bits=24)["bits"] == 24


def test_search(tmp_path):
    grid = Grid({"bits": [16, 24], "min_similarity": {"swat": [0.9, 0.95], "hai": [0.7]}, "lr": 0.1}, "swat")
    assert grid.values == {"bits": [16, 24], "min_similarity": [0.9, 0.95], "lr": [0.1]}
    assert grid.drawn(10) == [{"bits": b, "min_similarity": m, "lr": 0.1} for b in (16, 24) for m in (0.9, 0.95)]
    wide = Grid({"a": list(range(10)), "b": list(range(10))})
    some = wide.drawn(7, seed=1)
    assert len({tuple(x.values()) for x in some}) == 7 and some == wide.drawn(7, seed=1)

    def trial(config):
        if config["bits"] == 16:
            raise RuntimeError("no")
        return {"average_precision": config["min_similarity"]}

    out = search(trial, grid.drawn(10), tmp_path / "s.json")
    assert out["best"]["config"]["min_similarity"] == 0.95
    assert sum("error" in r for r in json.loads((tmp_path / "s.json").read_text())["runs"]) == 2


def test_preparation_of_labelled_files(spark, tmp_path):
    rows = [f"{k // 60:02d}:{k % 60:02d}" for k in range(40)]
    lines = "\n".join(f" 28/12/2015 10:{t} AM,{k % 7},{(k % 7) * 2},5,{'' if k % 2 else 1},{'A ttack' if 20 <= k < 24 else 'Normal'}" for k, t in enumerate(rows))
    (tmp_path / "raw.csv").write_text(" Timestamp,x,y,flat,thin,Normal/Attack\n" + lines + "\n" + lines.split("\n")[3] + "\n")
    path = preparation.SwatPreprocessor(spark, str(tmp_path / "raw.csv"), str(tmp_path / "full"), "swat").run()
    full = spark.read.parquet(path)
    assert full.count() == 40 and feature_columns(full.columns) == ["x", "y", "flat", "thin"] and label_column(full.columns) == "is_attack"
    splitter = preparation.Splitter(spark, path, str(tmp_path / "split"), "2015-12-28 10:00:15", "2015-12-28 10:00:30", "swat")
    assert len(splitter.run()) == 3 and splitter.describe().count() == 3
    with pytest.raises(ValueError):
        preparation.Splitter(spark, path, str(tmp_path / "torn"), "2015-12-28 10:00:15", "2015-12-28 10:00:22", "swat").run()
    process = preparation.Processor(spark, str(tmp_path / "split"), str(tmp_path / "done"), "swat", ["flat", "x"])
    done = process.run()
    assert process.dropped["sparse"] == ["thin"] and process.dropped["constant"] == ["flat"]
    assert set(spark.read.parquet(done["test"]).columns) == {"datetime", "x", "y", "is_attack"}
    assert json.loads((tmp_path / "done" / "swat_process.json").read_text())["columns"] == ["x", "y"]


def test_recordings_with_side_labels(spark, tmp_path):
    for name, day in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.csv").write_text("timestamp, p \n" + "\n".join(f"2022-08-0{day} 00:00:{k:02d},{k}" for k in range(5)) + "\n")
    (tmp_path / "l.csv").write_text("timestamp,label\n" + "\n".join(f"2022-08-02 00:00:{k:02d},{k // 3}" for k in range(5)) + "\n")
    job = preparation.HaiPreprocessor(spark, str(tmp_path), str(tmp_path / "o"), "hai", recordings=["a.csv"], labelled="b.csv", labels="l.csv")
    rows = spark.read.parquet(job.run()).orderBy("datetime").collect()
    assert [r["is_attack"] for r in rows] == [0] * 5 + [0, 0, 0, 1, 1] and rows[-1]["p"] == 4.0
    with pytest.raises(ValueError):
        preparation.HaiPreprocessor(spark, str(tmp_path), str(tmp_path / "o"), "x", recordings=["b.csv"], labelled="b.csv", labels="l.csv").table()


def test_channels_on_a_grid(spark, tmp_path):
    stamp = F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts")
    rows = [("c1", 5, "1.0"), ("c1", 23, "2.0"), ("c2", 18, "on"), ("c2", 40, "off"), ("c2", 60, "on")]
    spark.createDataFrame(rows, "channel string, s long, value string").select("channel", stamp, "value").write.parquet(f"{tmp_path}/channels")
    (tmp_path / "channels.csv").write_text("Channel,Subsystem,Target,Categorical\nc1,s,YES,NO\nc2,s,NO,YES\n")
    (tmp_path / "labels.csv").write_text("ID,Channel,StartTime,EndTime\n1,c1,1970-01-01 00:00:10,1970-01-01 00:00:40\n2,c1,1970-01-01 00:00:36,1970-01-01 00:00:50\n")
    (tmp_path / "anomaly_types.csv").write_text("ID,Category\n1,Rare Event\n2,Anomaly\n")
    rows = preparation.EsaPreprocessor(spark, str(tmp_path), str(tmp_path / "o"), "esa").table().orderBy("datetime").collect()
    assert [r["c1"] for r in rows] == [None, 1.0, 2.0, 2.0] and [r["c2"] for r in rows] == [None, 0.0, 0.0, 1.0]
    assert [r["label_c1"] for r in rows] == [0, 2, 1, 0]
    assert [r["is_anomaly"] for r in rows] == [0, 0, 1, 0] and [r["is_rare_event"] for r in rows] == [0, 1, 0, 0]
    one = preparation.EsaPreprocessor(spark, str(tmp_path), str(tmp_path / "o"), "esa", target_only=True).table()
    assert feature_columns(one.columns) == ["c1"]
    prepared = preparation.EsaProcessor(spark, "", "", "esa", ["c2"]).prepare(preparation.EsaPreprocessor(spark, str(tmp_path), str(tmp_path / "o"), "esa").table())
    assert label_column(prepared.columns) == "is_anomaly" and prepared.filter("is_anomaly = 1").count() == 2


def test_contracts(tmp_path):
    (tmp_path / "c.json").write_text('{"swat": ["p"], "a": {"b": 3}}')
    assert declared_categorical("swat", tmp_path / "c.json") == ["p"]
    with pytest.raises(KeyError):
        declared_categorical("hai", tmp_path / "c.json")
    tree = Params.load(tmp_path / "c.json")
    assert (tree.a.b, tree["a"]["b"], tree.get("a.b"), tree.get("a.c", 9), "a" in tree) == (3, 3, 3, 9, True)
    with pytest.raises(ValueError):
        same_features(["a", "b"], ["b", "a"])
    with pytest.raises(ValueError):
        label_column(["is_a", "is_b"])


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(k, float(k)) for k in range(10)], "s long, value double").select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "value")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    out = streams.drain(streams.stream_windows(streams.read_stream(spark, f"{tmp_path}/in", df.schema), "value", 4, F.col("value") > 8)).orderBy("window_start").collect()
    assert [(r["window_start"], r["n_rows"], r["mean"], r["label"]) for r in out] == [(0, 4, 1.5, 0.0), (4, 4, 5.5, 0.0), (8, 2, 8.5, 1.0)]
