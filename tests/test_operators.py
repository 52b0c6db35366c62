"""Small fixtures with results computed by hand."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonde.operators import alignment, cleaning, density, metrics, neighbours, placement, prediction, profile, runs, scaling, splitting, subgraphs, windowing
from sonde.sources import readers, writers


def timed(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("datetime", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")


def test_window_features(spark):
    rows = [(0, 1.0, 1, 0), (1, 2.0, 2, 0), (2, 4.0, 2, 1), (3, 3.0, 2, 0), (4, None, 1, 0), (5, 3.0, None, 0)]
    df = timed(spark, rows, "t long, num double, cat int, is_y int")
    out, names = windowing.window(df, ["num", "cat"], 3, "is_y", ["cat"], period=1)
    assert names == ["num_mean", "num_std", "cat_mode", "cat_entropy", "cat_nunique", "cat_maxprop"]
    a, b = out.orderBy("datetime").collect()
    assert [a[n] for n in names] == pytest.approx([7 / 3, 1.247219, 2, 0.636514, 2, 2 / 3], abs=1e-6)
    assert (a["is_y"], a["_rows"], b["is_y"], b["_rows"]) == (1.0, 3, 0.0, 3)
    assert [b[n] for n in names] == pytest.approx([3.0, 0.0, 1, math.log(2), 2, 0.5], abs=1e-6)


def test_window_needs_two_readings(spark):
    with pytest.raises(ValueError):
        windowing.window(timed(spark, [(0, 1.0, 0)], "t long, num double, is_y int"), ["num"], 1, "is_y")


def test_coverage_floor():
    assert [windowing.floor_rows(n, 0.5) for n in (60, 30, 33, 3)] == [30, 15, 17, 2]


def test_sampling_period_prefers_the_smaller_gap_on_ties(spark):
    df = timed(spark, [(0,), (2,), (4,), (7,), (10,)], "t long")
    assert windowing.sampling_period(df) == 2
    with pytest.raises(ValueError):
        windowing.sampling_period(timed(spark, [(0,)], "t long"))


def test_scaling_skips_modes_and_flat_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (3.0, 5.0, 2.0)], "a_mean double, a_std double, c_mode double")
    stats = scaling.window_statistics(df, df.columns)
    assert stats == {"a_mean": (2.0, pytest.approx(math.sqrt(2))), "a_std": (5.0, 1.0)}
    assert scaling.apply_scaling(df, stats).first()["c_mode"] == 1.0


@pytest.mark.parametrize(("cells", "want"), [([[9, 1], [1, 9]], 0.7), ([[10, 0], [0, 10]], 0.9), ([[200, 0], [0, 200]], 0.995), ([[5, 0, 0], [0, 5, 0], [0, 0, 5]], 1.0), ([[4, 0]], 0.0)])
def test_cramer(spark, cells, want):
    rows = [(i, j) for i, r in enumerate(cells) for j, n in enumerate(r) for _ in range(n)]
    assert profile.cramer_pairs(spark.createDataFrame(rows, "a int, b int"), ["a", "b"]).first()["v"] == pytest.approx(want)


def test_entropy(spark):
    df = spark.createDataFrame([(x, 1) for x in (0, 0, 0, 1)], "a int, b int")
    got = {r["column"]: r["entropy"] for r in profile.entropies(df, ["a", "b"]).collect()}
    assert got == {"a": pytest.approx(0.811278, abs=1e-6), "b": 0.0}


def test_pruning_keeps_the_stronger_column():
    assert profile.prune(["x", "y"], {"x": 5, "y": 5}, {("x", "y"): 1.0}, 0.99) == (["x"], {"y": "x"})
    assert profile.prune(["x", "y"], {"x": 5, "y": 7}, {("x", "y"): 1.0}, 0.99) == (["y"], {"x": "y"})
    assert profile.prune(["x", "y"], {"x": 5, "y": 7}, {("x", "y"): 0.5}, 0.99) == (["x", "y"], {})


def test_fill_values_and_sparse_columns(spark):
    df = spark.createDataFrame([(1.0, 2, None), (3.0, 1, 1), (None, 2, None)], "a double, b int, c int")
    assert profile.fill_values(df, ["a"], ["b"]) == {"a": 2.0, "b": 2.0}
    assert profile.sparse_columns(df, ["a", "b", "c"]) == ["a", "c"]
    assert profile.constant_columns(df, ["a", "b", "c"]) == ["c"]
    assert profile.imputed(df, {"a": 2.0}).filter("a IS NULL").count() == 0
    assert profile.final_check(df.unionByName(df), ["a"])["repeated_rows"] == 3


def graph(spark):
    return spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)], "_src long, _dst long")


@pytest.mark.parametrize(("rate", "want"), [(0, [4, 4, 4, 4, 4, 0]), (0.05, [4, 4, 4, 4, 4, 0]), (0.3, [4, 4, 4, 4, 4, 0]), (0.6, [3, 3, 4, 4, 4, 0])])
def test_label_propagation(spark, rate, want):
    edges = graph(spark)
    cores = density.core_objects(edges, 2)
    assert {r["_node"]: r["degree"] for r in cores.collect()} == {0: 2, 1: 2, 2: 3, 3: 2}
    state = density.find_clusters(spark.range(6).withColumnRenamed("id", "_node"), edges, cores, rate)
    assert [r["_cluster"] for r in state.orderBy("_node").collect()] == want


def test_cluster_summary(spark):
    state = spark.createDataFrame([(i, c) for i, c in enumerate([4, 4, 4, 9, 0])], "_node long, _cluster long")
    assert density.summarise(state).first().asDict() == {"nodes": 5, "clusters": 2, "noise": 1, "noise_share": 0.2, "largest": 3, "median_size": 2.0, "largest_share": 0.6}


def test_ranking_and_threshold(spark):
    y, s = [0, 1, 1, 0, 0, 1], [0.1, 0.9, 0.4, 0.4, 0.2, 0.8]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, s, strict=True))], "i long, y int, score double")
    got = metrics.metrics(df, ["i"])
    assert got["roc_auc"] == pytest.approx(0.944444, abs=1e-6)
    assert got["average_precision"] == pytest.approx(0.916667, abs=1e-6)
    assert (got["threshold"], got["f1"]) == (pytest.approx(0.4), pytest.approx(0.857143, abs=1e-6))
    assert (got["segments"], got["segments_caught"]) == (2, 2)
    one = metrics.ranking(df.filter("y = 1")).first()
    assert one["roc_auc"] is None and one["average_precision"] == pytest.approx(1.0)


def test_hold_and_intervals(spark):
    stamp = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    readings = spark.createDataFrame([("A", 5, 1.0), ("A", 23, 2.0), ("B", 18, 7.0)], "channel string, s long, value double").withColumn("ts", stamp("s"))
    grid = alignment.grid(readings.agg(F.min("ts").alias("a"), F.max("ts").alias("b")), "a", "b", 18, "ts")
    instants = grid.join(readings.select("channel").distinct(), how="cross")
    got = {(r["channel"], r["ts"].second): r["value"] for r in alignment.hold(readings, instants, "channel", "ts", "value").collect()}
    assert got == {("A", 0): None, ("A", 18): 1.0, ("B", 0): None, ("B", 18): 7.0}
    spans = spark.createDataFrame([("A", 10, 40, 1), ("A", 36, 50, 2)], "channel string, a long, b long, rank int").withColumns({"start": stamp("a"), "end": stamp("b")})
    times = spark.createDataFrame([("A", t) for t in (0, 18, 36, 54)], "channel string, s long").withColumn("ts", stamp("s"))
    labels = alignment.interval_labels(times, spans, "channel", "ts", "start", "end", F.col("rank"), 18)
    assert [r["label"] for r in labels.orderBy("ts").collect()] == [0, 1, 2, 0]


def test_replicas():
    assert writers.balanced({10: 5, 11: 4, 12: 3, 13: 3}, 2) == {10: 0, 11: 1, 12: 1, 13: 0}


def test_factorise(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "i long, c string")
    assert [r["k"] for r in cleaning.factorise(df, "c", ["i"], "k").orderBy("i").collect()] == [0, 1, -1, 0]


def test_candidates_with_a_wide_band_are_all_pairs(spark):
    rng = np.random.default_rng(0)
    objects = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "_id long, _vec array<double>")
    for band, n in ((8, 36), (20, 36), (1, None)):
        g = neighbours.NeighbourhoodGraph(bits=6, permutations=1, band=band, min_similarity=-1.0)
        pairs = g.candidates(g.signed(objects, 4)).count()
        assert pairs == (n if n else 8)
    positions = neighbours.NeighbourhoodGraph(bits=6, permutations=3, band=2).signed(objects, 4)
    placed = neighbours.NeighbourhoodGraph(bits=6, permutations=3, band=2).positions(positions).toPandas()
    assert all(sorted(x["_pos"]) == list(range(9)) for _, x in placed.groupby("_perm"))


def test_graph_settings_are_checked():
    for bad in ({"bits": 0}, {"bits": 63}, {"band": 0}, {"permutations": 0}, {"min_similarity": 1.5}):
        with pytest.raises(ValueError):
            neighbours.NeighbourhoodGraph(**bad)


@pytest.mark.parametrize("limit", [1 << 30, 500])
def test_placement_is_the_arg_max(spark, limit):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    x[7] = x[3] * 2  # a tie goes to the smaller id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id long, _vec array<double>")
    queries = df.select(F.col("_id").alias("_row"), "_vec", F.col("_id").alias("_ex"))
    got = {r["_row"]: r["_core"] for r in placement.place(queries, df, limit).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    assert got == {i: int(s[i].argmax()) for i in range(40)}
    if limit > 500:
        placement.audit(placement.place(queries, df), queries, df, sample=5)
        wrong = placement.place(queries, df).withColumn("_sim", F.col("_sim") - 0.5)
        with pytest.raises(ValueError):
            placement.audit(wrong, queries, df, sample=5)


def test_attach_to_any_is_refused(spark):
    with pytest.raises(ValueError):
        placement.placement_pool(graph(spark), graph(spark), graph(spark), "any")


def test_runs_and_split(spark):
    df = timed(spark, [(i, y) for i, y in enumerate([0, 1, 1, 0, 1])], "t long, is_y int")
    assert runs.count_runs(df, ["datetime"], F.col("is_y") == 1).first()["runs"] == 2
    bounds = runs.run_bounds(df, ["datetime"], F.col("is_y") == 1).collect()
    assert sorted(r["n_rows"] for r in bounds) == [1, 2]
    parts = splitting.cut(df, "1970-01-01 00:00:02", "1970-01-01 00:00:03")
    assert {p: x.count() for p, x in parts.items()} == {"train": 2, "validation": 1, "test": 2}
    assert splitting.cut_runs(df, parts) == {"is_y": (2, 3)}
    with pytest.raises(ValueError):
        splitting.cut(df, "1970-01-01 00:00:03", "1970-01-01 00:00:03")
    with pytest.raises(ValueError):
        splitting.cut(df, "1980-01-01 00:00:00", "1990-01-01 00:00:00")


def path():
    x = np.eye(4)[:, :3] + 0.1
    return x, subgraphs.Cluster(np.arange(4), x, np.array([[0, 1], [1, 2], [2, 3]]))


def test_surroundings_on_a_path():
    x, cluster = path()
    nodes, vectors, a, b, w, entries = cluster.surroundings(x[:1], np.array([0]), np.array([-1]), 0.999, max_hops=2)
    assert nodes.tolist() == [3] and entries.tolist() == [len(a)]  # itself, its core and one further hop
    assert (vectors == x[[0, 1, 0]]).all()
    got = np.zeros((3, 3))
    got[a, b] = w
    degree = np.array([3.0, 3.0, 2.0])  # the second has a link that was cut
    want = np.array([[1, 1, 1], [1, 1, 0], [1, 0, 1]]) / np.sqrt(np.outer(degree, degree))
    assert got == pytest.approx(want)
    nodes, *_ = cluster.surroundings(x[[0, 0]], np.array([0, 1]), np.array([3, 0]), 0.999)
    assert nodes.tolist() == [4, 4]
    nodes, *_ = cluster.surroundings(x[:1], np.array([0]), np.array([-1]), 0.999, max_members=2)
    assert nodes.tolist() == [3]


def plain_surrounding(x, links, q, core, drop, least, most, hops):
    """One question at a time, with sets: kept members and the normalised entries."""
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    near = {n: float(unit(v) @ unit(q)) for n, v in enumerate(x) if n != drop}
    members = set(near) if most is None else set(sorted(near, key=lambda n: (-near[n], n))[:most])
    tied = {n for n in members if near[n] >= least or n == core}
    around = {n: {v for e in links for u, v in (e, e[::-1]) if u == n and v in members} for n in members}
    kept = set(tied) if hops is not None else members
    for _ in range((hops or 1) - 1):
        kept = kept | {v for n in kept for v in around[n]}
    degree = {n: 1 + len(around[n]) + (n in tied) for n in members} | {"q": 1 + len(tied)}
    order = [*sorted(kept), "q"]
    joined = lambda u, v: u == v or (v in tied if u == "q" else u in tied if v == "q" else v in around[u])
    return sorted(kept), np.array([[(degree[u] * degree[v]) ** -0.5 if joined(u, v) else 0.0 for v in order] for u in order])


@pytest.mark.parametrize(("most", "hops", "block"), [(None, 2, 4096), (None, None, 7), (9, 3, 5), (4, 2, 4096)])
def test_packed_surroundings(spark, most, hops, block):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 3))
    cluster_of = np.array([5] * 14 + [6] * 10 + [0] * 6)
    links = [(u, v) for u in range(30) for v in range(u) if rng.random() < 0.2]
    objects = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "_id long, _vec array<double>, y int")
    state = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cluster_of)], "_node long, _cluster long")
    edges = spark.createDataFrame([(v, u) for u, v in links], "_src long, _dst long")
    cores = [int(rng.choice([k for k in range(24) if k != i])) for i in range(30)]
    placed = spark.createDataFrame([(i, c, 0.5) for i, c in enumerate(cores)], "_row long, _core long, _sim double")
    asked = subgraphs.questions(placed, state, objects, "y", leave_out=True)
    held = subgraphs.content(objects, state, edges)
    got = {r["_row"]: r for r in subgraphs.packed(asked, held, 0.3, most, hops, block).collect()}
    ties = {(r["_row"], r["_node"]) for r in subgraphs.attached(asked, held, 0.3, block).collect()}
    assert len(got) == 30
    for i, c in enumerate(cores):
        own = np.flatnonzero(cluster_of == cluster_of[c])
        local = {int(n): k for k, n in enumerate(own)}
        inner = [(local[u], local[v]) for u, v in links if u in local and v in local]
        kept, matrix = plain_surrounding(x[own], inner, x[i], local[c], local.get(i, -1), 0.3, most, hops)
        r = got[i]
        assert (r["nodes"], r["_y"]) == (len(kept) + 1, i % 2)
        assert np.reshape(r["x"], (-1, 3)) == pytest.approx(np.vstack([x[own][kept], x[i]]))
        full = np.zeros(matrix.shape)
        full[r["a"], r["b"]] = r["w"]
        assert full == pytest.approx(matrix)
        near = {int(n) for n in own if n != i and (n == c or x[n] @ x[i] / np.linalg.norm(x[n]) / np.linalg.norm(x[i]) >= 0.3)}
        assert {n for q, n in ties if q == i} == near


@pytest.mark.parametrize("block", [2048, 7])
def test_exact_pairs(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    x[5] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id long, _vec array<double>")
    got = {(r["_src"], r["_dst"]): r["similarity"] for r in neighbours.cosine_pairs(df, 0.2, block).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = {(i, j): float(u[i] @ u[j]) for i in range(40) for j in range(i + 1, 40) if u[i] @ u[j] >= 0.2}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert neighbours.cosine_pairs(df.limit(0), 0.2).count() == 0


@pytest.mark.parametrize(("hops", "block", "tile"), [(1, 4096, 8192), (2, 4096, 8192), (3, 7, 8)])
def test_ball_is_what_hops_reach(spark, hops, block, tile):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 3))
    x[7], x[20:24] = 0, x[20]
    cluster_of = [5] * 24 + [-6] * 10 + [0] * 6
    objects = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id long, _vec array<double>")
    state = spark.createDataFrame(list(enumerate(cluster_of)), "_node long, _cluster long")
    placed = spark.createDataFrame([(i, int(rng.choice([k for k in range(34) if k != i])), 0.5) for i in range(40)], "_row long, _core long, _sim double")
    edges = neighbours.cosine_pairs(objects, 0.8)
    asked, held = subgraphs.questions(placed, state, objects, leave_out=True), subgraphs.content(objects, state, edges)
    want = subgraphs.within_hops(subgraphs.attached(asked, held, 0.8), edges, state, hops)
    got = [tuple(r) for r in subgraphs.ball(asked, held, 0.8, hops, block, tile).collect()]
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and len(got) == len(set(got)) > 40


@pytest.mark.parametrize(("block", "few"), [(2048, 1 << 18), (7, 1)])
def test_quantiles_of_all_pairs(spark, block, few):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    x[5], x[6:12] = 0, x[12]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "_id long, _vec array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    shares = [0.0, 0.25, 0.5, 0.77, 0.999, 1.0]
    assert neighbours.cosine_quantiles(df, shares, block, few) == pytest.approx(np.quantile((u @ u.T)[np.triu_indices(40, 1)], shares).tolist(), abs=1e-12)
    assert [tuple(r) for r in prediction.similarity_quantiles(df.limit(1), [0.5]).collect()] == [(0.5, None)]


def test_weighted_prediction(spark):
    objects = spark.createDataFrame([(0, [1.0, 0.0], 10.0), (1, [0.0, 1.0], 20.0), (2, [1.0, 1.0], 40.0)], "_id long, _vec array<double>, y double")
    state = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "_node long, _cluster long")
    queries = spark.createDataFrame([(9, [3.0, 4.0])], "_row long, _vec array<double>")
    placed = spark.createDataFrame([(9, 1, 0.8)], "_row long, _core long, _sim double")
    got = prediction.weighted_targets(placed, state, queries, objects, "y").first()["prediction"]
    assert got == pytest.approx((0.6 * 10 + 0.8 * 20) / 1.4)


def test_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text(" Timestamp, F1 ,Normal/Attack\n 28/12/2015 10:00:00 AM,1.5,Normal\n 28/12/2015 10:00:01 AM,bad, A ttack\n")
    got = readers.read_labelled_csv(spark, str(tmp_path / "s.csv")).orderBy("datetime").collect()
    assert [(str(r["datetime"]), r["F1"], r["is_attack"]) for r in got] == [("2015-12-28 10:00:00", 1.5, 0), ("2015-12-28 10:00:01", None, 1)]
    (tmp_path / "odd.csv").write_text("Timestamp,F1,Normal/Attack\n28/12/2015 10:00:00 AM,1,Maybe\n")
    with pytest.raises(ValueError):
        readers.read_labelled_csv(spark, str(tmp_path / "odd.csv"))
    (tmp_path / "v.csv").write_text("timestamp,a\n2022-08-17 00:00:00,1\n2022-08-17 00:00:01,2\n")
    (tmp_path / "l.csv").write_text("timestamp,label\n2022-08-17 00:00:00,0\n2022-08-17 00:00:00,1\n")
    side = readers.with_side_labels(spark, str(tmp_path / "v.csv"), str(tmp_path / "l.csv")).orderBy("datetime").collect()
    assert [(r["a"], r["is_attack"]) for r in side] == [(1.0, 0), (2.0, 1)]
    (tmp_path / "w.csv").write_text("timestamp,b\n2022-08-17 00:00:00,1\n")
    with pytest.raises(ValueError):
        readers.read_recordings(spark, [str(tmp_path / "v.csv"), str(tmp_path / "w.csv")])
    (tmp_path / "d.sql").write_text("SET x;\nCOPY public.pv (id, power) FROM stdin;\n1\t2.5\n2\t\\N\n\\.\nCOPY other (id) FROM stdin;\n7\n\\.\n")
    assert [tuple(r) for r in readers.read_copy_block(spark, str(tmp_path / "d.sql"), "pv").orderBy("id").collect()] == [("1", "2.5"), ("2", None)]


def test_shards(spark, tmp_path):
    queries = spark.createDataFrame([(c, i) for i, c in enumerate([10] * 5 + [11] * 4 + [12] * 3)], "_cluster long, _row long")
    assigned = writers.replica_table(queries, 2)
    assert writers.write_shards(str(tmp_path / "s"), 2, {"queries": queries}, assigned) == {"queries": 12}
    assert [writers.read_shard(spark, str(tmp_path / "s"), "queries", k).count() for k in (0, 1)] == [5, 7]
    assert not writers.write_table(queries, str(tmp_path / "s"))


def test_a_table_is_replaced_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.write_table(spark.range(5), path)
    assert writers.write_table(spark.read.parquet(path).filter("id > 1"), path, overwrite=True)  # from the table itself
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    with pytest.raises(Exception, match="stop"):
        writers.write_table(spark.range(3).select(F.raise_error(F.lit("stop")).alias("id")), path, overwrite=True)
    assert spark.read.parquet(path).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_splits_are_found_by_either_kind_of_path(spark, tmp_path):
    for part in ("train", "validation", "test"):
        spark.range(1).write.parquet(str(tmp_path / f"plant_{part}.parquet"))
    for folder in (tmp_path, f"file://{tmp_path}"):
        name, files = readers.discover(folder)
        assert name == "plant" and spark.read.parquet(files["test"]).count() == 1
    spark.range(1).write.parquet(str(tmp_path / "other_test.parquet"))
    for folder in (tmp_path, f"file://{tmp_path}"):
        with pytest.raises(ValueError):
            readers.discover(folder)


def test_json_has_no_infinities(tmp_path):
    assert "null" in writers.write_json({"a": float("inf"), "b": [1]}, tmp_path / "r.json").read_text()
    assert isinstance(pd.read_json(tmp_path / "r.json", typ="series")["b"], list)
