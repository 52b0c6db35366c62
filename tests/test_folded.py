"""Folded surroundings give what packed ones give, without the nodes two hops away."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from sonde.operators import subgraphs
from sonde.plans import autoencoder


def surroundings(spark, block=4096):
    """Both forms for 40 objects: members of two clusters, some outside, a core that is no neighbour, a member on its own."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 3))
    cluster_of = [5] * 20 + [6] * 12 + [0] * 8
    objects = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "_id long, _vec array<double>, y int")
    state = spark.createDataFrame([(i, c) for i, c in enumerate(cluster_of)], "_node long, _cluster long")
    near = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    edges = spark.createDataFrame([(u, v) for v in range(39) for u in range(v) if near[u, v] >= 0.3 and rng.random() < 0.9], "_src long, _dst long")
    placed = spark.createDataFrame([(i, int(rng.choice([k for k in range(32) if k != i])), 0.5) for i in range(40)], "_row long, _core long, _sim double")
    asked, held = subgraphs.questions(placed, state, objects, "y", leave_out=True), subgraphs.content(objects, state, edges)
    return subgraphs.packed(asked, held, 0.3, max_hops=2, block=block), subgraphs.folded(asked, held, 0.3, block)


def batch(df):
    table = df.orderBy("_row").toArrow()
    return pa.RecordBatch.from_struct_array(table.to_struct_array().combine_chunks()), table


@pytest.mark.parametrize(("mask", "block"), [(False, 4096), (True, 7)])
def test_scores_and_gradients_agree(spark, mask, block):
    (whole, packed), (slim, folded) = map(batch, surroundings(spark, block))
    assert packed["_row"].to_pylist() == folded["_row"].to_pylist() == list(range(40))
    assert packed["_y"].to_pylist() == folded["_y"].to_pylist()
    model = autoencoder.GraphAutoEncoder(3, autoencoder.Settings(hidden=5, latent=2, mask_centre=mask))
    (g,), (f,) = autoencoder.batches_of(whole), autoencoder.batches_of(slim)
    assert isinstance(f, autoencoder.Stars)
    assert model.errors(f) == pytest.approx(model.errors(g), abs=1e-12)
    (_, one), (_, other) = model.gradients(g), model.gradients(f)
    for a, b in zip(one, other, strict=True):
        assert b == pytest.approx(a, abs=1e-10)
    assert len(f.x) < len(g.x)


def test_only_ties_are_kept(spark):
    """The nodes of a surrounding do not grow with what lies two hops away."""
    x = np.eye(3)[[0] * 2 + [1] * 30]
    objects = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "_id long, _vec array<double>, y int")
    state = spark.createDataFrame([(i, 1) for i in range(32)], "_node long, _cluster long")
    edges = spark.createDataFrame([(0, 1)] + [(1, k) for k in range(2, 32)], "_src long, _dst long")
    placed = spark.createDataFrame([(0, 1, 0.5)], "_row long, _core long, _sim double")
    found = subgraphs.folded(subgraphs.questions(placed, state, objects, leave_out=True), subgraphs.content(objects, state, edges), 0.3).collect()
    assert [(r["_row"], r["nodes"], len(r["x"]), len(r["c"])) for r in found] == [(0, 2, 6, 2)]


def test_only_two_layers(spark):
    model = autoencoder.GraphAutoEncoder(3, autoencoder.Settings(layers=3, max_hops=3))
    with pytest.raises(ValueError, match="two layers"):
        autoencoder.scores(surroundings(spark)[1], model)


def test_long_rows_lie_in_small_groups(spark):
    """A reader holds up to 4096 rows of a group at once, which surroundings of megabytes would not fit."""
    import glob

    import pyarrow.parquet as pq

    from sonde.functions import staging

    long = spark.range(0, 1000, 1, 1).selectExpr("id", "id % 2 AS part", "transform(sequence(1, 2000), i -> sin(2000 * id + i)) AS x")
    saved = staging.save(long, "long", "part", group=1 << 20)
    files = glob.glob(saved._scratch_path.removeprefix("file://") + "/part=*/*.parquet")
    assert len(files) == 2 and saved.count() == 1000 and saved.filter("part = 1").count() == 500
    assert max(pq.ParquetFile(f).metadata.row_group(k).num_rows for f in files for k in range(pq.ParquetFile(f).num_row_groups)) <= 200
