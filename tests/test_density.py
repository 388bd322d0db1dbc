import os

import numpy as np
import pyarrow as pa
import pytest

from loomspark.operators import density, learning, nearest
from loomspark.scratch import scratch_root


def blobs():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, sd, (n, 8)) for m, n, sd in ((0, 90, 1), (6, 60, 0.5), (-14, 14, 0.1), (15, 12, 0.1))] + [rng.uniform(-20, 20, (60, 8)), np.ones((20, 8))])
    rng.shuffle(x)
    return x


@pytest.mark.parametrize("block", [4096, 30])
def test_clusters_of_any_number_of_blocks_are_those_of_one_array(spark, block):
    x = blobs()
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)] + [(1, None)], "id long, features array<double>")
    got = {r["id"]: r["cluster_id"] for r in learning.density_clusters(df, 20, 10, 0.08, block=block).collect()}
    want = learning.recluster(x, learning.density_labels(x, 20), 10, 0.08)
    assert len(set(want)) > 3 and [got[i * 3] for i in range(len(x))] == want.tolist() and got[1] == -1


def test_no_task_holds_more_than_two_blocks_of_vectors(spark, monkeypatch):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(blobs())], "row long, v array<double>").selectExpr("row", "v", "0D as core")
    links = density.spanning_links(df, 256, block=40)
    w, a, b = (np.array(x) for x in zip(*((r["w"], r["a"], r["b"]) for r in links.collect()), strict=True))
    keep = density.forest(w, a, b)
    x = blobs()
    assert len(keep) == 255 and len(w) < 4 * 256  # of 32,640
    assert np.isclose(w[keep].sum(), sum(e[0] for e in density.reach_tree(x, np.zeros(len(x)))))


def test_nearest_lists_and_their_kth(monkeypatch):
    rng = np.random.default_rng(1)
    a, b, many = rng.normal(size=(50, 5)), rng.normal(size=(70, 5)), rng.integers(1, 3, 70)
    monkeypatch.setattr(nearest, "AT_ONCE", 300)
    found = nearest.closest(a, b, many, 4, np.zeros(5), False, np.full(50, np.inf))
    d = np.sqrt(((a[:, None] - b) ** 2).sum(-1))
    got = nearest.lists([found, found])
    assert isinstance(got, pa.Array) and len(got) == 100 and np.allclose([[x["far"] for x in r] for r in got.to_pylist()], np.tile(np.sort(d, axis=1)[:, :4], (2, 1)))
    order = np.argsort(d, axis=1)
    want = [next(d[i, j] for t, j in zip(np.cumsum(many[order[i]]), order[i], strict=True) if t >= 3) for i in range(50)]
    assert np.allclose(nearest._kth(found, np.ones(50, int), 3), want)


def test_units_grow_with_the_table_so_shuffled_rows_do_not(spark, monkeypatch):
    monkeypatch.setattr(nearest, "UNITS", 3)
    met = []
    real = nearest._meetings
    monkeypatch.setattr(nearest, "_meetings", lambda *a: met.extend(real(*a)) or real(*a))
    x = np.random.default_rng(2).normal(size=(240, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<float>")
    got = {r["id"]: r["core"] for r in nearest.core_distance(df, 3, block=8).collect()}
    d = np.sort(np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1)), axis=1)[:, 3]
    assert max(abs(got[i] - d[i]) for i in got) < 1e-12 and len({u for u, _, _ in met}) <= 6


@pytest.mark.parametrize("cut", [0, 700])
def test_clusters_far_apart_keep_few_links_in_memory(monkeypatch, cut):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (700, 8)), rng.normal(300, 1, (700, 8))])
    rng.shuffle(x)
    core, held = np.zeros(len(x)), []
    real = density.forest
    monkeypatch.setattr(density, "forest", lambda *a: held.append(len(a[0])) or real(*a))
    monkeypatch.setattr(density, "LOOKED_UP", 1 << 10)
    if cut:
        (w, a, b), (v, c, d) = (density.unit_tree(x[s], core[s]) for s in (slice(0, cut), slice(cut, None)))
        tree = density.Tree(len(x), np.concatenate([w, v, density.distances(x[:1], x[cut])]), np.concatenate([a, c + cut, [0]]), np.concatenate([b, d + cut, [cut]]))
        density.improve(tree, x, core, cut)
        w, a, b = tree.links
    else:
        w, a, b = density.unit_tree(x, core)
    assert max(held) < 4 * len(x) + (1 << 10)  # of over 200,000 links that are shorter than the way from one cluster to the other
    assert len(w) == len(x) - 1 and np.isclose(w.sum(), sum(e[0] for e in density.reach_tree(x, core)), rtol=1e-12)
    assert np.allclose(density.distances(x[a], x[b]), w)


def test_bounds_are_not_above_squared_distances_with_an_offset_and_an_outlier():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16)) + 1e4
    x[7] += 1e7
    d = ((x[:, None] - x) ** 2).sum(-1)
    for usual in (5.0, np.inf, 1e-9):
        squares = nearest.Squares(x, x, usual)
        low = squares.low(slice(None), slice(None))
        assert (low <= squares.wall(np.sqrt(d))).all()
    k = nearest.closest(x, x, np.ones(300, int), 4, x.mean(axis=0), True, np.full(300, np.inf))
    assert np.allclose(k[1].reshape(300, 4), np.sort(np.sqrt(d), axis=1)[:, 1:5], rtol=1e-9)


def test_equal_vectors_are_one_node_and_units_grow_with_the_table(spark, monkeypatch):
    x = np.repeat(np.concatenate([np.random.default_rng(8).normal(m, 0.3, (12, 3)) for m in (0, 9)]), 5, axis=0)
    np.random.default_rng(9).shuffle(x)
    seen, real = [], density.spanning_links
    monkeypatch.setattr(density, "spanning_links", lambda rows, n, block: seen.append(n) or real(rows, n, block))
    df = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    before = scratch_tables(spark)
    found, n = density.clustered(df, 20, block=5)
    got = {r["id"]: r["cluster_id"] for r in found.collect()}
    want = learning.density_labels(x, 20)
    assert seen == [24] and n == 120 and len(set(want)) == 2 and [got[i] for i in range(120)] == want.tolist()
    left = {t.rsplit("-", 1)[0] for t in scratch_tables(spark) - before}
    assert left <= {"loom-density-labels", "loom-numbered"}, left
    for n in (10_000, 100_000, 600_000):
        assert -(-n // density.unit_size(n)) <= density.UNITS  # guests of a node


def scratch_tables(spark):
    return set(os.listdir(scratch_root(spark).removeprefix("file://")))
