"""Clustering by blocks against the clustering of one task."""

import numpy as np
import pytest

from lodestar.operators import assign, channels, density, spanning
from lodestar.tables import Scratch


def blobs(n, d, seed, spread=0.25):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(8, d))
    return centers[r.integers(0, 8, n)] + spread * r.normal(size=(n, d))


def table(spark, tmp_path, x, name):
    path = str(tmp_path / name)
    spark.createDataFrame([(i * 3 + 5, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def as_sets(labels):
    return {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist()) if c >= 0}


@pytest.mark.parametrize("spread", [0.25, 0.8])
def test_blocks_give_the_clusters_of_one_task(spark, tmp_path, spread):
    x = blobs(900, 12, 4, spread)
    got = spanning.cluster_table(table(spark, tmp_path, x, "x"), 6, density.Parameters(epsilon=0.1), block=120).orderBy("id").collect()
    y = density.project(density.unit_rows(x), 6)
    labels, probability, _ = density.cluster(y, density.Parameters(epsilon=0.1))
    assert [r.id for r in got] == [i * 3 + 5 for i in range(900)]
    assert len(as_sets(labels)) > 1 and as_sets(np.array([r.label for r in got])) == as_sets(labels)
    assert np.abs(np.array([r.probability for r in got]) - probability).max() < 1e-9


def test_the_tree_is_minimal_with_equal_points_and_equal_distances(spark, tmp_path):
    grid = np.array([[i, j] for i in range(12) for j in range(12)], float)
    x = np.concatenate([grid, np.zeros((40, 2)), grid[:20], [[100.0, 100.0]]])
    points = table(spark, tmp_path, x, "x").withColumnRenamed("x", "y")
    with Scratch(spark) as scratch:
        tree = spanning.spanning_tree(points, scratch, 3, block=16).collect()
    d = spanning.distances(x, x)
    core = np.sort(d, axis=1)[:, 3]
    want = density.spanning_tree(np.maximum(d, np.maximum(core[:, None], core[None, :])))
    assert len(tree) == len(x) - 1 and sorted(round(r.w, 9) for r in tree) == sorted(round(w, 9) for w in want[:, 2].tolist())
    top = {i: i for r in tree for i in (r.low, r.high)}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for r in tree:
        a, b = find(r.low), find(r.high)
        assert a != b  # no cycle
        top[a] = b


def test_few_points(spark, tmp_path):
    none = table(spark, tmp_path, np.zeros((0, 2)), "none")
    assert spanning.cluster_table(none).count() == 0
    one = spanning.cluster_table(table(spark, tmp_path, np.ones((1, 2)), "one")).collect()
    assert [(r.label, r.probability) for r in one] == [(-1, 0.0)]
    two = spanning.cluster_table(table(spark, tmp_path, np.eye(2), "two"), None).collect()
    assert [r.label for r in two] == [-1, -1]
    with pytest.raises(Exception, match="finite and not zero"):
        spanning.cluster_table(table(spark, tmp_path, np.zeros((3, 2)), "zero")).count()


def test_points_that_share_most_values_are_split():
    """over half of the points have the least value of each widest component."""
    r = np.random.default_rng(1)
    kind = r.integers(0, 10, 4000)
    x = np.concatenate([np.eye(10)[kind], 0.1 * r.normal(size=(4000, 4))], axis=1)
    cells = spanning._cell_of(x, spanning._cells(x, 40))
    assert len(set(cells.tolist())) >= 30 and np.bincount(cells).max() <= 400
    assert all(len(set(kind[cells == c].tolist())) == 1 for c in set(cells.tolist()))


def test_a_product_tells_the_pairs_that_are_near():
    """none within the distance is lost, and of the others few are left to compute."""
    r = np.random.default_rng(2)
    for size, shift in ((1.0, 0.0), (1e-20, 0.0), (1e30, 0.0), (1.0, 5.0)):
        a, b = (size * (shift + r.normal(size=(n, 32))) for n in (300, 400))
        b[:50] = a[:50]
        d = spanning.distances(a, b)
        scale = 2.0 ** -int(np.ceil(np.log2(max(np.abs(a).max(), np.abs(b).max()))))
        own, other, every = spanning.Near(a, scale), spanning.Near(b, scale), np.arange(300)
        within = np.sort(d, axis=1)[:, 3]
        passed = own.products(every, other) >= own.least(every, other, within)[:, None]
        assert passed[d <= within[:, None]].all() and passed.sum() < 300 * 12
        p, q = np.nonzero(passed)
        assert (own.exact(p, other, q) == d[p, q]).all()


def test_a_channel_by_blocks_has_the_run_of_one_task(spark):
    """F1 F2: a channel beyond what one task holds was an error."""
    x = np.concatenate([blobs(500, 12, 7, 0.15), np.tile(blobs(3, 12, 8), (8, 1))])
    rows = [("w", "c", f"a{i:04}", f"s{i % 40}", v.tolist()) for i, v in enumerate(x)] + [("w", "small", f"a{i:04}", "s", v.tolist()) for i, v in enumerate(x[:30])]
    table = spark.createDataFrame(rows, "workspace_id string, embedding_type string, asset_id string, source_file_id string, embedding array<double>")
    kept = density.Parameters(epsilon=0.1)
    gates = density.MergeGates(0.5, 0.2, 0.2)

    def told(df):
        return {(r.embedding_type, r.asset_id): (r.label, r.merged_label, round(r.probability, 6), None if r.distance is None else round(r.distance, 6), r.role, r["rank"]) for r in df.collect()}

    got, want = told(channels.cluster_runs(table, 6, kept, gates, most=100)), told(density.cluster_runs(table, 6, kept, gates))
    assert len({v[0] for v in want.values()}) > 3 and any(v[0] != v[1] for v in want.values() if v[1] is not None)
    assert got == want


def test_equal_points_are_one_place_and_the_tree_is_the_same(spark, tmp_path, monkeypatch):
    """every copy of a vector took part in all passes; edges of equal weights included, the tree is that of all points."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(0, 7, size=(400, 2)).astype(float), r.integers(0, 30, size=(150, 2)).astype(float), np.tile(r.normal(size=(20, 2)), (3, 1))])
    x = x[r.permutation(len(x))]
    met = []
    monkeypatch.setattr(spanning, "core_distances", lambda blocks, *a, _run=spanning.core_distances: (met.append(blocks.count), _run(blocks, *a)))
    points = table(spark, tmp_path, x, "x").withColumnRenamed("x", "y")
    d = spanning.distances(x, x)
    core = np.sort(d, axis=1)[:, 3]
    want = density.spanning_tree(np.maximum(d, np.maximum(core[:, None], core[None, :])))
    # Once followed on the driver, once joined by tables.
    for most in (spanning.MOST_FOLLOWED, 0):
        monkeypatch.setattr(spanning, "MOST_FOLLOWED", most)
        with Scratch(spark) as scratch:
            tree = spanning.spanning_tree(points, scratch, 3, block=40).collect()
        assert sorted(((t.low - 5) // 3, (t.high - 5) // 3, t.w) for t in tree) == sorted((int(a), int(b), w) for a, b, w in want.tolist())
    assert met == [len(np.unique(x, axis=0))] * 2


def test_edges_lead_to_the_roots():
    comp, other = np.array([1, 2, 4, 6, 7, 9]), np.array([2, 1, 2, 4, 8, 7])
    assert spanning.followed(comp, other).tolist() == [1, 1, 1, 1, 8, 8]


def test_rough_totals_keep_the_medoid():
    """F1: totals in single precision, whose bound of error holds, leave few to compute exactly."""
    r = np.random.default_rng(4)
    for size, shift in ((1.0, 0.0), (1e-20, 0.0), (1e30, 3.0), (1.0, 1e5)):
        y, weight = size * (shift + r.normal(size=(1500, 8))), r.integers(1, 9, 1500).astype(float)
        y[:40] = y[40]
        x, total = y[:600], assign._totals(y[:600], y, weight)
        rough = assign._Rough(x)
        for at in range(0, 1500, 500):
            rough.add(y[at : at + 500], weight[at : at + 500])
        assert (np.abs(rough.total / rough.scale - total) <= rough.error / rough.scale).all()
        kept = rough.candidates().tolist()
        assert int(total.argmin()) in kept and len(kept) < 60


def test_medoids_of_large_and_small_labels(spark):
    r = np.random.default_rng(5)
    x, label = r.normal(size=(500, 4)), np.where(np.arange(500) < 400, 0, np.arange(500) % 7 + 1)
    rows = spark.createDataFrame([(int(k), i, v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))], "label int, embedding_id long, embedding array<double>")
    got = {m.label: m.medoid for m in assign.medoids(rows, block=64).collect()}
    assert got == {k: int(np.flatnonzero(label == k)[density.medoid(x[label == k])]) for k in set(label.tolist())}


def test_labels_need_no_medoids(spark, monkeypatch):
    """a summary of labels paid for medoids, distances and roles."""
    x = blobs(150, 6, 9, 0.15)
    rows = spark.createDataFrame([("w", "c", f"a{i:04}", f"s{i % 40}", v.tolist()) for i, v in enumerate(x)], "workspace_id string, embedding_type string, asset_id string, source_file_id string, embedding array<double>")
    want = {tuple(r) for r in density.cluster_runs(rows, 4).select(*channels.LABELS).collect()}
    monkeypatch.setattr(assign, "medoids", None)
    assert {tuple(r) for r in channels.cluster_labels(rows, 4, most=100).collect()} == want
    assert {tuple(r) for r in channels.cluster_labels(rows, 4).collect()} == want
