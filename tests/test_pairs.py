"""All pairs of vectors by files of the shared folder: what is shuffled must not grow with the pairs."""

import numpy as np

from lodestar.operators import assign, evaluate
from lodestar.tables import Scratch


def test_medoids_of_copies_are_those_of_all_members(spark):
    """equal vectors are one with a weight; near pairs far from the origin keep their distances."""
    r = np.random.default_rng(3)
    x = np.concatenate([1000 + r.normal(size=(40, 6)), np.tile(1000 + r.normal(size=(3, 6)), (15, 1))])
    rows = [(label, f"e{label}_{i:03}", (x[i] + label).tolist()) for label in (0, 1) for i in range(len(x))]
    got = assign.medoids(spark.createDataFrame(rows, "label int, embedding_id string, embedding array<double>"), 7).orderBy("label").collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).sum(1)
    assert [(g.label, g.medoid) for g in got] == [(k, f"e{k}_{int(np.round(d, 9).argmin()):03}") for k in (0, 1)]
    assert all(abs(g.total - d.min()) < 1e-5 for g in got)
    weight = np.array([1.0, 15.0])
    assert np.allclose(assign._totals(x[:2], x[40:42], weight), np.sqrt(((x[:2, None] - x[None, 40:42]) ** 2).sum(-1)) @ weight, rtol=1e-13)


def test_nearest_by_inner_product_with_ties(spark):
    """a task's files and queries give what a sort of all pairs gives, equal products by id."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(60, 5)), np.tile(r.normal(size=(2, 5)), (20, 1))])
    rows = spark.createDataFrame([(i * 7, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    with Scratch(spark) as scratch:
        got = evaluate.nearest(rows.where("vec_id % 3 = 0").selectExpr("vec_id as qid", "embedding as q"), rows, 12, scratch).collect()
    want = set()
    for i in range(0, len(x), 3):
        score = [float(sum(float(a) * float(b) for a, b in zip(x[i], y))) for y in x]
        want |= {(i * 7, rank, j * 7) for rank, j in enumerate(sorted(range(len(x)), key=lambda j: (-score[j], j))[:12], 1)}
    assert {(g.qid, g.rank, g.vec_id) for g in got} == want
