"""Whole searches whose channels fail, and approximate recall."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import request, search

VECTOR = "embedding_id string, asset_id string, embedding_type string, embedding array<double>, workspace_id string, asset_type string, source_file_id string, created_at_ts long"


def vectors(spark, channel, n=5):
    rows = [(f"{channel}{i}", f"a{i}", channel, [1.0, i / 10], "w", "image", "s", 100) for i in range(n)]
    return spark.createDataFrame(rows, VECTOR)


def test_a_channel_that_fails_when_read_leaves_the_search(spark, tmp_path):
    own = request.Request("w", "text", "q", channels=("native", "description", "subject"), top_k=2)
    queries = [("native", 0.5, [1.0, 0.0]), ("description", 0.25, [1.0, 0.1]), ("subject", 0.25, [1.0, 0.0])]
    spark.range(3).selectExpr("cast(id as string)").write.text(str(tmp_path / "broken"))

    def open_(channel):
        if channel == "subject":
            return spark.read.schema(VECTOR).parquet(str(tmp_path / "broken"))
        return vectors(spark, channel)

    kept, hits, reasons = request.recall_channels(spark, own, queries, open_)
    assert [(c, round(w, 9)) for c, w, _ in kept] == [("native", round(2 / 3, 9)), ("description", round(1 / 3, 9))]
    assert len(reasons) == 1 and reasons[0].startswith("channel subject failed")
    rows = hits.orderBy("embedding_type", "rank").collect()
    assert [r.embedding_id for r in rows if r.embedding_type == "native"] == [f"native{i}" for i in range(5)]
    assert {round(r.weight, 9) for r in rows} == {round(2 / 3, 9), round(1 / 3, 9)}
    assert rows[0].asset_id == "a1"  # of the description, [1, .1] itself

    def opens_none(channel):
        raise OSError(channel)

    with pytest.raises(RuntimeError, match="every channel failed"):
        request.recall_channels(spark, own, queries, opens_none)
    # Nothing fails: weights stay as they are.
    kept, _, reasons = request.recall_channels(spark, own, queries, lambda c: vectors(spark, c))
    assert kept == queries and not reasons


def test_revalidation_keeps_order_and_drops_stale_evidence(spark):
    evidence = "array<struct<order: double, rank: int, embedding_type: string, embedding_id: string>>"
    rows = [("a", 3, 0.7, [(-0.5, 1, "x", "e1"), (-0.2, 2, "y", "e2")]), ("b", 1, 0.4, [(-0.4, 1, "x", "e3")]), ("c", 2, 0.1, [(-0.1, 9, "x", "e4")])]
    found = spark.createDataFrame(rows, f"asset_id string, pos int, score double, evidence {evidence}")
    live = spark.createDataFrame([("a", 1), ("b", 2)], "asset_id string, embedding_revision int")
    records = spark.createDataFrame(
        [("e1", 1, "failed"), ("e2", 1, "indexed"), ("e3", 2, "indexed"), ("e4", 1, "indexed")], "embedding_id string, embedding_revision int, status string"
    )
    got = {r.asset_id: (r.pos, round(r.score, 9), [e.embedding_id for e in r.evidence]) for r in search.revalidate(found, live, records).collect()}
    assert got == {"a": (3, 0.2, ["e2"]), "b": (1, 0.4, ["e3"])}


def points(n, d, seed):
    import numpy as np

    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, d))
    return centers[r.integers(0, 12, n)] + 0.7 * r.normal(size=(n, d))


def test_graph_links_reach_every_row_and_are_bounded():
    import numpy as np

    from lodestar.operators import graph

    x = points(700, 16, 1)
    x[:3] = -50 * x[:3]  # far from all others
    x[10:30] = x[10]  # equal rows
    ids = [f"e{i}" for i in range(700)]
    starts, targets = graph.Graph.build(x, ids)
    g = graph.Graph(x, starts, targets)
    assert len(g.starts) >= 2
    seen, todo = {g.entry}, [g.entry]
    while todo:
        new = set(g.near(0, todo.pop()).tolist()) - seen
        seen |= new
        todo += new
    assert len(seen) == 700
    sizes = np.diff(g.starts[0])
    assert (sizes > 2 * graph.LINKS).sum() < 20 and sizes.max() < 4 * graph.LINKS


@pytest.mark.parametrize("percent", [1, 10, 100])
def test_walks_find_admitted_rows_only_and_nearly_all(percent):
    import numpy as np

    from lodestar.operators import graph

    x, queries = points(3000, 32, 2), points(40, 32, 3)
    starts, targets = graph.Graph.build(x, [f"e{i}" for i in range(3000)])
    g = graph.Graph(x, starts, targets)
    admitted = np.random.default_rng(4).random(3000) < percent / 100
    hit = total = 0
    for q in queries / np.linalg.norm(queries, axis=1, keepdims=True):
        found = g.search(q, admitted, 128)[:20]
        assert admitted[found].all() and len(set(found)) == len(found)
        want = [i for i in np.argsort(-(g.x @ q), kind="stable") if admitted[i]][:20]
        hit, total = hit + len(set(found) & set(want)), total + len(want)
    assert hit / total >= 0.97


def test_recall_over_several_shards(spark):
    from lodestar.operators import graph

    rows = [
        (f"{c}{i}", f"a{i}", c, v.tolist(), "w" if i % 10 else "v", i, 1)
        for c, seed in (("native", 5), ("subject", 6)) for i, v in enumerate(points(900, 8, seed))
    ]
    rows += [("zero", "z", "native", [0.0] * 8, "v", 1, 1), ("null", "z", "native", None, "v", 1, 1)]
    table = spark.createDataFrame(rows, "embedding_id string, asset_id string, embedding_type string, embedding array<double>, workspace_id string, n int, embedding_revision int")
    asked = spark.createDataFrame(
        [(0, "native", 0.5, [1.0] * 8), (1, "subject", 0.3, [-1.0] + [0.5] * 7), (2, "native", 0.2, [0.0] * 8), (3, "other", 0.1, [1.0] * 8), (4, "native", 0.1, [1.0])],
        "query_no int, embedding_type string, weight double, query array<double>",
    )
    index = graph.index(table, shard=200).cache()
    assert 6 <= index.count() <= 10 and index.select(F.sum(F.size("payload"))).first()[0] == 1800
    for admit, exact in ((None, table), (lambda p: p["workspace_id"] == "v", table.where("workspace_id = 'v'"))):
        got = {(r.query_no, r["rank"], r.embedding_id, round(r.score, 9), r.asset_id, r.weight) for r in graph.recall(index, asked, 15, admit).collect()}
        want = search.recall(asked.where("query_no < 2"), exact, 15).collect()
        want = {(r.query_no, r["rank"], r.embedding_id, round(r.score, 9), r.asset_id, r.weight) for r in want}
        assert len(want) == 30 and len(got & want) >= 27 and len(got) == 30
    index.unpersist()


def test_links_are_those_of_the_rule():
    import numpy as np

    from lodestar.operators import graph

    x = points(300, 8, 7)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine, own, above = (x @ x.T).astype(np.float32), np.arange(300), np.arange(0, 300, 9)
    np.fill_diagonal(cosine, -np.inf)
    both = [set() for _ in own]
    for i in own:
        order = lambda js, i=i: sorted(js, key=lambda j: (-cosine[i, j], j))
        chosen, passed = [], []
        for j in order({*order(set(own) - {i})[:20], *order(set(above) - {i})[:20]}):
            fine = len(chosen) < 6 and all(cosine[j, k] < cosine[i, j] for k in chosen)
            (chosen if fine else passed).append(j)
        for j in (chosen + passed)[:6]:
            both[i].add(j)
            both[j].add(i)
    a, b = graph.layer_links(cosine, own, 6, above, 40)
    for i in own:
        assert b[a == i][:12].tolist() == sorted(both[i], key=lambda j, i=i: (-cosine[i, j], j))[:12]


def test_copies_are_tied_together_without_a_search_of_all_pairs_for_each():
    import time

    import numpy as np

    from lodestar.operators import graph

    x = np.random.default_rng(8).normal(size=(3000, 16))
    x[300:] = x[0]
    began = time.process_time()
    g = graph.Graph(x, *graph.Graph.build(x, [f"e{i}" for i in range(3000)]))
    assert time.process_time() - began < 8
    seen, todo = {g.entry}, [g.entry]
    while todo:
        new = set(g.near(0, todo.pop()).tolist()) - seen
        seen |= new
        todo += new
    assert len(seen) == 3000


def test_all_filters_are_one_scan_and_vectors_are_derived_once(spark):
    from lodestar.operators import graph
    from lodestar.plans import search_queries
    from lodestar.plans.domain import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    plain, derived = d.vectors, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            derived.add(batch.num_rows)
            yield batch

    d._made["vectors"] = plain.mapInArrow(counted, plain.schema)
    rows = search_queries.recall_graph(d).collect()
    assert derived.value == plain.count() and all(r.recall_fine and not r.n_outside for r in rows)

    index = graph.index(plain, shard=100).cache()
    admits = [lambda p, n=n: p["doc_id"] % n == 0 for n in (1, 5)]
    columns = ["query_no", "rank", "embedding_id", "score"]
    each = graph.recall_each(index, d.queries, 15, admits)
    for i, admit in enumerate(admits):
        want = sorted(graph.recall(index, d.queries, 15, admit).select(columns).collect())
        assert want and sorted(each.where(f"filter_no = {i}").select(columns).collect()) == want
    index.unpersist()


def test_a_file_of_the_index_has_few_shards(spark, monkeypatch):
    from lodestar.operators import graph
    from lodestar.plans import search_queries
    from lodestar.plans.domain import Domain

    build, most = graph.index, []
    monkeypatch.setattr(graph, "index", lambda rows: build(rows, shard=10).coalesce(1))
    each = graph.recall_each

    def seen(index, *a):
        most.append(index.groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first())
        return each(index, *a)

    monkeypatch.setattr(graph, "recall_each", seen)
    assert search_queries.recall_graph(Domain(spark, "/root/testdata/sf0.001")).count()
    assert most[0][0] <= graph.FILE_SHARDS < most[0][1]


def test_exact_recall_leaves_out_invalid_queries_and_other_lengths(spark):
    rows = vectors(spark, "native").union(spark.createDataFrame([("z", "z", "native", [0.0, 0.0], "w", "image", "s", 1), ("s", "s", "native", [1.0], "w", "image", "s", 1)], VECTOR))
    asked = [(0, "native", 1.0, [1.0, 0.0]), (1, "native", 1.0, [0.0, 0.0]), (2, "native", 1.0, None), (3, "native", 1.0, [1.0, 0.0, 0.0]), (4, "native", 1.0, [1.0, float("nan")])]
    found = search.recall(spark.createDataFrame(asked, "query_no int, embedding_type string, weight double, query array<double>"), rows, 3).orderBy("rank").collect()
    assert [(r.query_no, r["rank"], r.embedding_id) for r in found] == [(0, 1, "native0"), (0, 2, "native1"), (0, 3, "native2")]
    assert [round(r.score, 9) for r in found] == [round(1 / (1 + (i / 10) ** 2) ** 0.5, 9) for i in range(3)] and "query" not in found[0]


def test_a_vector_table_is_made_or_must_fit(spark, tmp_path):
    from pyspark.sql import types as T

    from lodestar.operators import vector

    schema = T.StructType([T.StructField(f, T.ArrayType(T.FloatType()) if f == "vector" else T.LongType() if f == "created_at_ts" else T.StringType()) for f in vector.FIELDS])
    path = str(tmp_path / "vectors")
    assert vector.ensure_table(spark, path, 2, schema) and not vector.ensure_table(spark, path, 2, schema)
    row = [[1.0, 2.0] if f == "vector" else 1 if f == "created_at_ts" else "x" for f in vector.FIELDS]
    spark.createDataFrame([row], schema).write.mode("append").parquet(path)
    assert not vector.ensure_table(spark, path, 2, schema)
    with pytest.raises(ValueError, match="dimension 2, expected 3"):
        vector.ensure_table(spark, path, 3, schema)
    old = str(tmp_path / "old")
    spark.createDataFrame([], "embedding_id string").write.parquet(old)
    assert vector.ensure_table(spark, old, 2, schema) and "vector" in spark.read.parquet(old).columns
    spark.createDataFrame([("e",)], "embedding_id string").write.mode("overwrite").parquet(old)
    with pytest.raises(ValueError, match="has rows"):
        vector.ensure_table(spark, old, 2, schema)
