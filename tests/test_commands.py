"""Channel failures, guards, and sinks that may be written twice."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import assign, chunk, history, request, vector
from lodestar.sources import files


def test_a_failing_channel_leaves_the_search(spark):
    rows = spark.createDataFrame([("e1", "native"), ("e2", "subject")], "embedding_id string, embedding_type string")

    def open_(channel):
        if channel == "description":
            raise OSError("store is down")
        return rows

    queries = [("native", 0.5, [1.0]), ("description", 0.3, [1.0]), ("subject", 0.2, [1.0])]
    kept, vectors, reasons = request.open_channels(queries, open_)
    assert [(c, round(w, 9)) for c, w, _ in kept] == [("native", round(0.5 / 0.7, 9)), ("subject", round(0.2 / 0.7, 9))]
    assert sorted(r.embedding_id for r in vectors.collect()) == ["e1", "e2"] and reasons == ["channel description failed: store is down"]
    with pytest.raises(RuntimeError, match="every channel"):
        request.open_channels(queries[1:2], open_)
    assert request.open_channels(queries[:1], open_)[0] == queries[:1]


def test_a_busy_workspace_is_not_deleted(spark):
    jobs = spark.createDataFrame([(1, "ws1", "running"), (2, "ws2", "done")], "job_id int, workspace_id string, status string")
    with pytest.raises(ValueError, match="under way"):
        history.delete_workspace({"jobs": jobs}, "ws1")
    left, counts = history.delete_workspace({"jobs": jobs}, "ws2")
    assert counts == {"jobs": 1} and left["jobs"].count() == 1


def test_a_snapshot_written_twice_is_one(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "position int, asset_id string")
    for _ in range(2):
        files.write_snapshot(rows, "run1", str(tmp_path / "snap"))
    files.write_snapshot(rows.limit(1), "run2", str(tmp_path / "snap"))
    got = spark.read.parquet(str(tmp_path / "snap"))
    assert {(r.execution_id, r["count"]) for r in got.groupBy("execution_id").count().collect()} == {("run1", 2), ("run2", 1)}


def test_roots_with_signs_are_plain_text(spark, tmp_path):
    root = tmp_path / "a+b (1)"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "x.md").write_text("# x")
    assert [r.relative_path for r in files.discover(spark, str(root)).collect()] == ["sub/x.md"]


def test_short_blocks_of_two_top_headings_stand_under_neither():
    text = "# A\n\none\n\n# B\n\ntwo\n"
    a, b = chunk.Chunk(text[:8], 0, 8, ("A",)), chunk.Chunk(text[9:], 9, len(text), ("B",))
    assert [c.path for c in chunk.join_short(text, [a, b], len, 100, 600)] == [()]


def test_many_representatives_are_dealt_out(spark, monkeypatch):
    fresh = spark.range(40).select(F.concat(F.lit("a"), "id").alias("asset_id"), F.array(F.cos(F.col("id").cast("double")), F.sin(F.col("id").cast("double"))).alias("embedding"))
    reps = spark.range(30).select(
        F.concat(F.lit("c"), "id").alias("cluster_id"), F.lit("dynamic").alias("mode"), F.array(F.cos(F.col("id") * 1.7), F.sin(F.col("id") * 1.7)).alias("rep")
    )
    none = spark.createDataFrame([], "asset_id string, cluster_id string")
    want = {r.asset_id: r.cluster_id for r in assign.assign(fresh, reps, none).collect()}
    monkeypatch.setattr(vector, "MOST_BROADCAST", 4)
    assert {r.asset_id: r.cluster_id for r in assign.assign(fresh, reps, none).collect()} == want and len(want) == 40
