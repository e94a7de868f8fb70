"""The spool and the completion of sources across kills and replays."""

import pytest
from pyspark.sql import functions as F

from lodestar.streaming import spool


def manifests(spark, rows):
    return spark.createDataFrame([(s, g, a, n, 10, 0) for s, g, a, n in rows], spool.MANIFEST).coalesce(1)


def ended(spark, sink):
    return sorted(tuple(r) for r in spark.read.parquet(sink).select("source_file_id", "generation", "state", "stored", "expected").collect())


def test_a_killed_import_ends_every_source_once(spark, tmp_path):
    root, sink, check = (str(tmp_path / n) for n in ("spool", "out", "check"))
    own = spool.Spool(spark, root)
    batches = [
        [("a", 1, "a1", 2), ("b", 1, "b1", 1), ("c", 1, "c1", 3)],
        [("a", 1, "a1", 2), ("d", 2, "d1", 1), ("d", 1, "d0", 1)],  # a delivery again, a stale generation
        [("a", 1, "a2", 2), ("c", 1, "c2", 3), ("e", 1, "e1", 1), ("e", 1, "e2", 1)],
        [("c", 1, "c3", 3), ("b", 1, "b1", 1), ("f", 1, "f1", 9)],
        [("b", 2, "b5", 1), ("e", 1, "e1", 1), ("c", 1, "c1", 3)],
    ]
    for i, rows in enumerate(batches):
        assert own.put(manifests(spark, rows), f"m{i}") == 1

    def dies(batch, number):
        if number == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        spool.run(own.stream(), sink, check, before=dies).awaitTermination()
    half = ended(spark, sink)
    assert ("b", 1, "done", 1, 1) in half and not any(r[0] in "ac" for r in half)
    spool.run(own.stream(), sink, check).awaitTermination()
    want = [("a", 1, "done", 2, 2), ("b", 1, "done", 1, 1), ("b", 2, "done", 1, 1), ("c", 1, "done", 3, 3), ("d", 2, "done", 1, 1), ("e", 1, "error", 2, 1)]
    assert ended(spark, sink) == want
    # Replays change nothing.
    own.put(manifests(spark, batches[0] + batches[2]), "again")
    assert own.put(manifests(spark, batches[0]), "m0") == 0
    spool.run(own.stream(), sink, check).awaitTermination()
    assert ended(spark, sink) == want
    # What is left waiting runs out of patience.
    own.put(manifests(spark, [("g", 1, "g1", 5)]), "late")
    spool.run(own.stream(), str(tmp_path / "out2"), str(tmp_path / "check2"), patience_ms=1).awaitTermination()
    own.put(manifests(spark, [("h", 1, "h1", 1)]), "last")
    spool.run(own.stream(), str(tmp_path / "out2"), str(tmp_path / "check2"), patience_ms=1).awaitTermination()
    late = ended(spark, str(tmp_path / "out2"))
    assert ("g", 1, "error", 1, 5) in late and ("f", 1, "error", 1, 9) in late and ("h", 1, "done", 1, 1) in late


def test_a_spool_holds_whole_manifests_only(spark, tmp_path):
    root = str(tmp_path / "spool")
    own = spool.Spool(spark, root, max_files=3, max_bytes=100)
    assert own.put(manifests(spark, [("a", 1, "a1", 1)]), "one") == 1
    # A crash while writing, and one before moving.
    manifests(spark, [("x", 1, "x1", 1)]).write.parquet(f"{root}/staged/torn=1")
    (tmp_path / "spool/staged/torn=1/_SUCCESS").unlink()
    manifests(spark, [("b", 1, "b1", 1)]).write.parquet(f"{root}/staged/two=1")
    assert own.ready().count() == 1
    assert own.recover() == 1 and own.recover() == 0
    assert sorted(r.asset_id for r in own.ready().collect()) == ["a1", "b1"]
    with pytest.raises(spool.SpoolFull):
        own.put(manifests(spark, [("c", 1, f"c{i}", 9) for i in range(9)]), "large")
    assert own.put(manifests(spark, [("c", 1, "c1", 1)]), "three") == 1
    with pytest.raises(spool.SpoolFull):
        own.put(manifests(spark, [("d", 1, "d1", 1)]), "four")
    over = spark.createDataFrame([("a", 1), ("c", 2)], "source_file_id string, generation int")
    assert own.release(over) == 2 and [r.asset_id for r in own.ready().collect()] == ["b1"]


def test_ended_generations_replace_the_earlier(spark):
    assets = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, "u"), ("c", 2, "v")], "source_file_id string, generation int, asset_id string")
    sources = spark.createDataFrame([("a", 2, "running"), ("b", 1, "running"), ("c", 2, "running"), ("d", 1, "running")], "source_file_id string, processing_generation int, processing_status string")
    over = spark.createDataFrame([("a", 1, "error"), ("a", 2, "done"), ("b", 1, "error"), ("c", 1, "done")], "source_file_id string, generation int, state string")
    left, after = spool.finalised(assets, sources, over)
    assert sorted(r.asset_id for r in left.collect()) == ["u", "v", "y", "z"]
    assert {r.source_file_id: r.processing_status for r in after.collect()} == {"a": "completed", "b": "failed", "c": "running", "d": "running"}
    assert after.columns == sources.columns and left.where(F.col("generation").isNull()).count() == 0
