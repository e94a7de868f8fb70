"""Transitions of clustering runs, and small operators on paths and frames."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import density, paths, runs, video


def test_one_of_two_racing_runs_wins(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "runs"))

    def begin(i):
        try:
            log.move("w s", "native/x", f"r{i}", "pending", None)
            return "won"
        except runs.RunConflict as e:
            return str(e)

    with ThreadPoolExecutor(6) as pool:
        told = list(pool.map(begin, range(6)))
    (winner,) = [i for i, t in enumerate(told) if t == "won"]
    assert all(t == f"run r{winner} holds w s/native/x" for i, t in enumerate(told) if i != winner)
    log.move("w s", "other", "o", "pending", None)  # another channel is free
    with pytest.raises(runs.RunConflict, match="does not go"):
        log.move("w s", "native/x", f"r{winner}", "completed", "pending")
    with pytest.raises(runs.RunConflict, match="not running"):
        log.move("w s", "native/x", f"r{winner}", "completed", "running")
    log.move("w s", "native/x", f"r{winner}", "failed", "pending", error="gone")
    log.move("w s", "native/x", "next", "pending", None)
    got = {r.run_id: (r.status, r.error, r.ended_at is None) for r in log.table().collect()}
    assert got == {f"r{winner}": ("failed", "gone", False), "next": ("pending", None, True), "o": ("pending", None, True)}


def test_runs_end_as_they_should(spark, tmp_path):
    log, published = runs.RunLog(spark, str(tmp_path / "runs")), []
    none = spark.createDataFrame([], "asset_id string, embedding array<float>")
    last = runs.run(log, "w", "empty", none, published.append)
    assert (last["status"], last["noise_ratio"]) == ("insufficient_data", 0.0) and published == [None]
    r = np.random.default_rng(1)
    x = np.concatenate([c + 0.05 * r.normal(size=(12, 5)) for c in np.eye(5)[:3]])
    rows = [(f"a{i}", v.tolist()) for i, v in enumerate(x)] + [("a0", x[0].tolist()), ("null", None)]
    path = str(tmp_path / "v")
    spark.createDataFrame(rows, none.schema).write.parquet(path)
    last = runs.run(log, "w", "three", spark.read.parquet(path), published.append, None, density.Parameters(epsilon=0.0))
    assert (last["status"], last["asset_count"], last["cluster_count"], last["noise_count"]) == ("completed", 36, 3, 0)
    labels = {r.asset_id: r.label for r in published[-1].collect()}
    assert len(labels) == 36 and len({labels[f"a{i}"] for i in range(12)}) == 1

    def refuses(df):
        raise OSError("no room")

    with pytest.raises(OSError):
        runs.run(log, "w", "three", none, refuses)
    assert log.entries("w", "three")[-1]["status"] == "failed" and log.entries("w", "three")[-1]["error"] == "no room"


def test_paths_of_clusters(spark):
    rows = [
        (1, "a", "Art\\Heroes\\one.png"), (1, "b", "Art/Heroes/one.png"), (1, "c", "Art/Heroes/deadbeef99.png"), (1, "d", " Art/x1/two.png "), (1, "e", "/abs/x.png"), (1, "f", "../up/x.png"),
        (1, "g", None), (1, "h", " "), (1, "i", "top.png"), (2, "j", "Misc/1234.png"), (3, "k", ""),
    ]
    found = paths.contexts(spark.createDataFrame(rows, "cluster_id int, asset_id string, relative_path string"), ("misc",), ("参考",)).collect()
    got = {(r.cluster_id, r.kind): [] for r in found}
    for r in sorted(found, key=lambda r: r["rank"]):
        got[(r.cluster_id, r.kind)].append((r.value, r.n))
    assert got == {
        (1, "directory"): [("Art/Heroes", 3), ("Art/x1", 1)], (1, "term"): [("Heroes", 3)],
        (1, "file"): [("Art/Heroes/one.png", 2), ("Art/x1/two.png", 1), ("top.png", 1), ("Art/Heroes/deadbeef99.png", 1)],
        (2, "directory"): [("Misc", 1)], (2, "file"): [("Misc/1234.png", 1)],
    }


def test_frames_kept_across_batches(spark):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    values = [10, 12, 30, 31, 90, 29, 30, 200, 199, 10]
    rows = [(v, i, i, [x, x], "dark" if i == 4 else None) for v in (1, 2) for i, x in enumerate(values)]
    frames = spark.createDataFrame(rows, "video long, at int, frame_id long, thumbnail array<int>, fault string")
    near = {1, 3, 5, 6, 8}
    want = {(v, i): "dark" if i == 4 else "near_duplicate" if i in near else None for v in (1, 2) for i in range(10)}
    try:
        for size in ("3", "100"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {(r.video, r.frame_id): r.reason for r in video.kept_frames(frames, 0.01).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_representatives_of_segments(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v, d: [x + d for x in v]
    rows = [("s", i, 100 + i, v) for i, v in enumerate([near(a, 0.1), a, near(a, 0.05), b, near(b, 0.02), c, near(c, 0.01)])]
    rows += [("t", 0, 200, a), ("u", 0, 300, a), ("u", 1, 301, a), ("u", 2, 302, a)]
    found = video.segment_representatives(spark.createDataFrame(rows, "segment_id string, at int, frame_id long, embedding array<double>"))
    got = {s: [r.frame_id for r in found.where(F.col("segment_id") == s).orderBy("position").collect()] for s in "stu"}
    assert len(got["s"]) == 3 and got["s"][0] in (100, 101, 102) and got["s"][1] in (103, 104) and got["s"][2] in (105, 106)
    assert got["t"] == [200] and len(got["u"]) == 1


def test_evaluation_lines_are_told(spark, tmp_path):
    from lodestar.sources import files

    (tmp_path / "e.jsonl").write_text('{"request": {"workspace_id": "w", "query_type": "text", "query_text": "q"}, "relevant_asset_ids": ["a", "b"]}\n\n  \nbroken\n{"relevant_asset_ids": ["c"]}\n[1]')
    rows = files.evaluation_cases(spark, str(tmp_path / "e.jsonl")).orderBy("line").collect()
    assert [(r.line, r.relevant_asset_ids, r.error) for r in rows] == [
        (1, ["a", "b"], None), (4, None, "line 4: no JSON object"), (5, ["c"], "line 5: no request"), (6, None, "line 6: no JSON object"),
    ]
    assert rows[0].request.query_text == "q"


def test_tokens_by_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from lodestar.operators import chunk

    path = public.path("word_bpe_49k.json")
    count = chunk.TokenCounter(path, cache=3)
    own = tokenizers.Tokenizer.from_file(path)
    texts = ["one two three", "", "x" * 500, "one two three", "naïve café"]
    assert [count(t) for t in texts] == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]
    assert count.count_many(texts) == [count(t) for t in texts] and len(count._held) <= 3
    docs = spark.createDataFrame([(1, "# A\n\n" + "Some words stand here. " * 300)], "doc_id long, text string")
    children = [r.text for r in chunk.chunk_documents(docs, count).where("role = 'child'").collect()]
    assert len(children) > 1 and all(count(t) <= 600 for t in children)


def test_batches_are_tried_again():
    from lodestar.streaming import jobs

    waited, calls = [], []

    def handle(batch, number):
        calls.append(number)
        if len(calls) < 4:
            raise OSError("busy")

    jobs.retried(handle, attempts=4, first=8.0, sleep=waited.append)(None, 7)
    assert calls == [7] * 4 and waited == [8.0, 16.0, 30.0]
    with pytest.raises(OSError):
        jobs.retried(lambda b, n: (_ for _ in ()).throw(OSError("gone")), attempts=2, sleep=waited.append)(None, 1)
    assert len(waited) == 4


def test_files_are_staged_whole(spark, tmp_path):
    from lodestar.sources import files

    root = str(tmp_path / "staged")
    assert files.stage(spark, root, "a\\b/./c.txt", b"one").endswith("/staged/a/b/c.txt")
    files.stage(spark, root, "a/b/c.txt", b"two")
    assert (tmp_path / "staged/a/b/c.txt").read_bytes() == b"two"
    assert [p.name for p in (tmp_path / "staged/a/b").iterdir() if not p.name.endswith(".crc")] == ["c.txt"]
    for bad in ("", " ", "/x", "a/../../x", "..", "c:/x"):
        with pytest.raises(ValueError, match="unsafe"):
            files.stage(spark, root, bad, b"")
    with pytest.raises(ValueError, match="exceed"):
        files.stage(spark, root, "x", b"12345", most=4)


def test_json_in_one_form_however_deep(spark):
    from lodestar.operators import text

    schema = "a struct<z: int, b: array<struct<y: string, c: map<string, struct<q: int, k: int>>>>>, m map<string, string>"
    row = [((1, [("é", {"t": (1, None), "s": (2, 3)}), None]), {"y": "1", "x": None}), (None, None)]
    df = spark.createDataFrame(row, schema)
    own = text.canonical_json(v=text.ordered(F.col("a"), df.schema["a"].dataType), m=text.ordered(F.col("m"), df.schema["m"].dataType))
    assert [r[0] for r in df.select(own).collect()] == [
        '{"m":{"x":null,"y":"1"},"v":{"b":[{"c":{"s":{"k":3,"q":2},"t":{"k":null,"q":1}},"y":"é"},null],"z":1}}', '{"m":null,"v":null}',
    ]
