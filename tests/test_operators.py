"""Hand-computed values of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import assets, checks, chunk, density, fold, request, search, text, vector, video
from lodestar.sources import files
from lodestar.streaming import jobs

HITS = "embedding_type string, weight double, rank int, embedding_id string, asset_id string, score double"


def test_rrf_counts_skipped_duplicates(spark):
    rows = [("native", 1.0, 1, "a1", "a", 0.99), ("native", 1.0, 2, "b1", "b", 0.90), ("native", 1.0, 3, "a1", "a", 0.80)]
    rows += [("description", 0.8, 1, "b2", "b", 0.95), ("description", 0.8, 2, "a2", "a", 0.85)]
    got = search.fuse_rrf(spark.createDataFrame(rows, HITS)).collect()
    assert {r.asset_id: r.fused_score for r in got} == pytest.approx({"a": 1 / 61 + 0.8 / 62, "b": 1 / 62 + 0.8 / 61})
    assert [len(r.matches) for r in got if r.asset_id == "a"] == [2]


def test_normalised_fusion(spark):
    rows = [("subject", 0.6, 2, "a1", "a", 0.7), ("subject", 0.6, 1, "b1", "b", 0.9)]
    rows += [("mood", 0.4, 1, "a2", "a", 0.95), ("mood", 0.4, 2, "b2", "b", 0.5)]
    got = [(r.asset_id, r.fused_score) for r in search.fuse(spark.createDataFrame(rows, HITS), "normalized").collect()]
    assert got == [("b", pytest.approx(0.6)), ("a", pytest.approx(0.4))]


def test_explicit_null_effective_value_wins(spark):
    df = spark.createDataFrame(
        [("confirmed", " v ", "", True, None), ("confirmed", " v ", "", False, None), ("unknown", "v", "u", False, None), (None, "v", "u", True, " e ")],
        "status string, value string, user string, has boolean, eff string",
    )
    got = df.select(assets.feature_text(F.col("status"), F.col("value"), F.col("user"), None, F.col("has"), F.col("eff")).alias("t")).collect()
    assert [r.t for r in got] == [None, "v", None, "e"]


def test_cosine_of_invalid_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([float("nan"), 1.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(vector.cosine("a", "b").alias("c")).collect()] == [1.0, None, None, None, None]


def unit(*degrees):
    return np.array([[np.cos(np.radians(d)), np.sin(np.radians(d))] for d in degrees])


def test_merge_of_close_clusters_only():
    x = np.concatenate([unit(-2, 0, 2, 18, 20, 22, 55, 57, 59), [[0, -1]]])
    merged = density.merge_similar(x, np.array([0] * 3 + [1] * 3 + [2] * 3 + [-1]))
    assert merged.tolist() == [0] * 6 + [2] * 3 + [-1]
    chain = density.merge_similar(unit(-1, 0, 1, 19, 20, 21, 39, 40, 41), np.repeat([0, 1, 2], 3), density.MergeGates(member_min=0.90))
    assert chain.tolist() == [0] * 6 + [2] * 3


def test_two_blobs_and_a_single_point():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.01, (6, 2)) for c in ([1, 0], [0, 1])])
    labels, probability, _, _ = density.run(x, None, density.Parameters(epsilon=0.0))
    assert (labels[:6] == labels[0]).all() and (labels[6:] == labels[6]).all() and labels[0] != labels[6]
    assert (probability > 0).all()
    assert density.run(np.array([[1.0, 0.0]]))[0].tolist() == [-1]


def test_weak_structure_is_noise():
    x = np.random.default_rng(0).normal(size=(300, 64))
    labels, probability, _, _ = density.run(x, 8, optimise=True)
    assert (labels == -1).all() and not probability.any()


def test_medoid_and_source_cap():
    x = np.array([[-2.0], [0], [1], [2], [3], [4], [5]])
    ids = [f"asset_{i}" for i in range(7)]
    got = density.representatives(x, np.zeros(7, int), ids, ["s0", "s", "s", "s", "s4", "s5", "s6"], np.ones(7))
    assert ids[got[0][2]] == "asset_3" and sum(1 for g in got if g[2] in (1, 2, 3)) <= 2 and sum(g[3] == "edge" for g in got) <= 2


def video_row(i, a, b, parent="p", source="s"):
    return {"asset_id": i, "source_file_id": source, "asset_type": "video_segment", "index_role": "child", "parent": parent, "block": 0, "start_ms": a, "end_ms": b}


def test_folding_of_video_segments():
    got = fold.fold_rows([video_row("a", 0, 5000), video_row("b", 6000, 10000)], 5)
    assert len(got) == 1 and got[0]["end_ms"] == 10000
    assert len(fold.fold_rows([video_row("a", 0, 5000), video_row("b", 6000, 10000, "q")], 5)) == 2


def test_folding_remembers_the_highest_block_and_caps_sources():
    row = lambda i, b: video_row(i, 0, 0) | {"asset_type": "markdown_block", "block": b}
    got = fold.fold_rows([row("h", 4), row("x", 3), row("y", 5), row("z", 3)], 5)
    assert got[0]["folded"] == ["h", "x", "y"] and len(got) == 2
    images = [video_row(str(i), 0, 0, source="s" if i < 4 else "t") | {"asset_type": "image"} for i in range(5)]
    assert [r["asset_id"] for r in fold.fold_rows(images, 4)] == ["0", "1", "2", "4"]


def test_text_chunks():
    s = "字" * 149 + "。"
    assert [len(c.text) for c in chunk.chunk_text(s * 3, most=400)] == [300, 150]
    fence = "```\n" + "x" * 1300 + "\n```"
    assert [c.oversized for c in chunk.chunk_text(fence)] == ["indivisible_code_fence"]
    assert chunk.chunk_text("") == []


def test_markdown_sections_and_merging():
    body = lambda n: ("a" * 49 + ". ") * (n // 51)
    got = chunk.chunk_markdown(f"# A\n\n{body(400)}\n\n## B\n\n{body(400)}\n")
    assert [c.path for c in got] == [("A",), ("A", "B")]
    got = chunk.chunk_markdown(f"# A\n\n## X\n\n{'b' * 370}\n\n## Y\n\n{'c' * 170}\n")
    assert len(got) == 1 and 500 < len(got[0].text) <= 600
    table = "| a | b |\n|---|---|\n" + "| x | y |\n" * 100
    assert [c.oversized for c in chunk.chunk_markdown(table)] == ["indivisible_table"]
    rows = chunk.hierarchy(f"# A\n\n{body(900)}\n")
    assert rows[0]["role"] == "parent" and all(r["headings"] == "A" for r in rows)


def test_video_regions():
    assert video.merge_short([(0, 800), (800, 2000), (2000, 3500)]) == [(0, 2000), (2000, 3500)]
    e = unit(0, 1, 2, 90, 91)
    assert video.chain_clusters(e, 0.2) == [0, 0, 0, 1, 1]
    assert video.distinct_frames(unit(0, 1, 90), 0.9) == [0, 2]
    assert video.merge_to_target([4, 4, 4], unit(0, 1, 80), 10, 20, 0.85) == [[0, 1], [2]]


def test_feature_terms_and_paths(spark):
    df = spark.createDataFrame([("a；b; a ;;c", " x\\y.md "), (None, "/abs"), ("", "a/../b")], "t string, p string")
    got = df.select(text.feature_terms(F.col("t")).alias("t"), text.normal_path(F.col("p")).alias("p")).collect()
    assert [(r.t, r.p) for r in got] == [("a; b; c", "x/y.md"), (None, None), ("", None)]


def test_files_and_archives(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# hi ü")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.xyz").write_text("no")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/media/1.png", b"same")
        z.writestr("word/media/2.png", b"same")
    (tmp_path / "d.docx").write_bytes(buffer.getvalue())
    found = files.discover(spark, str(tmp_path))
    assert [(r.relative_path, r.kind) for r in found.orderBy("relative_path").collect()] == [("b.txt", "document"), ("d.docx", "document"), ("sub/a.md", "document")]
    assert files.import_plan(found).first()["files"] == 3
    assert {r.error for r in files.read_text(spark, str(tmp_path)).collect()} == {None, "not UTF-8"}
    docx = spark.read.format("binaryFile").load(str(tmp_path / "d.docx"))
    assert [len(r.occurrences) for r in files.embedded_images(docx).collect()] == [2]
    assert files.archive_fault(b"nope") == "not an archive"
    (tmp_path / "e.jsonl").write_text('{"request": {"query_type": "text"}, "relevant_asset_ids": ["a"]}\n\nbroken\n')
    assert files.read_evaluation(spark, str(tmp_path / "e.jsonl")).count() >= 2


def test_stream_is_idempotent(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "asset_id string, n int"
    for i in range(3):
        spark.createDataFrame([(f"a{i}", i), ("a0", 9)], schema).coalesce(1).write.mode("append").parquet(source)
    vectors = spark.createDataFrame([(f"a{i}", [float(i)]) for i in range(3)], "asset_id string, embedding array<double>")
    for _ in range(2):
        stream = jobs.read_stream(spark, source, spark.createDataFrame([], schema).schema)
        jobs.enrich_and_assign(stream, vectors, lambda x: x, sink, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.asset_id for r in spark.read.parquet(sink).collect()) == ["a0", "a1", "a2"]


def test_image_contexts():
    md = "# Trip\n\nWe went up.\n\n![the peak](img/a.png)\n\n## Lake\n\nBlue ![](b.jpg 'x') water ![w](https://x/y.png)\n\n```\n![no](c.png)\n```\n"
    assert chunk.image_contexts(md) == [
        {"path": "img/a.png", "caption": "the peak", "heading": "Trip", "preceding": "We went up."},
        {"path": "b.jpg", "caption": "", "heading": "Lake", "preceding": "Blue"},
    ]


def test_representative_frames():
    assert len(video.representative_frames(unit(0, 1, 2, 90, 91, 92))) == 2
    assert len(video.representative_frames(unit(5))) == 1


def test_sentences_and_delays():
    assert text.complete_sentence("好，") == "好。" and text.complete_sentence("Fine!") == "Fine!"
    assert text.complete_sentence("一二三四五六，七八九十", 9) == "一二三四五六。"
    assert text.retry_delays(7) == [1, 2, 4, 8, 16, 30, 30]


@pytest.mark.parametrize(
    "wrong",
    [
        {"query_type": "text"},
        {"query_type": "image", "query_text": "x"},
        {"query_type": "image_text", "query_text": "x"},
        {"query_type": "image", "image_url": "u", "image_upload": "i"},
        {"query_type": "text", "query_text": "x", "top_k": 101},
        {"query_type": "text", "query_text": "x", "channels": ("native", "native")},
        {"query_type": "text", "query_text": "x", "channels": ("visual_style",), "filters": request.Filters(asset_types=("text_block",))},
    ],
)
def test_wrong_requests(wrong):
    with pytest.raises(ValueError):
        request.Request("ws", **wrong)


def test_plans_degrade():
    own = request.Request("ws", "image_text", "q", image_url="u", channels=("native", "description"))
    good = request.plan(own, lambda r: ({"native": "n", "description": "d"}, {"native": 3, "description": 1}))
    assert good.channels == [("native", "n", 0.75, "joint"), ("description", "d", 0.25, "text")]
    bad = request.plan(own, lambda r: ({"native": "n"}, {"native": 1}))
    assert [c[2] for c in bad.channels] == [0.5, 0.5] and len(bad.reasons) == 1

    def encode(source, query):
        if source == "joint":
            raise RuntimeError("no")
        return [3.0, 4.0] if source == "image" else [0.0, 0.0]

    queries, reasons = request.embed(good, encode)
    assert queries == [("native", 1.0, [0.6, 0.8])] and len(reasons) == 2


def test_publication_faults(spark):
    clusters = spark.createDataFrame([("a", "A", "x"), ("a", "A", None), ("b", " ", "z"), ("c", "C", None)], "cluster_id string, name string, representative string")
    members = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "x")], "cluster_id string, asset_id string")
    got = sorted((r.id, r.fault) for r in checks.publish_faults(clusters, members).collect())
    assert got == [("a", "cluster repeated"), ("b", "blank name"), ("b", "representative is no member"), ("c", "no members"), ("x", "asset repeated")]
