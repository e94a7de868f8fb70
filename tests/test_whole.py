"""Queries over the whole input, on small tables."""

from conftest import DATA

from lodestar.catalog import QUERIES


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_medoids_of_all_vectors(spark):
    import numpy as np

    from lodestar.operators import assign
    from lodestar.plans.domain import Domain

    rows = Domain(spark, f"{DATA}/sf0.01").vectors.where("ch = 0").select("label", "embedding_id", "doc_id", "embedding")
    got = rows.collect()
    assert max(r.doc_id for r in got) >= 400
    want = {}
    for label in {r.label for r in got}:
        own = sorted((r.embedding_id, r.embedding) for r in got if r.label == label)
        x = np.array([e for _, e in own], np.float64)
        total = [np.sqrt(((x - p) ** 2).sum(axis=1)).sum() for p in x]
        best = min(range(len(own)), key=lambda k: (round(total[k], 9), own[k][0]))
        want[label] = (own[best][0], round(total[best], 4))
    for found in (QUERIES["cluster_medoids"](spark, f"{DATA}/sf0.01"), assign.medoids(rows, 7)):
        assert {r.label: (r.medoid, round(r.total, 4)) for r in found.collect()} == want


def test_path_terms_of_whole_texts(spark, tmp_path):
    rows = [(1, "alpha " * 60 + "omega"), (2, "x" * 299 + "yz 12 ending"), (3, None), (4, "")]
    got = {r.part: r.semantic for r in QUERIES["path_terms"](spark, written(spark, tmp_path, "documents", rows, "doc_id long, text string")).collect()}
    assert got == {"alpha": True, "omega": True, "x" * 299 + "yz": False, "12": False, "ending": False, "": False}


def test_ocr_of_all_turns(spark, tmp_path):
    rows = [(6, 0, " one "), (6, 3, "two " * 10), (6, 4, "  "), (7, 5, "late"), (1, 9, "weak"), (8, 4, " ")]
    schema = "conv_id long, turn int, text string"
    got = {r.image: (r.text, r.status, r.line_count) for r in QUERIES["ocr_accept"](spark, written(spark, tmp_path, "conversations", rows, schema)).collect()}
    two = ("two " * 10).strip()
    assert got == {6: (f"one\n{two}", "accepted", 2), 7: ("late", "accepted", 1), 1: (None, "filtered", 1), 8: (None, "empty", 0)}


def test_features_and_names_of_whole_texts(spark, tmp_path):
    rows = [(1, "same " * 100 + "b c d e f"), (2, " " * 50 + "n" * 45), (3, " " * 70 + "late")]
    sf_dir = written(spark, tmp_path, "documents", rows, "doc_id long, text string")
    terms = {r.doc_id: r.terms for r in QUERIES["feature_normalize"](spark, sf_dir).collect()}
    assert terms == {1: "same; b; c; d; e", 2: "n" * 32, 3: "late"}
    names = {r.doc_id: r.name for r in QUERIES["name_bounds"](spark, sf_dir).collect()}
    assert names == {1: ("same " * 100)[:40], 2: "n" * 40, 3: "late"}
