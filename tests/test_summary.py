"""Evidence of clusters, and names and descriptions that tell of paths."""

import json

from lodestar.operators import paths, summary

GENERIC, SUFFIXES = ("海报", "小说编辑", "测试", "png"), ("参考", "编辑", "测试")


def tables(spark):
    clusters = [(1, "native_multimodal", 42, 0.81234), (2, "asset_usage", 3, 0.5), (3, "visual_style", 2, 1.0), (4, "subject_content", 9, 1.0)]
    clusters = spark.createDataFrame(clusters, "cluster_id int, embedding_type string, member_count long, probability double")
    rows = [
        (1, 1, "b", "edge", 0.3, 1.2, None, "d2", "f", None, None, "x/y.png"), (1, 0, "a", "medoid", 0.98123, 0.0, "name", "d\"1", "f", None, None, None),
        (2, 0, "c", "medoid", 1.0, 0.0, "n", "d", "use", " how ", " own/p.png ", "x/y.png"), (2, 1, "d", "core", 1.0, 0.5, "n", "d", None, "", "", "../z.png"),
        (3, 0, "e", "medoid", 1.0, 0.0, "n", "d", "noir", "u", "v", "x/y.png"),
    ]
    reps = spark.createDataFrame(
        rows,
        "cluster_id int, rank int, asset_id string, role string, probability double, distance double, asset_name string, asset_description string, feature string, "
        "usage_description string, usage_path string, relative_path string",
    )
    members = [(2, "c", "项目/古小玲/a.png"), (2, "d", "项目/古小玲/b.png"), (2, "g", None), (3, "e", "x/y.png")]
    return clusters, reps, spark.createDataFrame(members, "cluster_id int, asset_id string, relative_path string")


def test_evidence_has_what_a_channel_is_told(spark):
    clusters, reps, members = tables(spark)
    found = summary.evidence(clusters, reps, paths.contexts(members, GENERIC, SUFFIXES))
    got = {r.cluster_id: json.loads(r.evidence) for r in found.collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["semantic_dimension"] == "跨模态内容语义" and got[1]["cluster_statistics"] == {"member_count": 42, "average_membership_probability": 0.8123}
    assert got[1]["representative_assets"] == [
        {"asset_id": "a", "role": "medoid", "membership_probability": 0.9812, "distance_to_medoid": 0.0, "asset_name": "name", "asset_description": 'd"1'},
        {"asset_id": "b", "role": "edge", "membership_probability": 0.3, "distance_to_medoid": 1.2, "asset_name": None, "asset_description": "d2"},
    ]
    assert "member_source_context" not in got[1] and "member_source_context" not in got[3]
    assert got[2]["representative_assets"][0] | {} == {
        "asset_id": "c", "role": "medoid", "membership_probability": 1.0, "distance_to_medoid": 0.0, "current_dimension_feature": "use",
        "asset_usage_description": "how", "source_relative_path": "own/p.png", "source_file_name": "p.png",
    }
    assert got[2]["representative_assets"][1] == {"asset_id": "d", "role": "core", "membership_probability": 1.0, "distance_to_medoid": 0.5, "current_dimension_feature": None}
    assert got[2]["member_source_context"] == {
        "directory_counts": [{"directory": "项目/古小玲", "member_count": 2}], "semantic_path_terms": [{"term": "古小玲", "member_count": 2}],
        "representative_files": [{"file_name": "a.png", "relative_path": "项目/古小玲/a.png"}, {"file_name": "b.png", "relative_path": "项目/古小玲/b.png"}],
    }
    assert got[3]["representative_assets"][0]["current_dimension_feature"] == "noir" and len(got[3]["representative_assets"][0]) == 5
    small = summary.evidence(clusters, reps, paths.contexts(members, GENERIC, SUFFIXES), most=10)
    assert {r.cluster_id: len(json.loads(r.evidence)["representative_assets"]) for r in small.collect()} == {1: 1, 2: 1, 3: 1}


def test_names_and_descriptions_tell_of_paths(spark):
    long_name = "MoriMai_httpss.mj.runPIXbomaA8kc_An_anime-style_digital_illus_59b7f9ba-6677-40d3-8479-acc48a9b26ff_3.png"
    wang = "本组资产的核心主体均为男性角色汪叹之，呈现形式均为人物立绘，局部服饰和视角存在轻微差异，其中既有正面视图，也包含背面和半身视图等补充内容。"
    tale = "本组资产主要用于动画角色设计参考，成员具有相似的人物呈现方式，可为角色造型和视觉设定环节提供素材依据"
    own = {
        1: ["第一集/汪叹之/1/x.png", "第一集/汪叹之/1/正视图√.png", "第一集/汪叹之/1/23333332.png", "第一集/汪叹之/20251127.png"],
        2: [f"第一集/小说编辑/测试/{long_name}", f"第一集/小说编辑/测试/copy_{long_name}"],
        3: ["项目/古小玲/2√.png", "项目/古小玲/b.png", "其他/x.png"],
        4: ["项目/古小玲/2√.png", "项目/古小玲/b.png"],
    }
    members = spark.createDataFrame([(c, f"{c}-{i}", p) for c, rows in own.items() for i, p in enumerate(rows)], "cluster_id int, asset_id string, relative_path string")
    rows = [(1, "subject_content", "男性汪叹之立绘", wang, 7), (2, "asset_usage", "动画角色参考", tale, 7), (3, "subject_content", "二次元少女立绘", "短。", 7), (4, "visual_style", "风格", "描述", 7), (5, "asset_usage", "无路径", None, 7)]
    summaries = spark.createDataFrame(rows, "cluster_id int, embedding_type string, name string, description string, kept int")
    found = summary.repaired(summaries, paths.contexts(members, GENERIC, SUFFIXES), members)
    got = {r.cluster_id: r for r in found.collect()}
    assert found.columns == summaries.columns and all(r.kept == 7 for r in got.values())
    assert got[1].name == "男性汪叹之立绘" and "「汪叹之」出现在4项成员中" in got[1].description and len(got[1].description) <= 150
    assert "相对目录「第一集/小说编辑/测试」" in got[2].description and got[2].description.endswith("。") and len(got[2].description) <= 150 and got[2].name == "动画角色参考"
    assert got[3].name == "古小玲及其他二次元少女立绘" and "「古小玲」出现在2项成员中" in got[3].description and "代表文件「2√.png」" not in got[3].description
    assert got[3].description.endswith("短。") and "项目/古小玲/b.png" in got[3].description
    assert (got[4].name, got[4].description) == ("风格", "描述") and (got[5].name, got[5].description) == ("无路径", None)
    again = summary.repaired(found, paths.contexts(members, GENERIC, SUFFIXES), members)
    assert {r.cluster_id: r.description for r in again.collect()}[3] == got[3].description
