"""What a model is shown of a cluster, and the repair of the names and descriptions that it gives back.

Evidence is made for all clusters at once, as JSON in columns. The repair sees one cluster's few directories, words and
files (paths.contexts) beside its name, and is a small function of a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import normalised
from .text import complete_sentence

#: Names of the channels as a model is told them, and the channels that are told of paths.
LABELS = {
    "native_multimodal": "跨模态内容语义", "asset_description": "资产自然语言描述", "subject_content": "主体与内容", "scene_theme": "场景与题材", "visual_style": "视觉风格",
    "color_composition": "色彩与构图", "mood_atmosphere": "画面情绪氛围", "character_state_or_psychology": "人物状态或心理", "asset_usage": "资产用途", "target_audience": "目标受众",
    "provenance": "来源与创作关系", "rights_version_authorship": "权利、版本与作者",
}
PATH_AWARE = ("subject_content", "asset_usage")
#: The longest description, and what of it a path's beginning leaves at least.
DESCRIPTION, LEFT = 150, 50


def _json(fields: dict[str, Column]) -> Column:
    """An object with its fields in this order, nulls among them."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def representative_evidence(embedding_type: Column) -> Column:
    """JSON of a representative, by the channel: its name and description, its description, or its text in this channel.

    Channels that are told of paths have the path and the file's name too, for usage with a path of its own before the
    asset's. A column of (asset_id, role, probability, distance, asset_name, asset_description, feature,
    usage_description, usage_path, relative_path); what a channel is not told is not in its evidence.
    """
    common = {"asset_id": F.col("asset_id"), "role": F.col("role"), "membership_probability": F.round("probability", 4), "distance_to_medoid": F.round("distance", 6)}
    own_path = normalised(F.coalesce(F.when((embedding_type == "asset_usage") & (F.trim("usage_path") != ""), F.col("usage_path")), F.col("relative_path")))
    usage = F.when((embedding_type == "asset_usage") & (F.trim("usage_description") != ""), F.trim("usage_description"))
    told = F.struct(F.col("feature").alias("current_dimension_feature"))
    paths = F.to_json(F.struct(usage.alias("asset_usage_description"), own_path.alias("source_relative_path"), F.when(own_path.isNotNull(), F.element_at(F.split(own_path, "/"), -1)).alias("source_file_name")))
    plain = F.to_json(told, {"ignoreNullFields": "false"})

    def joined(*parts: Column) -> Column:
        """One object of several; empty ones add nothing."""
        inner = F.filter(F.array(*[F.substring(p, F.lit(2), F.length(p) - 2) for p in parts]), lambda p: p != "")
        return F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}"))

    base = _json(common)
    return (
        F.when(embedding_type == "native_multimodal", joined(base, _json({"asset_name": F.col("asset_name"), "asset_description": F.col("asset_description")})))
        .when(embedding_type == "asset_description", joined(base, _json({"asset_description": F.col("asset_description")})))
        .when(embedding_type.isin(*PATH_AWARE), joined(base, plain, paths))
        .otherwise(joined(base, plain))
    )


def evidence(clusters: DataFrame, representatives: DataFrame, contexts: DataFrame, most: int | None = None) -> DataFrame:
    """(cluster_id, evidence) of clusters(cluster_id, embedding_type, member_count, probability): JSON for a model.

    representatives(cluster_id, rank, ..) are those of representative_evidence(), in the order of their ranks; of a budget
    of `most` characters the first take their share, the rest is left out, but the first is always told. contexts are
    paths.contexts(), told where the channel is. A cluster without representatives has no row.
    """
    kinds = clusters.select("cluster_id", "embedding_type")
    told = representatives.join(kinds, "cluster_id").select("cluster_id", "rank", representative_evidence(F.col("embedding_type")).alias("told"))
    # A cluster has ten representatives and eighteen lines of context at most.
    reps = told.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "told"))), lambda r: r["told"]).alias("reps"))
    if most is not None:
        used = F.transform(F.sequence(F.lit(1), F.size("reps")), lambda i: F.length(F.array_join(F.slice("reps", F.lit(1), i), ",")))
        reps = reps.withColumn("reps", F.slice("reps", F.lit(1), F.greatest(F.lit(1), F.size(F.filter(used, lambda n: n <= most)))))
    lines = contexts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "value", "n"))).alias("lines"))

    def listed(kind: str, fields) -> Column:
        own = F.filter(F.coalesce("lines", F.array().cast("array<struct<kind:string,rank:int,value:string,n:bigint>>")), lambda x: x["kind"] == kind)
        return F.transform(own, fields)

    context = F.struct(
        listed("directory", lambda x: F.struct(x["value"].alias("directory"), x["n"].alias("member_count"))).alias("directory_counts"),
        listed("term", lambda x: F.struct(x["value"].alias("term"), x["n"].alias("member_count"))).alias("semantic_path_terms"),
        listed("file", lambda x: F.struct(F.element_at(F.split(x["value"], "/"), -1).alias("file_name"), x["value"].alias("relative_path"))).alias("representative_files"),
    )
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.col("embedding_type")), F.col("embedding_type"))
    head = F.to_json(
        F.struct(
            "embedding_type", label.alias("semantic_dimension"), F.struct(F.col("member_count"), F.round("probability", 4).alias("average_membership_probability")).alias("cluster_statistics")
        )
    )
    tail = F.when(F.col("embedding_type").isin(*PATH_AWARE), F.concat(F.lit(',"member_source_context":'), F.to_json(context))).otherwise("")
    whole = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"representative_assets":['), F.array_join("reps", ","), F.lit("]"), tail, F.lit("}"))
    return clusters.join(reps, "cluster_id").join(lines, "cluster_id", "left").select("cluster_id", whole.alias("evidence"))


def _short(value: str, most: int) -> str:
    head = (most - 1) // 2
    return value if len(value) <= most else "…" if most <= 1 else f"{value[:head]}…{value[len(value) - (most - head - 1) :]}"


def described(description: str, directories: list[tuple[str, int]], terms: list[tuple[str, int]], files: list[str], most: int = DESCRIPTION) -> str:
    """The description behind a sentence on the paths, `most` characters in all, a whole sentence; the same if it names them.

    The file that is named lies under the first word, else in the first directory, else it is the first. Where the
    sentence exceeds its budget it is made without the path, then with its parts shortened.
    """
    if not files:
        return description
    term, count = terms[0] if terms else ("", 0)
    folder = lambda path: path.rpartition("/")[0]
    under = next((f for f in files if term and term in folder(f).split("/")), None)
    path = under or next((f for f in files if directories and folder(f) == directories[0][0]), files[0])
    name, own = path.rpartition("/")[2], folder(path)
    if path in description:
        return description
    named = f"代表文件「{name}」位于相对路径「{path}」。"
    if term:
        named = f"路径实体「{term}」出现在{count}项成员中；{named}"
    elif directories:
        named = f"成员中{directories[0][1]}项来自「{directories[0][0]}」；{named}"
    budget = max(40, most - LEFT)
    if len(named) > budget:
        named = (f"路径实体「{term}」覆盖{count}项；" if term else "") + f"相对目录「{own}」，代表文件「{name}」。"
    if len(named) > budget:
        named = f"相对目录「{_short(own, 30)}」，代表文件「{_short(name, max(12, budget - len(own) - 25))}」。"
    left = most - len(named)
    return _short(named, most) if left <= 0 else (named + complete_sentence(description, left)).rstrip()


def named(name: str, terms: list[tuple[str, int]], with_path: int) -> str:
    """The name behind the first word of the paths, unless it has it; one that not all members share says so."""
    if not terms or not terms[0][0] or terms[0][0] in name:
        return name
    return f"{terms[0][0]}{'及其他' if terms[0][1] < with_path else ''}{name}"


def repaired(summaries: DataFrame, contexts: DataFrame, members: DataFrame) -> DataFrame:
    """summaries(cluster_id, embedding_type, name, description) with names and descriptions that tell of their paths.

    contexts are paths.contexts() of members(cluster_id, .., relative_path). Channels that are not told of paths, clusters
    without a usable path, and null names and descriptions stay as they are.
    """
    usable = members.where(normalised(F.col("relative_path")).isNotNull()).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_with"))
    lines = contexts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "value", "n"))).alias("_lines"))
    rows, columns = summaries.join(lines, "cluster_id", "left").join(usable, "cluster_id", "left"), summaries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            rows = batch.to_pylist()
            for row in rows:
                if row["embedding_type"] not in PATH_AWARE or not row["_lines"]:
                    continue
                of = {kind: [(x["value"], x["n"]) for x in row["_lines"] if x["kind"] == kind] for kind in ("directory", "term", "file")}
                if row["description"] is not None:
                    row["description"] = described(row["description"], of["directory"], of["term"], [v for v, _ in of["file"]])
                if row["name"] is not None:
                    row["name"] = named(row["name"], of["term"], row["_with"] or 0)
            new = {c: pa.array([r[c] for r in rows], pa.string()) for c in ("name", "description")}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(at[c]) for c in columns], columns)

    return rows.mapInArrow(run, summaries.schema)
