"""Text, path and identity expressions of assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .assets import blank_to_null

MAX_TERMS, MAX_TERM, MAX_NAME, MAX_DESCRIPTION = 5, 32, 40, 500
MAX_ASSOCIATED, MAX_ASSOCIATED_CHARS = 4, 2000


def strip_data_uris(text: Column) -> Column:
    """Text without embedded images; their alternative text stays."""
    text = F.regexp_replace(text, r"!\[\]\(data:image/[^)]*\)", "")
    text = F.regexp_replace(text, r"!\[([^\]]+)\]\(data:image/[^)]*\)", "$1")
    return F.regexp_replace(text, r"(?i)<img[^>]*src=[\"']data:image/[^>]*>", "")


def feature_terms(text: Column) -> Column:
    """Distinct terms between semicolons, trimmed, at most five of 32 characters each, joined by '; '."""
    parts = F.transform(F.split(text, "[;；]"), lambda t: F.substring(F.trim(t), 1, MAX_TERM))
    kept = F.slice(F.array_distinct(F.filter(parts, lambda t: t != "")), 1, MAX_TERMS)
    return F.array_join(kept, "; ")


def bounded(text: Column, most: int) -> Column:
    return F.substring(F.trim(text), 1, most)


def associated(*texts: Column) -> Column:
    """The distinct texts that are not blank, cut to 2000 characters, at most four."""
    parts = F.transform(F.array(*texts), lambda t: F.substring(F.trim(t), 1, MAX_ASSOCIATED_CHARS))
    return F.slice(F.array_distinct(F.filter(parts, lambda t: t.isNotNull() & (t != ""))), 1, MAX_ASSOCIATED)


def normal_path(path: Column) -> Column:
    """Trimmed with forward slashes; null for absolute paths and those that climb."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    bad = p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(F.split(p, "/"), "..")
    return F.when(~bad & (p != ""), p)


def directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def usage_hint(path: Column, keywords: list[tuple[str, str]]) -> Column:
    """The label of the first keyword in the lower-cased path, else the first three parts joined by '；'."""
    out = F.lit(None).cast("string")
    for word, label in reversed(keywords):
        out = F.when(F.contains(F.lower(path), F.lit(word)), label).otherwise(out)
    parts = F.array_distinct(F.filter(F.split(path, "/"), lambda p: F.trim(p) != ""))
    return F.coalesce(out, F.nullif(F.array_join(F.slice(parts, 1, 3), "；"), F.lit("")))


def embedding_text(channel: Column, feature: Column, description: Column, path: Column) -> Column:
    """What a channel embeds; asset_usage has the directory too, never the file's name."""
    usage = F.concat_ws("\n", feature, F.nullif(directory(path), F.lit("")))
    return F.when(channel == "description", blank_to_null(description)).when(channel == "asset_usage", usage).otherwise(feature)


def canonical_json(**values: Column) -> Column:
    """JSON of the values in one form: keys in order, no blanks, nulls written out, letters as they are; the input of keys.

    Structs and maps among the values are as they are; ordered() puts their keys in order, however deep.
    """
    own = F.struct(*(values[k].alias(k) for k in sorted(values)))
    return F.to_json(own, {"ignoreNullFields": "false"})


def ordered(value: Column, kind: T.DataType) -> Column:
    """value, of type kind, with the keys of all structs and maps within it in order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[ordered(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), ordered(e["value"], kind.valueType).alias("value")))
        # By keys alone: values may not be comparable, and keys differ.
        by_key = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(by_key)
    return value


def framed_hash(*parts: Column) -> Column:
    """sha256 of the parts, each after its byte length as eight big-endian bytes."""
    framed = [x for p in parts for x in (F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), p.cast("binary"))]
    return F.sha2(F.concat(*framed), 256)


def asset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What replacing old by new(asset_key, content_hash) does: insert, update, keep or delete.

    A changed content raises the revision by one; an asset keeps its id and the name that a user gave it.
    """
    o = old.select("asset_key", F.col("content_hash").alias("old_hash"), F.col("revision").alias("old_revision"), "user_name")
    met = o.join(new.select("asset_key", F.col("content_hash").alias("new_hash")), "asset_key", "full")
    action = (
        F.when(F.col("new_hash").isNull(), "delete")
        .when(F.col("old_hash").isNull(), "insert")
        .when(F.col("old_hash") != F.col("new_hash"), "update")
        .otherwise("keep")
    )
    met = met.withColumn("action", action)
    revision = F.when(F.col("action") == "update", F.col("old_revision") + 1).otherwise(F.coalesce("old_revision", F.lit(1)))
    return met.select("asset_key", "action", revision.alias("revision"), "user_name")


def store_understanding(assets: DataFrame, understood: DataFrame) -> DataFrame:
    """assets after what a model understood of some: name, description and features, and the revisions that this moves on.

    assets(asset_id, asset_name, asset_name_source, asset_description, asset_features, feature_revision,
    embedding_revision, processing_status, ..), understood(asset_id, asset_name, asset_description, asset_features);
    features are JSON in one form. Both revisions go up by one if there was another description, or other features; the
    first understanding of an asset moves none. A name that a user gave stays. What was understood of an asset that is not
    there is left out; see unknown_assets().
    """
    new = understood.select("asset_id", *[F.col(c).alias(f"_{c}") for c in ("asset_name", "asset_description", "asset_features")], F.lit(True).alias("_told"))
    met = assets.join(new, "asset_id", "left")
    told = F.coalesce("_told", F.lit(False))
    described = F.col("asset_description").isNotNull() & ~F.col("asset_description").eqNullSafe(F.col("_asset_description"))
    featured = F.coalesce(F.col("asset_features") != "{}", F.lit(False)) & ~F.col("asset_features").eqNullSafe(F.col("_asset_features"))
    more = F.when(told & (described | featured), 1).otherwise(0)
    renamed = told & ~F.col("asset_name_source").eqNullSafe(F.lit("user"))
    values = {
        "asset_name": F.when(renamed, F.col("_asset_name")).otherwise(F.col("asset_name")),
        "asset_name_source": F.when(renamed, "model").otherwise(F.col("asset_name_source")),
        "asset_description": F.when(told, F.col("_asset_description")).otherwise(F.col("asset_description")),
        "asset_features": F.when(told, F.col("_asset_features")).otherwise(F.col("asset_features")),
        "feature_revision": F.col("feature_revision") + more,
        "embedding_revision": F.col("embedding_revision") + more,
        "processing_status": F.when(told, "processing").otherwise(F.col("processing_status")),
    }
    return met.select(*[values[c].alias(c) if c in values else F.col(c) for c in assets.columns])


def unknown_assets(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """The rows whose asset_id is no asset's."""
    return rows.join(assets.select("asset_id"), "asset_id", "left_anti")


def attach_parents(drafts: DataFrame) -> DataFrame:
    """drafts(source_file_id, asset_key, hierarchy_key, parent_hierarchy_key, asset_id, ..) with parent_asset_id and fault.

    A child's parent is the draft of its source with that hierarchy_key; its asset_id is that of the parent's asset_key. A
    child whose parent is not among the drafts has the fault 'missing parent', one that names several 'ambiguous parent',
    one that is its own 'own parent'; drafts without a parent_hierarchy_key have neither parent nor fault.
    """
    parents = drafts.where("hierarchy_key is not null").groupBy("source_file_id", F.col("hierarchy_key").alias("parent_hierarchy_key"))
    parents = parents.agg(F.min("asset_id").alias("parent_asset_id"), F.count_distinct("asset_key").alias("_n"))
    met = drafts.join(parents, ["source_file_id", "parent_hierarchy_key"], "left")
    own = F.col("hierarchy_key").eqNullSafe(F.col("parent_hierarchy_key"))
    fault = F.when(F.col("parent_hierarchy_key").isNull(), None).when(F.col("_n").isNull(), "missing parent").when(own, "own parent").when(F.col("_n") > 1, "ambiguous parent")
    return met.select(*drafts.columns, F.when(fault.isNull(), F.col("parent_asset_id")).alias("parent_asset_id"), fault.alias("fault"))


def unchanged(files: DataFrame, known: DataFrame) -> DataFrame:
    """files that must be processed: path, sha and fingerprint of a completed one are not known yet."""
    return files.join(known.where("status = 'completed'"), ["path", "sha", "fingerprint"], "left_anti")


_SENTENCE_ENDS, _CLAUSE_ENDS, _LOOSE = "。！？!?", "；;，,", "，、；：,;: "


def complete_sentence(text: str, most: int = 150) -> str:
    """At most `most` characters that end as a sentence: cut after its last clause in the second half, else with a full stop."""
    if len(text) <= most and text.endswith(tuple(_SENTENCE_ENDS)):
        return text
    if len(text) < most:
        return text.rstrip(_LOOSE) + "。"
    if most <= 1:
        return "。"
    body = text[: most - 1].rstrip(_LOOSE)
    last = max(body.rfind(c) for c in _SENTENCE_ENDS + _CLAUSE_ENDS)
    if len(text) > most and last >= most // 2:
        return body[: last + 1] if body[last] in _SENTENCE_ENDS else body[:last] + "。"
    return body + "。"


def retry_delays(attempts: int, first: float = 1.0, cap: float = 30.0) -> list[float]:
    """Seconds to wait before each retry: doubled each time, up to the cap."""
    return [min(cap, first * 2**k) for k in range(attempts)]
