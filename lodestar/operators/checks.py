"""Small predicates, projections and constraint checks; a check is a query that returns violations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of file facts that are shown.
FILE_INFO_KEYS = ("width", "height", "duration_seconds", "frame_count", "format", "mime_type")
OCR_CONFIDENCE, OCR_CHARACTERS = 0.55, 2


def hit_projection(hits: DataFrame) -> DataFrame:
    """hits(id, entity struct, distance, score) with defaults: rows without ids go; revision 0 or null is 1; a missing or zero
    distance gives way to the score, then to 0."""
    empty = F.lit("")
    e = F.coalesce(F.nullif(F.col("entity.embedding_id"), empty), F.nullif(F.col("id"), empty))
    out = hits.select(
        e.alias("embedding_id"),
        F.nullif(F.col("entity.asset_id"), empty).alias("asset_id"),
        F.coalesce(F.nullif(F.col("entity.embedding_revision"), F.lit(0)), F.lit(1)).alias("embedding_revision"),
        F.coalesce(F.nullif("distance", F.lit(0.0)), F.nullif("score", F.lit(0.0)), F.lit(0.0)).alias("similarity"),
    )
    return out.where("embedding_id is not null and asset_id is not null")


def compact_file_info(info: Column) -> Column:
    """A map of facts with the keys that are shown and have a value."""
    return F.map_filter(info, lambda k, v: k.isin(*FILE_INFO_KEYS) & v.isNotNull())


def json_text(value: Column) -> Column:
    """A JSON document as text: strings are unwrapped, other documents stay JSON."""
    return F.when(value.rlike('^\\s*"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]).otherwise(value)


def ocr_lines(lines: DataFrame) -> DataFrame:
    """(image, text, status, confidence, line_count) of lines(image, no, text, score): accepted by mean confidence and length."""
    own = lines.where(F.trim("text") != "").groupBy("image").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", F.trim("text").alias("t")))), lambda s: s["t"]), "\n").alias("text"),
        F.avg("score").alias("mean"),
        F.count(F.lit(1)).alias("line_count"),
    )
    out = lines.select("image").distinct().join(own, "image", "left")
    good = (F.col("mean") >= OCR_CONFIDENCE) & (F.length("text") >= OCR_CHARACTERS)
    status = F.when(F.col("mean").isNull(), "empty").when(good, "accepted").otherwise("filtered")
    return out.select("image", F.when(good, F.col("text")).alias("text"), status.alias("status"), F.round("mean", 6).alias("confidence"), F.coalesce("line_count", F.lit(0).cast("long")).alias("line_count"))


def storage_uris(rows: DataFrame, column: str) -> DataFrame:
    """(uri): the distinct storage URIs that are whole string values anywhere in a column of JSON documents."""

    def walk(value) -> Iterator[str]:
        if isinstance(value, str) and value.startswith(("s3://", "file://")):
            yield value
        elif isinstance(value, dict):
            for v in value.values():
                yield from walk(v)
        elif isinstance(value, list):
            for v in value:
                yield from walk(v)

    def one(text: str | None) -> list[str]:
        try:
            return sorted(set(walk(json.loads(text)))) if text else []
        except ValueError:
            return []

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return rows.select(F.explode(found(F.col(column))).alias("uri")).distinct()


def representative_faults(reps: DataFrame, sources: DataFrame, per_source: int = 2) -> DataFrame:
    """(cluster_id, fault) of reps(cluster_id, asset_id, rank, role) that are not unique, not ranked from 0 without gaps, have
    not exactly one medoid at rank 0, or more than two of a source."""
    own = reps.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("asset_id").alias("assets"),
        F.count_distinct("rank").alias("ranks"),
        F.min("rank").alias("low"),
        F.max("rank").alias("high"),
        F.count_if(F.col("role") == "medoid").alias("medoids"),
        F.count_if((F.col("role") == "medoid") & (F.col("rank") == 0)).alias("first"),
    )
    crowded = reps.join(sources, "asset_id").groupBy("cluster_id", "source_file_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_source)
    faults = F.array_compact(
        F.array(
            F.when(F.col("assets") < F.col("n"), "asset repeated"),
            F.when((F.col("ranks") < F.col("n")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1), "ranks have gaps"),
            F.when((F.col("medoids") != 1) | (F.col("first") != 1), "not one medoid at rank 0"),
        )
    )
    return own.select("cluster_id", F.explode(faults).alias("fault")).unionByName(crowded.select("cluster_id", F.lit("too many of a source").alias("fault")).distinct())


def publish_faults(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(id, fault) of a publication: ids twice, blank names, clusters without members, representatives from outside, assets twice."""
    twice = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("cluster_id").alias("id"), F.lit("cluster repeated").alias("fault"))
    blank = clusters.where(F.coalesce(F.trim("name"), F.lit("")) == "").select(F.col("cluster_id").alias("id"), F.lit("blank name").alias("fault"))
    empty = clusters.join(members, "cluster_id", "left_anti").select(F.col("cluster_id").alias("id"), F.lit("no members").alias("fault"))
    rep = clusters.where("representative is not null").select("cluster_id", F.col("representative").alias("asset_id"))
    outside = rep.join(members, ["cluster_id", "asset_id"], "left_anti").select(F.col("cluster_id").alias("id"), F.lit("representative is no member").alias("fault"))
    shared = members.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("asset_id").alias("id"), F.lit("asset repeated").alias("fault"))
    return twice.unionByName(blank).unionByName(empty).unionByName(outside).unionByName(shared)


def semantic_term(term: Column, generic: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether a directory name tells what is inside: not generic, no number, hash or volume, of a plausible length."""
    t = F.trim(term)
    han = t.rlike("[㐀-鿿]")
    dull = generic | t.rlike("^第?[0-9一二三四五六七八九十百]+[集章节季期幕版]$") | t.rlike("[0-9]")
    for s in suffixes:
        dull = dull | t.endswith(s)
    fine = F.when(han, F.length(t).between(2, 12)).otherwise(t.rlike("^[A-Za-z][A-Za-z _-]{2,30}$"))
    return (t != "") & ~dull & ~t.rlike("^[0-9a-fA-F]{8,}$") & fine


def readable_name(name: Column) -> Column:
    """Whether a file's name means something to a reader: letters, and neither a hash nor a number."""
    stem = F.trim(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", ""))
    return (stem != "") & ~stem.rlike("^[0-9a-fA-F]{8,}$") & stem.rlike("[㐀-鿿A-Za-z]")


def abbreviate(text: Column, most: int) -> Column:
    """At most `most` characters: the beginning and the end around an ellipsis."""
    head = (most - 1) // 2
    tail = most - head - 1
    short = F.concat(F.substring(text, 1, head), F.lit("…"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= most, text).otherwise(short if most > 1 else F.lit("…"))
