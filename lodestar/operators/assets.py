"""Live assets, channel eligibility and the latest-embedding queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Channels that only images and video segments have, and statuses that hide a feature's text.
VISUAL_CHANNELS = ("visual_style", "color_composition")
VISUAL_TYPES = ("image", "video_segment")
NULL_STATUSES = ("unknown", "not_applicable")


def live(assets: DataFrame, sources: DataFrame, workspace: str) -> DataFrame:
    """Assets of the current generation of their source, in the workspace on both sides, parents left out."""
    own = sources.where(F.col("workspace_id") == workspace).select("source_file_id", "relative_path", "processing_generation")
    kept = assets.where((F.col("workspace_id") == workspace) & (F.col("index_role") != "parent"))
    joined = kept.join(own, "source_file_id")
    return joined.where(F.col("generation") == F.col("processing_generation")).drop("processing_generation")


def supports(channel: Column, asset_type: Column) -> Column:
    """Whether a channel means anything for a type of asset."""
    return ~channel.isin(*VISUAL_CHANNELS) | asset_type.isin(*VISUAL_TYPES)


def supports_any(channel: Column, asset_types: Column) -> Column:
    """Whether it does for one of several types; no types stand for all."""
    none = F.coalesce(F.size(asset_types), F.lit(0)) <= 0
    return none | F.exists(asset_types, lambda t: supports(channel, t))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def feature_text(status: Column, value: Column, user: Column, model: Column | None = None, has_effective: Column | None = None, effective: Column | None = None) -> Column:
    """The text of a feature in force.

    Statuses unknown and not_applicable hide it. An explicit effective value wins even if it is null, so its presence
    is an argument of its own. Else the first of user, model and plain value that is not blank.
    """
    first = F.coalesce(*[blank_to_null(c) for c in (user, model, value) if c is not None])
    if has_effective is not None:
        first = F.when(has_effective, blank_to_null(effective)).otherwise(first)
    return F.when(~F.coalesce(status.isin(*NULL_STATUSES), F.lit(False)), first)


def eligible(channel: Column, description: Column, feature: Column) -> Column:
    """native always; description if not blank; other channels if their feature has a text."""
    return (
        F.when(channel == "native", True)
        .when(channel == "description", blank_to_null(description).isNotNull())
        .otherwise(feature.isNotNull())
    )


def latest(rows: DataFrame, *keys: str, order: str = "created_at_ts", tie: str = "embedding_id") -> DataFrame:
    """The latest row of each key, the larger tie-break first."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def embedding_states(records: DataFrame) -> DataFrame:
    """Per asset the latest state of each of its channels, whatever the status."""
    last = latest(records, "asset_id", "embedding_type")
    return last.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("embedding_type", "status", "embedding_id"))).alias("states"))


def run_inputs(records: DataFrame, live_assets: DataFrame, channel: str, model: str, check_types: bool = False) -> DataFrame:
    """Latest indexed embedding of each eligible live asset in a channel; `check_types` also rules out unfit types."""
    own = records.where((F.col("embedding_type") == channel) & (F.col("status") == "indexed") & (F.col("model_name") == model))
    own = latest(own, "asset_id")
    columns = live_assets.select("asset_id", "asset_type", "description", "feature_status", "feature_value", "feature_user_value")
    text = feature_text(F.col("feature_status"), F.col("feature_value"), F.col("feature_user_value"))
    out = own.join(columns, "asset_id").where(eligible(F.lit(channel), F.col("description"), text))
    if check_types:
        out = out.where(supports(F.lit(channel), F.col("asset_type")))
    return out.select("asset_id", "embedding_id")


def requested_inputs(records: DataFrame, live_assets: DataFrame, channel: str, wanted: DataFrame) -> DataFrame:
    """Latest indexed embedding of the wanted(asset_id, pos) assets, of any model, in the order asked."""
    own = records.where((F.col("embedding_type") == channel) & (F.col("status") == "indexed"))
    last = latest(own.join(wanted, "asset_id"), "asset_id")
    return last.join(live_assets.select("asset_id"), "asset_id", "left_semi").select("pos", "asset_id", "embedding_id")
