"""Saved searches, runs, listings and counts: the ordered, paged and latest-per-key queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP_SEARCHES = 10
LIST_LIMIT = 100


def latest_execution(runs: DataFrame) -> DataFrame:
    """The latest run of each saved search; of equal times the larger id."""
    w = Window.partitionBy("saved_search_id").orderBy(F.desc("created_at"), F.desc("execution_id"))
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def saved_searches(runs: DataFrame) -> DataFrame:
    """One row per (workspace, user, saved search): favourite if any run is, last used at its latest run."""
    return runs.groupBy("workspace_id", "created_by", "saved_search_id").agg(
        F.bool_or("is_favorite").alias("is_favorite"), F.max("created_at").alias("last_used_at")
    )


def prune(searches: DataFrame, keep: int = KEEP_SEARCHES) -> DataFrame:
    """searches without the non-favourites beyond the `keep` most recent of a user."""
    w = Window.partitionBy("workspace_id", "created_by").orderBy(F.desc("last_used_at"), F.desc("saved_search_id"))
    old = searches.where(~F.col("is_favorite")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") > keep)
    return searches.join(old.select("workspace_id", "created_by", "saved_search_id"), ["workspace_id", "created_by", "saved_search_id"], "left_anti")


def listed(searches: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Favourites first, then the most recent."""
    return searches.orderBy(F.desc("is_favorite"), F.desc("last_used_at"), "created_by", "saved_search_id").limit(limit)


def page(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def search_text(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Case-insensitive LIKE %text% in any of the columns; % and _ in the text are wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return rows.where(hit)


def latest_baseline(runs: DataFrame) -> DataFrame:
    """The latest completed or insufficient run of each workspace; unknown times come last."""
    w = Window.partitionBy("workspace_id").orderBy(F.desc_nulls_last("completed_at"), F.desc_nulls_last("started_at"), F.desc("run_id"))
    done = runs.where(F.col("status").isin("completed", "insufficient_data"))
    return done.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def run_list(runs: DataFrame, limit: int) -> DataFrame:
    """Most recently started first; runs that have not started come before all."""
    return runs.orderBy(F.desc_nulls_first("started_at"), F.desc("run_id")).limit(limit)


def job_list(jobs: DataFrame, limit: int) -> DataFrame:
    """Most recently made first, then the larger id; the limit is held to 1 to 200."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(max(1, min(200, limit)))


def busy(jobs: DataFrame, workspace: str, active: tuple[str, ...] = ("pending", "running")) -> int:
    """How many jobs of a workspace are under way: nothing of it is deleted while there are any."""
    return jobs.where((F.col("workspace_id") == workspace) & F.col("status").isin(*active)).count()


def active_counts(jobs: DataFrame, active: tuple[str, ...] = ("pending", "running")) -> DataFrame:
    """(workspace_id, n): the jobs under way of all workspaces that have any."""
    return jobs.where(F.col("status").isin(*active)).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"))


def save(searches: DataFrame, saved: DataFrame, keep: int = KEEP_SEARCHES) -> DataFrame:
    """searches after saving saved(workspace_id, created_by, saved_search_id, last_used_at): new ones are no favourites.

    A search that is there already is refreshed: its time moves on, never back, and a favourite stays one. Then a user's
    oldest beyond `keep` go, but favourites.
    """
    keys = ["workspace_id", "created_by", "saved_search_id"]
    both = searches.select(*keys, "is_favorite", "last_used_at").unionByName(saved.select(*keys, F.lit(False).alias("is_favorite"), "last_used_at"))
    return prune(both.groupBy(*keys).agg(F.bool_or("is_favorite").alias("is_favorite"), F.max("last_used_at").alias("last_used_at")), keep)


def set_favorite(searches: DataFrame, workspace: str, user: int | str, ids: list[str], favorite: bool) -> DataFrame:
    """searches with the user's own among `ids` made favourites, or not; others' are left alone."""
    own = (F.col("workspace_id") == workspace) & (F.col("created_by") == user) & F.col("saved_search_id").isin(*ids)
    return searches.withColumn("is_favorite", F.when(own, F.lit(favorite)).otherwise(F.col("is_favorite")))


def delete_searches(searches: DataFrame, workspace: str, user: int | str, ids: list[str]) -> DataFrame:
    """searches without the user's own among `ids`."""
    own = (F.col("workspace_id") == workspace) & (F.col("created_by") == user) & F.col("saved_search_id").isin(*ids)
    return searches.where(~own)


def restored(snapshots: DataFrame, assets: DataFrame, workspace: str) -> DataFrame:
    """Snapshot rows with their assets; details are masked where the asset is gone.

    The workspace is part of the join condition, so that a row never goes because its asset is elsewhere.
    """
    own = assets.select(F.col("asset_id").alias("_asset"), F.col("workspace_id").alias("_workspace"), "asset_name", "asset_type")
    met = snapshots.join(own, (F.col("asset_id") == F.col("_asset")) & (F.col("_workspace") == workspace), "left")
    gone = F.col("_asset").isNull()
    return met.withColumn("available", ~gone).withColumn("asset_name", F.when(gone, "unavailable").otherwise(F.col("asset_name"))).drop("_asset", "_workspace")


def delete_workspace(tables: dict[str, DataFrame], workspace: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The tables without a workspace's rows, and how many rows went from each; a ValueError while jobs are under way."""
    if "jobs" in tables and (n := busy(tables["jobs"], workspace)):
        raise ValueError(f"{n} jobs of the workspace are under way")
    counts = {n: t.where(F.col("workspace_id") == workspace).count() for n, t in tables.items()}
    return {n: t.where(F.col("workspace_id") != workspace) for n, t in tables.items()}, counts


def source_status(assets: DataFrame) -> DataFrame:
    """Per source: partial_failed if a live asset failed, and what failed, joined by '; '."""
    failed = F.col("status") == "failed"
    names = F.array_join(F.array_sort(F.collect_list(F.when(failed, F.concat("asset_id", F.lit(": failed"))))), "; ")
    out = assets.groupBy("source_file_id").agg(F.bool_or(failed).alias("any"), names.alias("message"))
    return out.select("source_file_id", F.when(F.col("any"), "partial_failed").otherwise("completed").alias("status"), F.nullif("message", F.lit("")).alias("message"))


def stage_durations(events: DataFrame) -> DataFrame:
    """(job, stage, ms): durations added up, negative ones as 0, to three decimals."""
    return events.groupBy("job", "stage").agg(F.round(F.sum(F.greatest(F.lit(0.0), F.col("ms"))), 3).alias("ms"))


def split_duration(stages: DataFrame) -> DataFrame:
    """Each stage's share of its job's time."""
    total = F.sum("ms").over(Window.partitionBy("job"))
    return stages.withColumn("share", F.when(total > 0, F.col("ms") / total).otherwise(0.0))


def media_target(kind: Column, preview: Column, derived: Column, source: Column) -> Column:
    """Where to show an asset from: its preview, for segments the derived file, else the source."""
    first = F.nullif(preview, F.lit(""))
    return F.when(kind == "video_segment", F.coalesce(first, F.nullif(derived, F.lit("")), source)).otherwise(F.coalesce(first, source))
