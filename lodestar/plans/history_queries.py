"""Queries over listings, history, runs and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assets, history
from .domain import WORKSPACE, Domain, ctes
from .registry import query
from .search_queries import LIVE_SQL

_SAVED = """saved as (select workspace_id, created_by, saved_search_id, bool_or(is_favorite) as is_favorite, max(created_at) as last_used_at
    from search_runs group by all)"""


@query(
    "asset_page",
    f"{ctes('source_files', 'assets')}, {LIVE_SQL} select asset_id, created_at_ts, count(*) over () as total from live order by created_at_ts desc, asset_id desc limit 20 offset 40",
)
def asset_page(d: Domain) -> DataFrame:
    """A page of live assets and the total."""
    rows = assets.live(d.assets, d.source_files, WORKSPACE)
    got = history.page(rows.select("asset_id", "created_at_ts"), 40, 20, F.desc("created_at_ts"), F.desc("asset_id"))
    return got.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


@query(
    "asset_filter_text",
    f"{ctes('source_files', 'assets')}, {LIVE_SQL} select asset_id from live where asset_name ilike '%1_2%' or description ilike '%1_2%' or relative_path ilike '%1_2%'",
)
def asset_filter_text(d: Domain) -> DataFrame:
    """Free text over names, description and path; wildcards are not escaped."""
    rows = assets.live(d.assets, d.source_files, WORKSPACE)
    return history.search_text(rows, "1_2", "asset_name", "description", "relative_path").select("asset_id")


@query("asset_type_counts", f"{ctes('assets')} select asset_type, count(*) as n, sum(n_chars) as total from assets group by asset_type")
def asset_type_counts(d: Domain) -> DataFrame:
    """Counts and sizes by type."""
    return d.assets.groupBy("asset_type").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"))


@query(
    "delete_counts",
    f"""{ctes('source_files', 'assets', 'embedding_records')} select (select count(*) from assets where workspace_id = 'ws2') as n_assets,
    (select count(*) from embedding_records where doc_id in (select doc_id from assets where workspace_id = 'ws2')) as embeddings,
    (select count(*) from source_files where workspace_id = 'ws2') as sources""",
)
def delete_counts(d: Domain) -> DataFrame:
    """What deleting a workspace takes away."""
    gone = d.assets.where("workspace_id = 'ws2'")
    records = d.embedding_records.join(gone.select("doc_id"), "doc_id", "left_semi")
    one = gone.agg(F.count(F.lit(1)).alias("n_assets")).crossJoin(records.agg(F.count(F.lit(1)).alias("embeddings")))
    return one.crossJoin(d.source_files.where("workspace_id = 'ws2'").agg(F.count(F.lit(1)).alias("sources")))


@query(
    "latest_execution",
    f"{ctes('search_runs')} select saved_search_id, execution_id from (select *, row_number() over (partition by saved_search_id order by created_at desc, execution_id desc) as n from search_runs) where n = 1",
)
def latest_execution(d: Domain) -> DataFrame:
    """The latest run of each saved search."""
    return history.latest_execution(d.search_runs).select("saved_search_id", "execution_id")


@query(
    "history_list",
    f"{ctes('search_runs')}, {_SAVED} select created_by, saved_search_id, is_favorite from saved order by is_favorite desc, last_used_at desc, created_by, saved_search_id limit 100",
)
def history_list(d: Domain) -> DataFrame:
    """Favourites first, then most recently used."""
    return history.listed(history.saved_searches(d.search_runs)).select("created_by", "saved_search_id", "is_favorite")


@query(
    "history_prune",
    f"""{ctes('search_runs')}, {_SAVED.replace("workspace_id, created_by, saved_search_id", "workspace_id, cast(saved_search_id as varchar) as created_by, execution_id as saved_search_id")}
    select created_by, saved_search_id from saved s where is_favorite or saved_search_id in (select saved_search_id from (
        select saved_search_id, row_number() over (partition by created_by order by last_used_at desc, saved_search_id desc) as n from saved where not is_favorite) where n <= 10)""",
)
def history_prune(d: Domain) -> DataFrame:
    """All but the ten most recent non-favourites of a user go."""
    rows = d.search_runs.withColumn("created_by", F.col("saved_search_id")).withColumn("saved_search_id", F.col("execution_id"))
    return history.prune(history.saved_searches(rows)).select("created_by", "saved_search_id")


@query(
    "latest_baseline",
    f"""{ctes('cluster_runs')} select workspace_id, run_id, status from (select *, row_number() over (partition by workspace_id
    order by completed_at desc nulls last, started_at desc nulls last, run_id desc) as n from cluster_runs where status in ('completed', 'insufficient_data')) where n = 1""",
)
def latest_baseline(d: Domain) -> DataFrame:
    """E5: unknown times last."""
    return history.latest_baseline(d.cluster_runs).select("workspace_id", "run_id", "status")


@query("run_list_nulls", f"{ctes('cluster_runs')} select run_id, status from cluster_runs order by started_at desc nulls first, run_id desc limit 50")
def run_list_nulls(d: Domain) -> DataFrame:
    """Runs that have not started come first."""
    return history.run_list(d.cluster_runs, 50).select("run_id", "status")


@query(
    "members_ordered",
    f"""{ctes('cluster_members')} select cluster_id, asset_id, cast(row_number() over (partition by cluster_id order by score desc nulls last, asset_id) as int) as pos from cluster_members""",
)
def members_ordered(d: Domain) -> DataFrame:
    """A cluster's members by score, then id."""
    from pyspark.sql import Window

    w = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("score"), "asset_id")
    return d.cluster_members.select("cluster_id", "asset_id", F.row_number().over(w).alias("pos"))


@query(
    "snapshot_restore",
    f"""{ctes('assets', 'embedding_records')}, snap as (select embedding_id, asset_id from embedding_records where ch = 0 and embedding_id not like '%_old')
    select s.embedding_id, s.asset_id, a.asset_id is not null as available, coalesce(a.asset_name, 'unavailable') as asset_name, a.asset_type
    from snap s left join assets a on s.asset_id = a.asset_id and a.workspace_id = 'ws1'""",
)
def snapshot_restore(d: Domain) -> DataFrame:
    """Rows of assets that are gone stay, masked."""
    snap = d.embedding_records.where("ch = 0 and embedding_id not like '%_old'").select("embedding_id", "asset_id")
    return history.restored(snap, d.assets, WORKSPACE).select("embedding_id", "asset_id", "available", "asset_name", "asset_type")


@query(
    "owner_lookup",
    f"{ctes('search_runs')} select execution_id from search_runs where workspace_id = 'ws1' and created_by = 7",
)
def owner_lookup(d: Domain) -> DataFrame:
    """Only the owner's."""
    return d.search_runs.where("workspace_id = 'ws1' and created_by = 7").select("execution_id")


@query(
    "source_status",
    f"""{ctes('source_files', 'assets')}, {LIVE_SQL} select source_file_id, case when bool_or(status = 'failed') then 'partial_failed' else 'completed' end as status,
    string_agg(case when status = 'failed' then asset_id || ': failed' end, '; ' order by asset_id || ': failed') as message from live group by source_file_id""",
)
def source_status(d: Domain) -> DataFrame:
    """A source's status from its live assets."""
    return history.source_status(assets.live(d.assets, d.source_files, WORKSPACE))


@query(
    "stage_durations",
    """with s as (select user_id % 100 as job, event_type as stage, round(sum(greatest(0, value - 20)), 3) as ms from events group by all)
    select job, stage, ms, round(case when sum(ms) over (partition by job) > 0 then ms / sum(ms) over (partition by job) else 0 end, 9) as share from s""",
)
def stage_durations(d: Domain) -> DataFrame:
    """Time by job and stage, and each stage's share."""
    rows = d.raw("events").select((F.col("user_id") % 100).alias("job"), F.col("event_type").alias("stage"), (F.col("value") - 20).alias("ms"))
    return history.split_duration(history.stage_durations(rows)).withColumn("share", F.round("share", 9))


@query(
    "media_target",
    f"""{ctes('assets')} select asset_id, case when asset_type = 'video_segment' then coalesce(nullif(p, ''), nullif(g, ''), s) else coalesce(nullif(p, ''), s) end as target
    from (select *, case when doc_id % 3 = 0 then 'preview' else '' end as p, case when doc_id % 2 = 1 then 'derived' end as g, source_file_id as s from assets)""",
)
def media_target(d: Domain) -> DataFrame:
    """Preview, derived file or source."""
    preview = F.when(F.col("doc_id") % 3 == 0, "preview").otherwise("")
    derived = F.when(F.col("doc_id") % 2 == 1, "derived")
    return d.assets.select("asset_id", history.media_target(F.col("asset_type"), preview, derived, F.col("source_file_id")).alias("target"))


@query(
    "current_backfill",
    f"""{ctes('vectors', 'clusters', 'cluster_members')} select v.asset_id, v.ch, v.label, k.mode from (select asset_id, ch, label, row_number() over (partition by asset_id, ch
    order by created_at_ts desc, embedding_id) as n from vectors) v join clusters k on k.ch = v.ch and k.label = v.label where n = 1
    and not exists (select 1 from cluster_members m where m.asset_id = v.asset_id and m.ch = v.ch)""",
)
def current_backfill(d: Domain) -> DataFrame:
    """Rows are copied in, unless the key is there already."""
    from pyspark.sql import Window

    w = Window.partitionBy("asset_id", "ch").orderBy(F.desc("created_at_ts"), "embedding_id")
    first = d.vectors.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("asset_id", "ch", "label")
    new = first.join(d.clusters.select("ch", "label", "mode"), ["ch", "label"])
    return new.join(d.cluster_members.select("asset_id", "ch"), ["asset_id", "ch"], "left_anti").select("asset_id", "ch", "label", "mode")


@query(
    "vector_upsert",
    """with old as (select vec_id, label, 1 as version from embeddings), new as (select vec_id, label + 100 as label, 2 as version from embeddings where vec_id % 3 = 0
    union all select vec_id + 1000000, label, 2 from embeddings where vec_id % 50 = 0)
    select vec_id, label, version from (select *, row_number() over (partition by vec_id order by version desc) as n from (select * from old union all select * from new)) where n = 1""",
)
def vector_upsert(d: Domain) -> DataFrame:
    """Union, then the latest version of each key."""
    old = d.raw("embeddings").select("vec_id", "label", F.lit(1).alias("version"))
    new = old.where("vec_id % 3 = 0").selectExpr("vec_id", "label + 100 as label", "2 as version")
    more = old.where("vec_id % 50 = 0").selectExpr("vec_id + 1000000 as vec_id", "label", "2 as version")
    return assets.latest(old.unionByName(new).unionByName(more), "vec_id", order="version", tie="label")


@query("storage_plan", "select lang as extension, count(*) as files, sum(n_chars) as bytes from documents group by lang")
def storage_plan(d: Domain) -> DataFrame:
    """A3: a dry run's counts and bytes by extension."""
    return d.raw("documents").groupBy(F.col("lang").alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"))
