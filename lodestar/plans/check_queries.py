"""Queries over requests, whole searches, constraint checks and small predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assets, assign, checks, history, request, search, vector
from ..operators import text as text_
from ..tables import Scratch
from .domain import CHANNELS, WORKSPACE, Domain, ctes
from .pipeline_queries import FOLD_SQL, RANKED_SQL
from .registry import query
from .search_queries import ASSIGN, FULL, _cos


_THREE = "(select ch, embedding_type, query, case ch when 0 then 3 when 1 then 2 else 1 end / 6.0e0 as weight from queries where ch < 3) q"
_FULL = FULL.replace("with ", "with recursive ", 1).replace("join queries q", f"join {_THREE}")
_CHOSEN = "(select * from valid where asset_id not in (select asset_id from favorites where user_id = 'u1' and workspace_id = 'ws1')) v"


@query(
    "search_end_to_end",
    f"""{_FULL}, {RANKED_SQL.replace("valid v", _CHOSEN)}, {FOLD_SQL},
    best as (select asset_id, list(embedding_type order by -contribution, rank, embedding_type) as channels from met where kept = 1 group by asset_id)
    select f.position, f.asset_id, f.folded, round(v.score, 9) as score, 'matched by ' || array_to_string(channels[1:3], ', ') as reason,
        case when list_contains(channels, 'subject') and l.feature_status <> 'unknown' then coalesce(nullif(trim(feature_user_value), ''), nullif(trim(feature_value), '')) end
        as matched_feature
    from folded f join valid v using (asset_id) join best b using (asset_id) join live l using (asset_id)""",
)
def search_end_to_end(d: Domain) -> DataFrame:
    """A request from its plan to folded results."""
    own = request.Request(WORKSPACE, "text", "query", channels=("native", "description", "subject"), user="u1", filters=request.Filters(favorite=False))
    vectors = {r["embedding_type"]: list(r["query"]) for r in d.queries.collect()}  # four query vectors
    made = iter(own.channels)
    queries, _ = request.embed(request.plan(own, lambda r: ({c: c for c in r.channels}, {"native": 3, "description": 2, "subject": 1})), lambda s, q: vectors[next(made)])
    queries, found, _ = request.open_channels(queries, lambda channel: d.vectors)
    t = request.Tables(found, d.assets, d.source_files, d.embedding_records, d.favorites, d.cluster_members, d.clusters)
    text = assets.feature_text(F.col("feature_status"), F.col("feature_value"), F.col("feature_user_value"))
    features = d.assets.select("asset_id", F.lit("subject").alias("embedding_type"), text.alias("text"))
    results, _ = request.run(d.spark, own, queries, t, features=features)
    return results.withColumn("folded", F.array_join("folded", ",")).withColumn("score", F.round("score", 9))


_LEFT = "(select ch, embedding_type, query, case ch when 0 then 4 when 1 then 3 else 2 end / 9.0e0 as weight from queries where ch < 3) q"


@query(
    "search_channel_lost",
    f"""{FULL.replace("with ", "with recursive ", 1).replace("join queries q", f"join {_LEFT}")}, {RANKED_SQL}, {FOLD_SQL}
    select f.position, f.asset_id, f.folded, round(v.score, 9) as score, 'visual_style' as lost from folded f join valid v using (asset_id)""",
)
def search_channel_lost(d: Domain) -> DataFrame:
    """four channels, of which one has files that cannot be read: the results of the other three, and why."""
    own = request.Request(WORKSPACE, "text", "query", channels=CHANNELS)
    vectors = {r["embedding_type"]: list(r["query"]) for r in d.queries.collect()}  # four query vectors
    weights = dict(zip(CHANNELS, (4, 3, 2, 1), strict=True))
    made = iter(own.channels)
    queries, _ = request.embed(request.plan(own, lambda r: (dict(zip(CHANNELS, CHANNELS, strict=True)), weights)), lambda s, q: vectors[next(made)])
    t = request.Tables(d.vectors, d.assets, d.source_files, d.embedding_records, d.favorites, d.cluster_members, d.clusters)
    with Scratch(d.spark) as scratch:
        broken = scratch.path("broken_channel")
        d.vectors.where("ch = 3").select("embedding_id").write.text(broken)  # no Parquet: opens, and fails when read
        opened = {"visual_style": d.spark.read.schema(d.vectors.schema).parquet(broken)}
        results, _, reasons = request.search_isolated(d.spark, own, queries, lambda channel: opened.get(channel, d.vectors), t)
    lost = ",".join(r.split()[1] for r in reasons)
    return results.select("position", "asset_id", F.array_join("folded", ",").alias("folded"), F.round("score", 9).alias("score"), F.lit(lost).alias("lost"))


@query(
    "vector_lookup",
    f"{ctes('vectors')} select embedding_id, asset_id from vectors where doc_id % 6 = 0 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0",
)
def vector_lookup(d: Domain) -> DataFrame:
    """Vectors by a list of ids, some unknown, some given twice; invalid ones are left out."""
    ids = d.embedding_records.where("doc_id % 6 = 0").select("embedding_id")
    return vector.lookup(d.vectors, ids.union(ids), 64).select("embedding_id", "asset_id")


@query(
    "indexed_by_model",
    f"{ctes('embedding_records')} select embedding_id from (select *, case when doc_id % 3 = 0 then 'model-b' else model_name end as m from embedding_records) where status = 'indexed' and m = 'model-b'",
)
def indexed_by_model(d: Domain) -> DataFrame:
    """Indexed embeddings of one model."""
    records = d.embedding_records.withColumn("model_name", F.when(F.col("doc_id") % 3 == 0, "model-b").otherwise(F.col("model_name")))
    return search.indexed(records, ("model-b",)).select("embedding_id")


_JOBS = "select o_orderkey as job_id, o_orderdate as created_at, concat('ws', cast(o_custkey % 50 as {})) as workspace_id, case o_orderstatus when 'O' then 'pending' when 'P' then 'running' else 'done' end as status from orders"


def _jobs(d: Domain) -> DataFrame:
    return d.spark.sql(_JOBS.format("string").replace("from orders", "from {orders}"), orders=d.raw("orders"))


@query("job_list", f"select job_id, created_at, status from ({_JOBS.format('varchar')}) order by created_at desc, job_id desc limit 200")
def job_list(d: Domain) -> DataFrame:
    """The latest jobs; a larger limit counts as 200."""
    return history.job_list(_jobs(d), 1000).select("job_id", "created_at", "status")


@query(
    "workspace_busy",
    f"select workspace_id, count(*) as n from ({_JOBS.format('varchar')}) where status in ('pending', 'running') group by workspace_id",
)
def workspace_busy(d: Domain) -> DataFrame:
    """Jobs under way, which keep a workspace from being deleted, of all workspaces."""
    return history.active_counts(_jobs(d))


@query(
    "saved_search_commands",
    f"""{ctes('search_runs')}, s as (select workspace_id, created_by, saved_search_id, bool_or(is_favorite) as f, max(created_at) as t from search_runs where execution_id % 2 = 0 group by all),
    n as (select workspace_id, created_by, saved_search_id, false as f, max(created_at) as t from search_runs where execution_id % 2 = 1 group by all),
    b as (select workspace_id, created_by, saved_search_id, bool_or(f) as f, max(t) as t from (from s union all from n) group by all),
    p as (select *, row_number() over (partition by workspace_id, created_by, f order by t desc, saved_search_id desc) as k from b),
    q as (select * from p where f or k <= 10)
    select created_by, saved_search_id, case when created_by = 7 and saved_search_id in ('cap_7', 'cap_8') then true else f end as is_favorite, t as last_used_at
    from q where not (created_by = 9 and saved_search_id in ('cap_9', 'cap_7'))""",
)
def saved_search_commands(d: Domain) -> DataFrame:
    """save and refresh, favourite, delete."""
    runs = d.search_runs
    fresh = runs.where("execution_id % 2 = 1").groupBy("workspace_id", "created_by", "saved_search_id").agg(F.max("created_at").alias("last_used_at"))
    rows = history.save(history.saved_searches(runs.where("execution_id % 2 = 0")), fresh)
    rows = history.set_favorite(rows, WORKSPACE, 7, ["cap_7", "cap_8"], True)
    return history.delete_searches(rows, WORKSPACE, 9, ["cap_9", "cap_7"]).select("created_by", "saved_search_id", "is_favorite", "last_used_at")


@query(
    "detach_members",
    f"""{ctes('vectors', 'clusters', 'cluster_members')}, m as (select asset_id, cluster_id, member_source from cluster_members where ch = 0),
    g as (select * from m where cast(replace(asset_id, 'asset_', '') as bigint) % 10 = 0), k as (select * from m where cast(replace(asset_id, 'asset_', '') as bigint) % 10 <> 0),
    reps as (select c.cluster_id, c.mode, v.embedding as rep from clusters c join vectors v on v.ch = 0 and v.doc_id = c.representative_doc_id where c.ch = 0 and c.mode <> 'resident_manual'),
    pairs as (select v.asset_id, r.cluster_id, r.mode, {_cos('v.embedding', 'r.rep')} as score from vectors v join g using (asset_id) cross join reps r where v.ch = 0 and r.cluster_id <> g.cluster_id),
    a as (select asset_id, cluster_id from (select *, row_number() over (partition by asset_id order by case mode when 'resident_open' then 0 else 1 end, score desc, cluster_id desc) as n
        from pairs where score >= {ASSIGN}) where n = 1)
    select asset_id, cluster_id, member_source from k union all select asset_id, cluster_id, 'algorithm' from a""",
)
def detach_members(d: Domain) -> DataFrame:
    """Members leave a cluster for good and go to the best other one."""
    own = d.vectors.where("ch = 0")
    members = d.cluster_members.where("ch = 0").select("asset_id", "cluster_id", "member_source")
    gone = d.cluster_members.where("ch = 0 and doc_id % 10 = 0").select("asset_id", "cluster_id")
    reps = d.clusters.where("ch = 0").join(own.select("doc_id", F.col("embedding").alias("rep")), F.expr("representative_doc_id = doc_id"))
    none = d.spark.createDataFrame([], "cluster_id string, asset_id string")
    kept, _ = assign.detach_and_reassign(members, gone, none, own.select("asset_id", "embedding"), reps.select("cluster_id", "mode", "rep"), ASSIGN)
    return kept


@query(
    "canonical_keys",
    """select doc_id, sha256('{"kind":"text","lang":' || case when doc_id % 5 = 0 then 'null' else '"' || lang || '"' end || ',"no":' || cast(doc_id as varchar) || '}') as key from documents""",
)
def canonical_keys(d: Domain) -> DataFrame:
    """Keys by canonical JSON."""
    lang = F.when(F.col("doc_id") % 5 != 0, F.col("lang"))
    return d.raw("documents").select("doc_id", F.sha2(text_.canonical_json(no=F.col("doc_id"), lang=lang, kind=F.lit("text")), 256).alias("key"))


@query(
    "hit_defaults",
    """select case when vec_id % 5 = 0 then concat('id', vec_id) else concat('e', vec_id) end as embedding_id, concat('a', vec_id) as asset_id,
    cast(case when label = 0 then 1 else label end as int) as embedding_revision, case when vec_id % 2 = 0 then 0.5 when vec_id % 3 = 0 then 0.25 else 0.0 end as similarity
    from embeddings where vec_id % 7 <> 0""",
)
def hit_defaults(d: Domain) -> DataFrame:
    """Defaults of raw hits."""
    v = F.col("vec_id")
    text = v.cast("string")
    entity = F.struct(
        F.when(v % 5 == 0, "").otherwise(F.concat(F.lit("e"), text)).alias("embedding_id"),
        F.when(v % 7 == 0, "").otherwise(F.concat(F.lit("a"), text)).alias("asset_id"),
        F.col("label").alias("embedding_revision"),
    )
    hits = d.raw("embeddings").select(
        F.concat(F.lit("id"), text).alias("id"), entity.alias("entity"), F.when(v % 2 == 0, 0.5).otherwise(0.0).alias("distance"), F.when(v % 3 == 0, 0.25).alias("score")
    )
    return checks.hit_projection(hits)


@query(
    "compact_file_info",
    "select doc_id, case when doc_id % 2 = 0 then 2 else 1 end as n, cast(n_chars as varchar) as width from documents",
)
def compact_file_info(d: Domain) -> DataFrame:
    """Only the facts that are shown."""
    info = F.create_map(F.lit("width"), F.col("n_chars").cast("string"), F.lit("format"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.lit("secret"), F.col("source"))
    rows = d.raw("documents").select("doc_id", checks.compact_file_info(info).alias("m"))
    return rows.select("doc_id", F.size("m").alias("n"), F.col("m")["width"].alias("width"))


@query(
    "json_text",
    "select event_id, case when event_id % 2 = 0 then event_type else props end as body from events",
)
def json_text(d: Domain) -> DataFrame:
    """JSON strings are unwrapped, other JSON stays."""
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.col("props"))
    return d.raw("events").select("event_id", checks.json_text(raw).alias("body"))


@query(
    "ocr_accept",
    """with l as (select conv_id as image, turn as no, trim(text, ' ') as t, (conv_id % 10) / 10.0e0 as score from conversations where trim(text, ' ') <> ''),
    g as (select image, string_agg(t, chr(10) order by no) as text, avg(score) as m, count(*) as n from l group by image)
    select i.image, case when m >= 0.55 and length(text) >= 2 then text end as text, case when m is null then 'empty' when m >= 0.55 and length(text) >= 2 then 'accepted' else 'filtered' end as status,
    round(m, 6) as confidence, coalesce(n, 0) as line_count from (select distinct conv_id as image from conversations) i left join g on g.image = i.image""",
)
def ocr_accept(d: Domain) -> DataFrame:
    """Recognised text is accepted by confidence and length."""
    lines = d.raw("conversations").select(
        F.col("conv_id").alias("image"), F.col("turn").alias("no"), F.col("text"), ((F.col("conv_id") % 10) / 10.0).alias("score")
    )
    return checks.ocr_lines(lines)


@query("storage_uris", "select distinct concat('s3://bucket/', lang, '/', source) as uri from documents union select distinct concat('file://', lang) from documents where doc_id % 2 = 0")
def storage_uris(d: Domain) -> DataFrame:
    """Explicit storage URIs in nested metadata."""
    nested = F.to_json(
        F.struct(
            F.struct(F.array(F.concat(F.lit("s3://bucket/"), "lang", F.lit("/"), "source")).alias("list"), F.lit("see s3://not/this").alias("note")).alias("a"),
            F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("file://"), "lang")).alias("b"),
        )
    )
    return checks.storage_uris(d.raw("documents").select(nested.alias("meta")), "meta")


@query(
    "representative_faults",
    """with r as (select concat('c', user_id % 40) as cluster_id, event_id as asset_id, row_number() over (partition by user_id % 40 order by event_id) - 1 as rank, event_id % 3 as src from events),
    k as (select * from r where rank < 6 and not (cluster_id = 'c1' and rank = 2)), m as (select *, case when rank = 0 and cluster_id <> 'c2' then 'medoid' else 'core' end as role from k),
    crowd as (select distinct cluster_id from (select cluster_id, src from m group by cluster_id, src having count(*) > 2))
    select cluster_id, 'ranks have gaps' as fault from m group by cluster_id having max(rank) <> count(*) - 1 or min(rank) <> 0
    union all select cluster_id, 'not one medoid at rank 0' from m group by cluster_id having count(*) filter (role = 'medoid') <> 1
    union all select cluster_id, 'too many of a source' from crowd""",
)
def representative_faults(d: Domain) -> DataFrame:
    """What is wrong with representatives."""
    from pyspark.sql import Window

    own = d.raw("events").select(F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("cluster_id"), F.col("event_id").alias("asset_id"))
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("asset_id")) - 1)
    own = own.where("rank < 6 and not (cluster_id = 'c1' and rank = 2)")
    own = own.withColumn("role", F.when((F.col("rank") == 0) & (F.col("cluster_id") != "c2"), "medoid").otherwise("core"))
    sources = d.raw("events").select(F.col("event_id").alias("asset_id"), (F.col("event_id") % 3).alias("source_file_id"))
    return checks.representative_faults(own, sources)


@query(
    "path_terms",
    """with t as (select distinct part from (select unnest(string_split(text, ' ')) as part from documents) where part is not null)
    select part, trim(part, ' ') <> '' and lower(trim(part, ' ')) not in ('the', 'and') and not regexp_matches(trim(part, ' '), '[0-9]') and not ends_with(trim(part, ' '), 'ing')
    and not regexp_matches(trim(part, ' '), '^[0-9a-fA-F]{8,}$') and regexp_matches(trim(part, ' '), '^[A-Za-z][A-Za-z _-]{2,30}$') as semantic from t""",
)
def path_terms(d: Domain) -> DataFrame:
    """Names that tell what is inside, over whole texts."""
    parts = d.raw("documents").select(F.explode(F.split("text", " ")).alias("part")).distinct()
    generic = F.lower(F.trim("part")).isin("the", "and")
    return parts.select("part", checks.semantic_term(F.col("part"), generic, ("ing",)).alias("semantic"))


@query("abbreviated", "select doc_id, case when length(text) <= 41 then text else left(text, 20) || '…' || right(text, 20) end as short from documents")
def abbreviated(d: Domain) -> DataFrame:
    """2.11: the middle is left out."""
    return d.raw("documents").select("doc_id", checks.abbreviate(F.col("text"), 41).alias("short"))
