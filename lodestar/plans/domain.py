"""Domain tables derived from the driver's tables.

Each table is one SELECT in the dialect that Spark and DuckDB share; the few functions that differ are filled in. Spark
runs it over DataFrames, the oracle as common table expressions, so that both sides start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The four channels of the derived embeddings.
CHANNELS = ("native", "description", "subject", "visual_style")
#: Weights of the query's channels.
WEIGHTS = (0.4, 0.3, 0.2, 0.1)
WORKSPACE = "ws1"
MODEL = "model-a"

_CASE_CHANNEL = "case ch when 0 then 'native' when 1 then 'description' when 2 then 'subject' else 'visual_style' end"

TABLES = {
    "source_files": """
        select concat('src_', lang, '_', source) as source_file_id, 'ws1' as workspace_id, concat(lang, '/', source, '.md') as relative_path,
            'md' as extension, 1 as processing_generation, cast(sum(n_chars) as bigint) as file_size, cast(count(*) as bigint) as n_documents
        from documents group by lang, source""",
    "assets": """
        select d.doc_id, concat('asset_', cast(d.doc_id as {string})) as asset_id, concat('src_', d.lang, '_', d.source) as source_file_id,
            case when d.doc_id % 23 = 0 then 'ws2' else 'ws1' end as workspace_id,
            case d.doc_id % 4 when 0 then 'markdown_block' when 1 then 'text_block' when 2 then 'image' else 'video_segment' end as asset_type,
            case when d.doc_id % 17 = 0 then 0 else 1 end as generation,
            case when d.doc_id % 13 = 0 then 'parent' else 'child' end as index_role,
            1 as embedding_revision, concat('File ', cast(d.doc_id as {string})) as asset_name,
            case when d.doc_id % 6 = 0 then '  ' else concat('about ', d.lang, ' ', d.source) end as description,
            case when l.quality is null then 'unknown' else 'confirmed' end as feature_status,
            case when l.quality is null then 'stale' when l.quality = 1 then ' good ' else '' end as feature_value,
            case when l.toxic = 1 then 'flagged' end as feature_user_value,
            cast(d.doc_id % 10 as int) as block_index, d.doc_id % 3 as parent_no,
            cast(d.doc_id % 10 * 5000 as bigint) as start_ms, cast(d.doc_id % 10 * 5000 + 4000 as bigint) as end_ms,
            cast(1700000000 + d.doc_id * 60 as bigint) as created_at_ts, d.n_chars, {sha}(d.text) as content_hash,
            case d.doc_id % 9 when 0 then 'failed' else 'completed' end as status
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "embedding_records": """
        select concat('emb_', cast(ch as {string}), '_', cast(doc_id as {string}), suffix) as embedding_id,
            concat('asset_', cast(doc_id as {string})) as asset_id, doc_id, ch, {channel} as embedding_type, 'model-a' as model_name,
            case when (doc_id + ch) % 11 = 0 then 'failed' else 'indexed' end as status,
            case when doc_id % 19 = 0 then 2 else 1 end as embedding_revision,
            cast(1700000000 + doc_id * 60 + ch - age as bigint) as created_at_ts
        from (select d.doc_id, c.ch, a.suffix, a.age
            from documents d cross join (values (0), (1), (2), (3)) as c(ch)
            cross join (values ('', 0), ('_old', 3600)) as a(suffix, age)
            where a.age = 0 or d.doc_id % 5 = 0) as every""",
    "vectors": """
        select r.embedding_id, r.asset_id, r.doc_id, r.ch, r.embedding_type, r.embedding_revision, r.created_at_ts, e.embedding, e.label,
            a.asset_type, a.workspace_id, a.source_file_id
        from embedding_records r join assets a on r.doc_id = a.doc_id
        join embeddings e on e.vec_id = (r.doc_id * 7 + r.ch * 131) % {count}
        where r.status = 'indexed' and r.embedding_id not like '%_old'""",
    "clusters": """
        select concat(cast(ch as {string}), '_', cast(label as {string})) as cluster_id, 'ws1' as workspace_id, ch, min(embedding_type) as embedding_type,
            case label % 3 when 0 then 'dynamic' when 1 then 'resident_open' else 'resident_manual' end as mode,
            min(doc_id) as representative_doc_id, label, case when label % 4 = 0 then '' else concat('user ', cast(label as {string})) end as user_name,
            concat('model ', cast(label as {string})) as model_name
        from vectors group by ch, label""",
    "cluster_members": """
        select v.asset_id, v.doc_id, v.ch, concat(cast(v.ch as {string}), '_', cast(v.label as {string})) as cluster_id,
            case when v.doc_id % 7 = 0 then null else (v.doc_id % 100) / 100.0e0 end as score,
            case v.doc_id % 3 when 0 then 'algorithm' else 'user' end as member_source
        from vectors v where v.doc_id % 2 = 0""",
    "favorites": """
        select 'ws1' as workspace_id, concat('u', cast(doc_id % 3 as {string})) as user_id, concat('asset_', cast(doc_id as {string})) as asset_id, doc_id
        from documents where doc_id % 5 = 1""",
    "queries": """
        select e.ch as query_no, e.ch, {channel} as embedding_type, v.embedding as query,
            case e.ch when 0 then 0.4e0 when 1 then 0.3e0 when 2 then 0.2e0 else 0.1e0 end as weight
        from (select label as ch, min(vec_id) as vec_id from embeddings where label between 0 and 3 group by label) as e
        join embeddings v on v.vec_id = e.vec_id""",
    "search_runs": """
        select event_id as execution_id, concat('cap_', cast(user_id % 200 as {string})) as saved_search_id, user_id as created_by, 'ws1' as workspace_id,
            ts as created_at, event_type = 'purchase' as is_favorite, value, event_type
        from events""",
    "cluster_runs": """
        select o_orderkey as run_id, case o_orderpriority when '1-URGENT' then 'completed' when '2-HIGH' then 'insufficient_data'
            when '3-MEDIUM' then 'pending' else 'failed' end as status, concat('ws', cast(o_custkey % 50 as {string})) as workspace_id,
            case when o_orderkey % 7 = 0 then null else o_orderdate end as started_at,
            case when o_orderkey % 5 = 0 then null else o_orderdate end as completed_at
        from orders""",
}

_DUCK = {"string": "varchar", "sha": "sha256", "channel": _CASE_CHANNEL, "count": "(select count(*) from embeddings)"}


def _fill(sql: str, count: str, string: str, sha: str) -> str:
    return sql.replace("{string}", string).replace("{sha}", sha).replace("{channel}", _CASE_CHANNEL).replace("{count}", count)


_NEEDS = {
    "vectors": ("assets", "embedding_records"),
    "clusters": ("vectors",),
    "cluster_members": ("vectors",),
}


def ctes(*names: str) -> str:
    """'with ...' for the oracle, with the named domain tables and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({_fill(TABLES[n], _DUCK['count'], 'varchar', 'sha256')})" for n in order]
    return "with " + ",\n".join(parts)


class Domain:
    """The domain tables over one folder of driver tables, as DataFrames; made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._made:
            # Row counts are parquet metadata: the modulus costs no scan.
            count = str(self.raw("embeddings").count()) if "{count}" in TABLES[name] else ""
            sql = _fill(TABLES[name], count, "string", "{{sha}}").replace("{{sha}}(d.text)", "sha2(d.text, 256)")
            used = {}
            for table in ("documents", "labels", "embeddings", "events", "orders", "assets", "embedding_records", "vectors"):
                if f"from {table}" in sql or f"join {table}" in sql:
                    used[table] = getattr(self, table) if table in TABLES else self.raw(table)
            for table in used:
                for word in ("from", "join"):
                    sql = sql.replace(f"{word} {table} ", f"{word} {{{table}}} ").replace(f"{word} {table}\n", f"{word} {{{table}}}\n")
                    if sql.endswith(f"{word} {table}"):
                        sql = sql[: -len(table)] + f"{{{table}}}"
            self._made[name] = self.spark.sql(sql, **used)
        return self._made[name]
