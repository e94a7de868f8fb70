"""Queries over text, paths, identity, video numerics and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluate, text, video
from ..tables import Scratch
from .domain import Domain, ctes
from .registry import query

_MARKED = "'![](data:image/png;base64,AA) ' || text || ' ![alt text](data:image/png;base64,BB) <img src=\"data:image/png;base64,CC\"/>end'"


@query(
    "strip_data_uri",
    f"""select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace({_MARKED}, '!\\[\\]\\(data:image/[^)]*\\)', '', 'g'),
    '!\\[([^\\]]+)\\]\\(data:image/[^)]*\\)', '\\1', 'g'), '(?i)<img[^>]*src=["'']data:image/[^>]*>', '', 'g')) as stripped from documents""",
)
def strip_data_uri(d: Domain) -> DataFrame:
    """Embedded images go, their alternative text stays."""
    marked = F.concat(F.lit("![](data:image/png;base64,AA) "), "text", F.lit(' ![alt text](data:image/png;base64,BB) <img src="data:image/png;base64,CC"/>end'))
    return d.raw("documents").select("doc_id", F.sha2(text.strip_data_uris(marked), 256).alias("stripped"))


@query("content_sha256", "select doc_id, sha256(text) as sha from documents")
def content_sha256(d: Domain) -> DataFrame:
    """A2: content hashes."""
    return d.raw("documents").select("doc_id", F.sha2("text", 256).alias("sha"))


_WORDS = "replace(text, ' ', ';')"


@query(
    "feature_normalize",
    f"""with t as (select doc_id, list_filter(list_transform(string_split({_WORDS}, ';'), lambda x: left(trim(x), 32)), lambda x: x <> '') as l from documents),
    u as (select doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) as l from t) select doc_id, array_to_string(l[1:5], '; ') as terms from u""",
)
def feature_normalize(d: Domain) -> DataFrame:
    """Distinct bounded terms of whole texts."""
    raw = F.replace("text", F.lit(" "), F.lit(";"))
    return d.raw("documents").select("doc_id", text.feature_terms(raw).alias("terms"))


@query("name_bounds", "select doc_id, left(trim(text, ' '), 40) as name, length(left(trim(text, ' '), 500)) as n from documents")
def name_bounds(d: Domain) -> DataFrame:
    """Names and descriptions are trimmed and cut."""
    own = d.raw("documents")
    return own.select("doc_id", text.bounded(F.col("text"), 40).alias("name"), F.length(text.bounded(F.col("text"), 500)).cast("long").alias("n"))


@query(
    "associated_text",
    """with t as (select doc_id, list_filter([left(trim(lang), 2000), left(trim(source), 2000), left(trim(lang), 2000), trim(case when doc_id % 2 = 0 then ' ' end)], lambda x: x is not null and x <> '') as l from documents)
    select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as texts from t""",
)
def associated_text(d: Domain) -> DataFrame:
    """Distinct accompanying texts."""
    parts = text.associated(F.col("lang"), F.col("source"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, " "))
    return d.raw("documents").select("doc_id", F.array_join(parts, "|").alias("texts"))


KEYWORDS = [("screenshot", "screen capture"), ("src1", "work material"), ("de/", "german notes")]


@query(
    "usage_hint",
    """with p as (select doc_id, case when doc_id % 5 = 0 then '/abs' when doc_id % 7 = 0 then 'a/../b' else lang || chr(92) || source || '/x/' || lang || '/f.md' end as raw from documents),
    n as (select doc_id, case when raw like '/%' or raw like '%..%' then null else replace(raw, chr(92), '/') end as path from p)
    select doc_id, path, case when contains(path, 'screenshot') then 'screen capture' when contains(path, 'src1') then 'work material' when contains(path, 'de/') then 'german notes'
    else (select array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], '；') from (select string_split(path, '/') as l)) end as hint from n""",
)
def usage_hint(d: Domain) -> DataFrame:
    """Safe paths and what they hint at."""
    made = F.concat("lang", F.lit("\\"), "source", F.lit("/x/"), "lang", F.lit("/f.md"))
    raw = F.when(F.col("doc_id") % 5 == 0, "/abs").when(F.col("doc_id") % 7 == 0, "a/../b").otherwise(made)
    rows = d.raw("documents").select("doc_id", text.normal_path(raw).alias("path"))
    return rows.select("doc_id", "path", text.usage_hint(F.col("path"), KEYWORDS).alias("hint"))


@query(
    "embedding_text",
    f"""{ctes('assets')} select asset_id, case doc_id % 3 when 0 then nullif(trim(description), '') when 1 then trim(feature_value) || chr(10) || 'a/b' else trim(feature_value) end as body from assets""",
)
def embedding_text(d: Domain) -> DataFrame:
    """What each channel embeds."""
    n = F.col("doc_id") % 3
    channel = F.when(n == 0, "description").when(n == 1, "asset_usage").otherwise("subject")
    return d.assets.select("asset_id", text.embedding_text(channel, F.trim("feature_value"), F.col("description"), F.lit("a/b/secret.md")).alias("body"))


@query(
    "framed_hash",
    """select doc_id, sha256(unhex(lpad(hex(octet_length(encode(lang))), 16, '0')) || encode(lang)
        || unhex(lpad(hex(octet_length(encode(text))), 16, '0')) || encode(text)) as hash from documents""",
)
def framed_hash(d: Domain) -> DataFrame:
    """Length-framed hash of several parts."""
    return d.raw("documents").select("doc_id", text.framed_hash(F.col("lang"), F.col("text")).alias("hash"))


@query(
    "asset_diff",
    """with o as (select doc_id as asset_key, sha256(text) as h, 1 as revision, case when doc_id % 8 = 0 then 'mine' end as user_name from documents where doc_id % 5 <> 0),
    n as (select doc_id as asset_key, sha256(case when doc_id % 4 = 0 then text || '!' else text end) as h from documents where doc_id % 7 <> 0)
    select coalesce(o.asset_key, n.asset_key) as asset_key, case when n.h is null then 'delete' when o.h is null then 'insert' when o.h <> n.h then 'update' else 'keep' end as action,
    case when o.h <> n.h then revision + 1 else coalesce(revision, 1) end as revision, user_name from o full join n on o.asset_key = n.asset_key""",
)
def asset_diff(d: Domain) -> DataFrame:
    """Insert, update, keep, delete by key."""
    docs = d.raw("documents")
    old = docs.where("doc_id % 5 <> 0").select(
        F.col("doc_id").alias("asset_key"), F.sha2("text", 256).alias("content_hash"), F.lit(1).alias("revision"), F.when(F.col("doc_id") % 8 == 0, "mine").alias("user_name")
    )
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("asset_key"), F.sha2(changed, 256).alias("content_hash"))
    return text.asset_diff(old, new)


@query(
    "skip_unchanged",
    """select doc_id as path, sha256(text) as sha from documents where doc_id % 3 = 0 or doc_id % 4 = 0""",
)
def skip_unchanged(d: Domain) -> DataFrame:
    """Files with a known path, content and fingerprint are skipped."""
    files = d.raw("documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha"), F.lit("f1").alias("fingerprint"), "doc_id")
    known = files.where("doc_id % 3 <> 0").withColumn("status", F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("completed")).drop("doc_id")
    return text.unchanged(files, known).select("path", "sha")


_SERIES = "s as (select user_id % 50 as video, ts, event_id, value from events)"


@query(
    "rolling_max",
    f"with {_SERIES} select video, event_id, max(value) over (partition by video order by ts, event_id rows between 2 preceding and 2 following) as high from s",
)
def rolling_max(d: Domain) -> DataFrame:
    """K2: rolling maximum of radius two."""
    return video.rolling_max(_series(d), 2).select("video", "event_id", "high")


@query(
    "frame_change",
    f"with {_SERIES} select video, event_id, round(coalesce(abs(value - lag(value) over (partition by video order by ts, event_id)), 0), 9) as change from s",
)
def frame_change(d: Domain) -> DataFrame:
    """K1: change against the frame before; 0 for the first."""
    return video.frame_change(_series(d)).select("video", "event_id", F.round("change", 9).alias("change"))


@query(
    "adaptive_threshold",
    f"""with {_SERIES}, c as (select video, abs(value - lag(value) over (partition by video order by ts, event_id)) / 1000 as dist from s)
    select video, round(greatest(0.08, least(0.25, quantile_cont(dist, 0.75))), 9) as threshold from c where dist is not null group by video""",
)
def adaptive_threshold(d: Domain) -> DataFrame:
    """K3: the upper quartile of adjacent distances, within bounds."""
    rows = video.frame_change(_series(d), first=None).withColumn("distance", F.col("change") / 1000)
    return video.adaptive_threshold(rows).select("video", F.round("threshold", 9).alias("threshold"))


@query(
    "duration_target",
    """with v as (select user_id % 50 as video, sum(value) / 100 as seconds from events group by 1)
    select video, round(greatest(10, least(20, 10 * (1 + 0.15 * log2(greatest(seconds, 10) / 10)))), 9) as target from v""",
)
def duration_target(d: Domain) -> DataFrame:
    """K8: target length of a segment."""
    rows = d.raw("events").groupBy((F.col("user_id") % 50).alias("video")).agg((F.sum("value") / 100).alias("seconds"))
    return rows.select("video", F.round(video.duration_target(F.col("seconds")), 9).alias("target"))


@query(
    "runs",
    f"""with s as (select user_id % 50 as video, ts, event_id, event_type as label from events), g as (select *, row_number() over (partition by video order by ts, event_id)
    - row_number() over (partition by video, label order by ts, event_id) as island from s)
    select video, label, min(event_id) as first_event, count(*) as length from g group by video, label, island""",
)
def runs(d: Domain) -> DataFrame:
    """K5: maximal runs of equal labels."""
    rows = d.raw("events").select((F.col("user_id") % 50).alias("video"), "ts", "event_id", F.col("event_type").alias("label"))
    return video.runs(rows).select("video", "label", "first_event", "length")


@query(
    "frame_filter",
    """select event_id, case when value < 2 then 'dark' when value > 90 then 'bright' when event_id % 10 = 0 then 'low_contrast' when event_id % 13 = 0 then 'blurry' end as reason from events""",
)
def frame_filter(d: Domain) -> DataFrame:
    """K9: why a frame is left out."""
    e = F.col("event_id")
    contrast, sharp = F.when(e % 10 == 0, 0.0).otherwise(50.0), F.when(e % 13 == 0, 0.0).otherwise(100.0)
    return d.raw("events").select("event_id", video.frame_fault(F.col("value"), contrast, sharp, 2, 90, 10, 20).alias("reason"))


@query(
    "eval_metrics",
    """with q as (select vec_id, label, embedding from embeddings where vec_id % 25 = 0),
    p as (select q.vec_id as qid, q.label as qlabel, e.vec_id, e.label, row_number() over (partition by q.vec_id order by
        list_reduce(list_transform(list_zip(q.embedding, e.embedding), lambda x: cast(x[1] as double) * cast(x[2] as double)), lambda s, v: s + v, 0::double) desc, e.vec_id) as rank
        from q cross join embeddings e),
    r as (select qid, qlabel, count(*) filter (rank <= 5 and label = qlabel) / 5.0 as p5,
        count(*) filter (rank <= 10 and label = qlabel) / greatest(count(*) filter (label = qlabel), 1) as r10 from p group by qid, qlabel)
    select case qlabel % 2 when 0 then 'text' else 'image' end as query_type, count(*) as cases, round(avg(p5), 9) as precision_at_5, round(avg(r10), 9) as recall_at_10,
    avg(p5) >= case qlabel % 2 when 0 then 0.75 else 0.70 end and avg(r10) >= 0.75 as passed from r group by qlabel % 2""",
)
def eval_metrics(d: Domain) -> DataFrame:
    """Precision and recall of exact search, labels as relevance."""
    own = d.raw("embeddings")
    q = own.where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("qlabel"), F.col("embedding").alias("q"))
    with Scratch(d.spark) as scratch:
        top = evaluate.nearest(q, own, 10, scratch).join(own.select("vec_id", "label"), "vec_id")
        hits = top.join(q.drop("q"), "qid").groupBy("qid", "qlabel").agg(*(F.count_if((F.col("rank") <= n) & (F.col("label") == F.col("qlabel"))).alias(f"hits_{n}") for n in (5, 10)))
        relevant = own.groupBy(F.col("label").alias("qlabel")).agg(F.count(F.lit(1)).alias("relevant"))
        cases = hits.join(relevant, "qlabel").withColumn("query_type", F.when(F.col("qlabel") % 2 == 0, "text").otherwise("image"))
        out = scratch.keep(evaluate.evaluate_counts(cases), "evaluation")
    return out.withColumns({c: F.round(c, 9) for c in ("precision_at_5", "recall_at_10")})


_OLD = """select asset_id, doc_id, asset_name, case when doc_id % 5 = 0 then 'user' when doc_id % 5 = 1 then null else 'model' end as asset_name_source,
    case when doc_id % 4 = 0 then null else description end as asset_description, case when doc_id % 3 = 0 then '{{}}' else concat('{{"s":"', feature_status, '"}}') end as asset_features,
    1 as feature_revision, embedding_revision, status as processing_status from {assets}"""
_NEW = """select asset_id, concat('new ', asset_name) as asset_name, case when doc_id % 6 = 0 then concat(description, '!') else description end as asset_description,
    concat('{{"s":"', case when doc_id % 10 = 0 then 'new' else feature_status end, '"}}') as asset_features from {assets} where doc_id % 2 = 0"""


@query(
    "understanding_stored",
    f"""{ctes('assets')}, o as ({_OLD.format(assets='assets')}), n as ({_NEW.format(assets='assets')}),
    m as (select o.*, n.asset_id is not null as told, n.asset_name as nn, n.asset_description as nd, n.asset_features as nf from o left join n using (asset_id)),
    c as (select *, case when told and ((asset_description is not null and asset_description is distinct from nd) or (asset_features <> '{{}}' and asset_features is distinct from nf)) then 1 else 0 end as more from m)
    select asset_id, case when told and asset_name_source is distinct from 'user' then nn else asset_name end as asset_name,
        case when told and asset_name_source is distinct from 'user' then 'model' else asset_name_source end as asset_name_source,
        case when told then nd else asset_description end as asset_description, case when told then nf else asset_features end as asset_features,
        feature_revision + more as feature_revision, embedding_revision + more as embedding_revision, case when told then 'processing' else processing_status end as processing_status from c""",
)
def understanding_stored(d: Domain) -> DataFrame:
    """What a model understood, and the revisions that a change of meaning moves on."""
    old, new = (d.spark.sql(sql, assets=d.assets) for sql in (_OLD, _NEW))
    return text.store_understanding(old.drop("doc_id"), new)


@query(
    "kept_frames",
    f"""with recursive {_SERIES}, f as (select video, event_id, row_number() over (partition by video order by ts, event_id) as n, cast(floor(value) as int) as a,
        cast(floor(2 * value) as int) as b, case when value < 2 then 'dark' end as fault from s),
    k(video, n, event_id, a, b, reason) as (
        select distinct video, cast(0 as bigint), cast(null as bigint), cast(null as int), cast(null as int), cast(null as varchar) from f
        union all
        select video, n, event_id, case when why is null then na else a end, case when why is null then nb else b end, why
        from (select f.video, f.n, f.event_id, k.a, k.b, f.a as na, f.b as nb,
            coalesce(f.fault, case when (abs(f.a - k.a) + abs(f.b - k.b)) / 2.0e0 / 255 <= 0.02 then 'near_duplicate' end) as why
            from k join f on f.video = k.video and f.n = k.n + 1))
    select video, event_id as frame_id, reason from k where n > 0""",
)
def kept_frames(d: Domain) -> DataFrame:
    """K9: frames with a fault, and those near to the last one kept."""
    light = F.array(F.floor("value").cast("int"), F.floor(2 * F.col("value")).cast("int"))
    rows = _series(d).select("video", F.col("ts").alias("at"), F.col("event_id").alias("frame_id"), light.alias("thumbnail"), F.when(F.col("value") < 2, "dark").alias("fault"))
    return video.kept_frames(rows, 0.02)


def _series(d: Domain) -> DataFrame:
    return d.raw("events").select((F.col("user_id") % 50).alias("video"), "ts", "event_id", "value")
