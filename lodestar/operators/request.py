"""Search requests, their plans, and the whole search as one lazy chain with injectable model seams."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import assets, fold, search
from .assets import VISUAL_CHANNELS, VISUAL_TYPES

QUERY_TYPES = ("text", "image", "image_text")
#: Fixed value: what stands for the text of a query that is an image only.
IMAGE_PLACEHOLDER = "参考图片"


@dataclass
class Filters:
    asset_types: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    created_from: datetime | None = None
    created_to: datetime | None = None
    favorite: bool | None = None
    cluster_id: str | None = None

    def __post_init__(self):
        if self.created_from and self.created_to and self.created_from > self.created_to:
            raise ValueError("created_from is after created_to")

    def seconds(self) -> list[int | None]:
        return [None if x is None else math.floor(x.timestamp()) for x in (self.created_from, self.created_to)]


@dataclass
class Request:
    """A validated search request; wrong ones raise ValueError."""

    workspace_id: str
    query_type: str
    query_text: str | None = None
    image_url: str | None = None
    image_upload: str | None = None
    channels: tuple[str, ...] = ("native",)
    user: str = "user"
    fusion: str = "rrf"
    top_k: int = 20
    filters: Filters = field(default_factory=Filters)

    def __post_init__(self):
        self.query_text, self.image_url, self.image_upload = ((s or "").strip() or None for s in (self.query_text, self.image_url, self.image_upload))
        image = self.image_url or self.image_upload
        if self.query_type not in QUERY_TYPES:
            raise ValueError(f"query_type must be one of {QUERY_TYPES}")
        if "text" in self.query_type and not self.query_text:
            raise ValueError("the query needs a text")
        if "image" in self.query_type and not image:
            raise ValueError("the query needs an image")
        if self.image_url and self.image_upload:
            raise ValueError("one image only")
        if not self.workspace_id or not 1 <= self.top_k <= 100:
            raise ValueError("workspace_id must be given and top_k be from 1 to 100")
        if not self.channels or len(set(self.channels)) != len(self.channels):
            raise ValueError("channels must be given once each")
        visual = not self.filters.asset_types or set(self.filters.asset_types) & set(VISUAL_TYPES)
        if wrong := [c for c in self.channels if c in VISUAL_CHANNELS and not visual]:
            raise ValueError(f"channels {wrong} do not fit the asset types")


@dataclass
class Plan:
    """(channel, query text, weight, source) of every channel, and why the plan is degraded."""

    channels: list[tuple[str, str, float, str]]
    reasons: list[str] = field(default_factory=list)


def plan(request: Request, enhance: Callable[[Request], tuple[dict[str, str], dict[str, float]]] | None = None) -> Plan:
    """Equal weights; with several channels and a text, `enhance` may give queries and weights. What it gets wrong falls back."""

    def source(channel: str) -> str:
        if request.query_type == "image_text":
            return "joint" if channel == "native" else "text"
        return request.query_type

    text = request.query_text or IMAGE_PLACEHOLDER
    queries, weights, reasons = dict.fromkeys(request.channels, text), dict.fromkeys(request.channels, 1 / len(request.channels)), []
    if enhance and len(request.channels) > 1 and request.query_text:
        try:
            queries, raw = enhance(request)
            if set(queries) != set(request.channels) or set(raw) != set(request.channels):
                raise ValueError("channels differ")
            if any(isinstance(w, bool) or not math.isfinite(w) or w <= 0 for w in raw.values()):
                raise ValueError("weights must be positive")
            weights = {c: w / sum(raw.values()) for c, w in raw.items()}
        except Exception as error:  # any failure of the model leaves the plain plan
            queries, reasons = dict.fromkeys(request.channels, text), [f"query enhancement failed: {error}"]
    return Plan([(c, queries[c], weights[c], source(c)) for c in request.channels], reasons)


def embed(own: Plan, encode: Callable[[str, str], Sequence[float]]) -> tuple[list[tuple[str, float, list[float]]], list[str]]:
    """((channel, weight, unit vector) ..., reasons): equal operations run once; a joint one that fails falls back to the image.

    Routes that fail or give an invalid vector are dropped, and the weights left are normalised again.
    """
    done: dict[tuple[str, str], list[float] | None] = {}
    reasons = list(own.reasons)

    def run(source: str, query: str) -> list[float] | None:
        key = (source, query if source != "image" else "")
        if key not in done:
            try:
                v = [float(x) for x in encode(source, query)]
                n = math.sqrt(sum(x * x for x in v))
                if not math.isfinite(n) or n == 0:
                    raise ValueError("invalid vector")
                done[key] = [x / n for x in v]
            except Exception as error:  # a failed route degrades the search
                reasons.append(f"{source} embedding failed: {error}")
                done[key] = None
        return done[key]

    out = []
    for channel, query, weight, source in own.channels:
        v = run(source, query)
        if v is None and source == "joint":
            v = run("image", query)
        if v is not None:
            out.append((channel, weight, v))
    if not out:
        raise RuntimeError("every embedding route failed")
    total = sum(w for _, w, _ in out)
    if abs(total - 1) > 1e-6:
        out = [(c, w / total, v) for c, w, v in out]
    return out, list(dict.fromkeys(reasons))


@dataclass
class Tables:
    vectors: DataFrame
    assets: DataFrame
    sources: DataFrame
    records: DataFrame
    favorites: DataFrame
    members: DataFrame
    clusters: DataFrame


def open_channels(
    queries: list[tuple[str, float, list[float]]], open_: Callable[[str], DataFrame]
) -> tuple[list[tuple[str, float, list[float]]], DataFrame, list[str]]:
    """(queries, vectors, reasons): the vectors of every channel that can be opened, and the queries of those.

    A channel whose vectors cannot be opened leaves the search, for a reason; its weight is shared out by the others. If
    none can, the search fails. One channel's vectors are one DataFrame, and only its plan is made here.
    """
    kept, vectors, reasons = [], None, []
    for channel, weight, v in queries:
        try:
            own = open_(channel).where(F.col("embedding_type") == channel)
            vectors = own if vectors is None else vectors.unionByName(own)
        except Exception as error:  # any failure of a channel's store degrades the search
            reasons.append(f"channel {channel} failed: {error}")
            continue
        kept.append((channel, weight, v))
    if vectors is None:
        raise RuntimeError("every channel failed: " + "; ".join(reasons))
    total = sum(w for _, w, _ in kept)
    return [(c, w / total, v) for c, w, v in kept] if reasons else kept, vectors, reasons


def _recall(spark: SparkSession, request: Request, queries: list[tuple[str, float, list[float]]], vectors: DataFrame) -> DataFrame:
    """The hits of the queries in their channels, under what of the filters is pushed into the scan of vectors."""
    f = request.filters
    rows = [(i, c, w, v) for i, (c, w, v) in enumerate(queries)]
    frame = spark.createDataFrame(rows, "query_no int, embedding_type string, weight double, query array<double>")
    first, last = f.seconds()
    vectors = search.prefilter(vectors, request.workspace_id, f.asset_types, f.sources, created_from=first, created_to=last)
    return search.recall(frame, vectors, search.channel_limit(request.top_k))


_HIT = "embedding_type string, weight double, rank int, embedding_id string, asset_id string, score double"


def recall_channels(
    spark: SparkSession, request: Request, queries: list[tuple[str, float, list[float]]], open_: Callable[[str], DataFrame]
) -> tuple[list[tuple[str, float, list[float]]], DataFrame, list[str]]:
    """(queries, hits, reasons): every channel's recall as an action of its own, all at once; a channel that fails leaves.

    A channel fails when it is opened, or when its rows are read: a file that is lost or broken, a store that does not
    answer, vectors of another shape. The others' hits stay, and their weights are scaled to a sum of one, which keeps
    their order. If every channel fails, the search does. A channel has channel_limit() hits at most, 100, which are
    fetched; what follows reads them from there, so no channel is read twice.
    """

    def one(query: tuple[str, float, list[float]]) -> list | Exception:
        channel = query[0]
        try:
            own = open_(channel).where(F.col("embedding_type") == channel)
            hits = _recall(spark, request, [query], own)
            return [tuple(r) for r in hits.select(*[c.split()[0] for c in _HIT.split(", ")]).collect()]
        except Exception as error:  # any failure of a channel's store degrades the search
            return error

    with ThreadPoolExecutor(len(queries)) as pool:
        outcomes = list(pool.map(inheritable_thread_target(spark)(one), queries))
    failed = [isinstance(x, Exception) for x in outcomes]
    reasons = [f"channel {q[0]} failed: {_brief(x)}" for q, x in zip(queries, outcomes, strict=True) if isinstance(x, Exception)]
    if all(failed):
        raise RuntimeError("every channel failed: " + "; ".join(reasons))
    total = sum(w for (_, w, _), gone in zip(queries, failed, strict=True) if not gone) if reasons else 1.0
    kept = [(c, w / total, v) for (c, w, v), gone in zip(queries, failed, strict=True) if not gone]
    hits = [(c, w / total, *rest) for rows, gone in zip(outcomes, failed, strict=True) if not gone for c, w, *rest in rows]
    return kept, spark.createDataFrame(hits, _HIT), reasons


def _brief(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error).strip().splitlines()[0][:200] if str(error).strip() else ''}"


def search_isolated(
    spark: SparkSession,
    request: Request,
    queries: list[tuple[str, float, list[float]]],
    open_: Callable[[str], DataFrame],
    t: Tables,
    relevance: DataFrame | None = None,
    features: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """(results, clusters, reasons) of run(), but that channels, and then the clusters, may fail without the results.

    Clusters, CLUSTER_TOP_K at most, are fetched; if that fails there are none, for a reason. t.vectors is not read.
    """
    queries, hits, reasons = recall_channels(spark, request, queries, open_)
    results, clusters = run(spark, request, queries, t, relevance, features, hits)
    try:
        clusters = spark.createDataFrame(clusters.collect(), clusters.schema)
    except Exception as error:  # the roll-up's tables are not the results'
        clusters = spark.createDataFrame([], "cluster_id string, cluster_score double")
        reasons.append(f"cluster result aggregation failed: {_brief(error)}")
    return results, clusters, list(dict.fromkeys(reasons))


def run(
    spark: SparkSession,
    request: Request,
    queries: list[tuple[str, float, list[float]]],
    t: Tables,
    relevance: DataFrame | None = None,
    features: DataFrame | None = None,
    hits: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, clusters) of a search, lazily: recall (or the hits given), fusion, validation, filters, reranking, folding, roll-up.

    results: position, asset_id, folded, score, reason, matched_feature. Blocks and times by which results fold are the
    assets' own parent_no, block_index, start_ms and end_ms. Candidates are validated once more after reranking, whose
    order stays: what is no longer live, current, or of the request's types, goes. `features` has (asset_id, embedding_type,
    text) for matched_feature. Filters by favourite, cluster and time hold after recall, so a selective one may leave
    fewer than top_k results.
    """
    f = request.filters
    hits = _recall(spark, request, queries, t.vectors) if hits is None else hits
    first, last = f.seconds()
    live = search.prefilter(assets.live(t.assets, t.sources, request.workspace_id), asset_types=f.asset_types, created_from=first, created_to=last)
    found = search.validate(search.fuse(hits, request.fusion), live, t.records)
    found = search.only_favorites(found, t.favorites, f.favorite, request.workspace_id, request.user)
    if f.cluster_id:
        found = search.in_cluster(found, t.members, f.cluster_id)
    # At most the candidate cap's rows are left: one window over them is small.
    found = found.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "asset_id")))
    if relevance is not None:
        found = search.rerank(found, relevance).drop("pos", "relevance").withColumnRenamed("new_pos", "pos")
    # The second validation keeps pos.
    found = search.revalidate(found, live, t.records)
    shown = live.select("asset_id", "index_role", F.col("parent_no").alias("parent"), F.col("block_index").alias("block"), "start_ms", "end_ms")
    rows = found.join(shown, "asset_id")
    if f.asset_types:
        rows = rows.where(F.col("asset_type").isin(*f.asset_types))
    rows = rows.select(F.lit(0).alias("query_no"), "pos", "asset_id", "source_file_id", "asset_type", "index_role", "parent", "block", "start_ms", "end_ms")
    results = fold.fold(rows, request.top_k)
    # A result's score goes to all assets folded into it.
    why = found.select("asset_id", "score", "evidence", search.reason(F.col("evidence")).alias("reason"))
    texts = F.create_map().cast("map<string,string>")
    if features is not None:
        entry = F.collect_list(F.struct("embedding_type", "text"))
        own = features.where("text is not null").groupBy("asset_id").agg(F.map_from_entries(entry).alias("_texts"))
        why, texts = why.join(own, "asset_id", "left"), F.coalesce("_texts", texts)
    why = why.withColumn("matched_feature", search.matched_feature(F.col("evidence"), texts))
    scored = results.join(why.select("asset_id", "score", "reason", "matched_feature"), "asset_id")
    folded = scored.select(F.explode("folded").alias("asset_id"), "score")
    return scored.drop("query_no"), search.cluster_rollup(folded, t.members, t.clusters, min(request.top_k, search.CLUSTER_TOP_K))
