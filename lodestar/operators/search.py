"""Recall, fusion, validation, reranking and roll-up of search results.

A search is one lazy chain: recall -> fuse -> validate -> rerank -> rows -> clusters; channels run in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vector

RRF_K = 60
CANDIDATE_CAP = 300
RERANK_HEAD = 30
MAX_CHANNEL_LIMIT = 100
CLUSTER_TOP_K = 12
SPREAD_EPSILON = 1e-12


def channel_limit(top_k: int) -> int:
    return min(3 * top_k, MAX_CHANNEL_LIMIT)


def normalised_weights(weights: DataFrame) -> DataFrame:
    """Positive finite weights over their sum."""
    total = F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return weights.where((F.col("weight") > 0) & (F.col("weight") < float("inf"))).withColumn("weight", F.col("weight") / total)


def route(query_type: Column, channel: Column) -> Column:
    """Which embedding of the query a channel takes: image, joint or text."""
    joint = (query_type == "image_text") & (channel == "native")
    return F.when(query_type == "image", "image").when(joint, "joint").otherwise("text")


def prefilter(
    vectors: DataFrame,
    workspace: str | None = None,
    asset_types: tuple[str, ...] = (),
    sources: tuple[str, ...] = (),
    models: tuple[str, ...] = (),
    created_from: int | None = None,
    created_to: int | None = None,
) -> DataFrame:
    """The conjunction that is pushed into the vector scan; times are whole epoch seconds, both ends included."""
    tests = {
        "workspace_id": workspace and F.col("workspace_id") == workspace,
        "asset_type": asset_types and F.col("asset_type").isin(*asset_types),
        "source_file_id": sources and F.col("source_file_id").isin(*sources),
        "model_name": models and F.col("model_name").isin(*models),
    }
    for test in tests.values():
        vectors = vectors.where(test) if test is not None and not isinstance(test, (str, tuple)) else vectors
    if created_from is not None:
        vectors = vectors.where(F.col("created_at_ts") >= created_from)
    if created_to is not None:
        vectors = vectors.where(F.col("created_at_ts") <= created_to)
    return vectors


def recall(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """Exact cosine top `limit` of queries(query_no, embedding_type, weight, query) in their channels.

    A search has at most twelve query vectors; up to vector.MOST_BROADCAST are counted and broadcast. With more, both
    sides meet by channel through a shuffle. Ranks go by score, then embedding_id.
    """
    fine = vectors.where(vector.is_valid("embedding"))
    # What a query has alone is told once for it, not for every pair.
    side = vector.counted(queries.where(vector.is_valid("query")).withColumn("_norm", vector.norm("query")))
    scored = fine.join(side.drop("ch"), "embedding_type").where(F.size("query") == F.size("embedding"))
    value = vector.dot("query", "embedding") / (F.col("_norm") * vector.norm("embedding"))
    scored = scored.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).drop("query", "embedding", "_norm")
    w = Window.partitionBy("query_no", "embedding_type").orderBy(F.desc("score"), "embedding_id")
    return scored.where("score is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def fuse_rrf(hits: DataFrame, k: int = RRF_K, cap: int = CANDIDATE_CAP) -> DataFrame:
    """Weighted reciprocal rank fusion of hits(embedding_type, weight, rank, embedding_id, asset_id, score).

    Ranks count duplicates. Of an embedding given twice in a channel the first counts; of an asset's hits in a channel
    only the first adds to the score, later ones are evidence. `matches` lists the evidence by channel and rank.
    """
    seen = F.row_number().over(Window.partitionBy("embedding_type", "embedding_id").orderBy("rank"))
    once = hits.withColumn("_seen", seen).where("_seen = 1")
    nth = F.row_number().over(Window.partitionBy("embedding_type", "asset_id").orderBy("rank"))
    part = once.withColumn("_nth", nth).withColumn("contribution", F.col("weight") / (k + F.col("rank")))
    match = F.struct("embedding_type", "rank", "embedding_id", "contribution", "score")
    fused = part.groupBy("asset_id").agg(
        F.sum(F.when(F.col("_nth") == 1, F.col("contribution")).otherwise(0.0)).alias("fused_score"),
        F.array_sort(F.collect_list(match)).alias("matches"),
    )
    return fused.orderBy(F.desc(F.round("fused_score", 12)), "asset_id").limit(cap)


def fuse_normalised(hits: DataFrame, cap: int = CANDIDATE_CAP) -> DataFrame:
    """Weighted sum of similarities scaled to [0, 1] in each channel, over all hits; equal ones count as 1."""
    w = Window.partitionBy("embedding_type")
    low, spread = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    scaled = F.when(spread <= SPREAD_EPSILON, 1.0).otherwise((F.col("score") - low) / spread)
    seen = F.row_number().over(Window.partitionBy("embedding_type", "embedding_id").orderBy("rank"))
    part = hits.withColumns({"_scaled": scaled, "_seen": seen}).where("_seen = 1")
    nth = F.row_number().over(Window.partitionBy("embedding_type", "asset_id").orderBy("rank"))
    part = part.withColumn("_nth", nth).withColumn("contribution", F.col("weight") * F.col("_scaled"))
    match = F.struct("embedding_type", "rank", "embedding_id", "contribution", "score")
    fused = part.groupBy("asset_id").agg(
        F.sum(F.when(F.col("_nth") == 1, F.col("contribution")).otherwise(0.0)).alias("fused_score"),
        F.array_sort(F.collect_list(match)).alias("matches"),
    )
    return fused.orderBy(F.desc(F.round("fused_score", 12)), "asset_id").limit(cap)


def fuse(hits: DataFrame, strategy: str = "rrf") -> DataFrame:
    return fuse_normalised(hits) if strategy == "normalized" else fuse_rrf(hits)


def only_favorites(rows: DataFrame, favorites: DataFrame, wanted: bool | None, workspace: str, user: str) -> DataFrame:
    """True: with the user's favourite; false: without; none: all."""
    if wanted is None:
        return rows
    own = favorites.where((F.col("workspace_id") == workspace) & (F.col("user_id") == user)).select("asset_id")
    return rows.join(own, "asset_id", "left_semi" if wanted else "left_anti")


def in_cluster(rows: DataFrame, members: DataFrame, cluster_id: str) -> DataFrame:
    return rows.join(members.where(F.col("cluster_id") == cluster_id).select("asset_id"), "asset_id", "left_semi")


def indexed(records: DataFrame, models: tuple[str, ...] = ()) -> DataFrame:
    """records of embeddings that are indexed, by one of the models if any are named."""
    records = records.where("status = 'indexed'")
    return records.where(F.col("model_name").isin(*models)) if models else records


def validate(fused: DataFrame, live_assets: DataFrame, records: DataFrame, models: tuple[str, ...] = ()) -> DataFrame:
    """Keeps the matches that are current, at most the best of each channel, and scores assets anew by them.

    A match is current if its embedding is indexed and has the asset's revision. Candidates are capped before this, so a
    stale one uses up its place.
    """
    match = fused.select("asset_id", F.explode("matches").alias("m")).select("asset_id", "m.*").withColumnRenamed("score", "similarity")
    state = indexed(records, models).select("embedding_id", F.col("embedding_revision").alias("_revision"))
    own = live_assets.select("asset_id", "source_file_id", "asset_type", "embedding_revision")
    met = match.join(own, "asset_id").join(state, "embedding_id").where("_revision = embedding_revision")
    best = F.row_number().over(Window.partitionBy("asset_id", "embedding_type").orderBy("rank"))
    met = met.withColumn("_n", best).where("_n = 1")
    # Evidence goes by contribution, then rank, then channel.
    evidence = F.struct((-F.col("contribution")).alias("order"), "rank", "embedding_type", "embedding_id")
    return met.groupBy("asset_id", "source_file_id", "asset_type").agg(
        F.sum("contribution").alias("score"), F.array_sort(F.collect_list(evidence)).alias("evidence")
    )


def revalidate(found: DataFrame, live_assets: DataFrame, records: DataFrame, models: tuple[str, ...] = ()) -> DataFrame:
    """validate() of rows that have been: evidence that is no longer current goes, scores are the sums of the rest.

    An asset left without evidence, or no longer live, goes. All other columns, the order of a reranking among them, stay.
    """
    state = indexed(records, models).select("embedding_id", F.col("embedding_revision").alias("_revision"))
    own = live_assets.select("asset_id", F.col("embedding_revision").alias("_own"))
    met = found.select("asset_id", F.explode("evidence").alias("e")).join(state, F.col("e.embedding_id") == F.col("embedding_id")).join(own, "asset_id")
    still = met.where("_revision = _own").groupBy("asset_id").agg(F.sum(-F.col("e.order")).alias("_score"), F.array_sort(F.collect_list("e")).alias("_evidence"))
    return found.join(still, "asset_id").withColumns({"score": F.col("_score"), "evidence": F.col("_evidence")}).drop("_score", "_evidence")


def matched_feature(evidence: Column, texts: Column) -> Column:
    """The text of the first feature channel of the evidence that has one; texts is a map by channel."""
    feature = F.filter(evidence, lambda e: ~e["embedding_type"].isin("native", "description") & texts[e["embedding_type"]].isNotNull())
    return F.when(F.size(feature) > 0, texts[feature[0]["embedding_type"]])


def reason(evidence: Column) -> Column:
    """The first three channels by name."""
    names = F.transform(F.slice(evidence, 1, 3), lambda e: e["embedding_type"])
    return F.concat(F.lit("matched by "), F.array_join(names, ", "))


def rerank(rows: DataFrame, relevance: DataFrame, head: int = RERANK_HEAD) -> DataFrame:
    """rows(pos, asset_id) with the head's relevance(asset_id, relevance): scored ones by relevance, then unscored, then the tail.

    Scores of unknown assets are ignored, of several for one asset the first (by order of pos) counts as their maximum.
    """
    scores = relevance.groupBy("asset_id").agg(F.max("relevance").alias("relevance"))
    met = rows.join(scores, "asset_id", "left")
    in_head = F.col("pos") <= head
    bucket = F.when(in_head & F.col("relevance").isNotNull(), 0).when(in_head, 1).otherwise(2)
    w = Window.orderBy("bucket", F.desc_nulls_last("key"), F.when(F.col("bucket") == 0, F.col("asset_id")), "pos")
    met = met.withColumn("bucket", bucket).withColumn("key", F.when(F.col("bucket") == 0, F.col("relevance")))
    return met.withColumn("new_pos", F.row_number().over(w)).drop("bucket", "key")


def source_cap(rows: DataFrame, cap: int = 3) -> DataFrame:
    """At most `cap` results of a source, in rank order."""
    w = Window.partitionBy("source_file_id").orderBy(F.desc("score"), "asset_id")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def cluster_rollup(results: DataFrame, members: DataFrame, clusters: DataFrame, top_k: int = CLUSTER_TOP_K) -> DataFrame:
    """Clusters of the results(asset_id, score): 0.65 best + 0.25 mean + 0.10 share of members matched.

    A member counts with score / best score times (0.75 + 0.25 p), p its membership score (1 if null).
    """
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("member_count"))
    top = F.max("score").over(Window.partitionBy(F.lit(1)))
    scaled = results.withColumn("scaled", F.when(top > 0, F.col("score") / top).otherwise(0.0)).select("asset_id", "scaled")
    own = members.select("cluster_id", "asset_id", F.coalesce("score", F.lit(1.0)).alias("p"))
    met = own.join(scaled, "asset_id").withColumn("w", F.col("scaled") * (0.75 + 0.25 * F.col("p")))
    rolled = met.groupBy("cluster_id").agg(F.max("w").alias("best"), F.avg("w").alias("mean"), F.count(F.lit(1)).alias("matched"))
    share = F.least(F.lit(1.0), F.col("matched") / F.col("member_count"))
    out = rolled.join(sizes, "cluster_id").join(clusters.select("cluster_id", "mode"), "cluster_id")
    out = out.withColumn("cluster_score", 0.65 * F.col("best") + 0.25 * F.col("mean") + 0.10 * share)
    return out.orderBy(F.desc(F.round("cluster_score", 12)), "cluster_id").limit(top_k)
