"""Runs of density clustering over channels of any size: small ones in a task each, large ones by blocks.

A large channel takes the steps of density.run(), merge_similar() and representatives() as Spark jobs: the labels by
spanning.cluster(), centroids as sums by cluster, the least cosine of two clusters by a scan, medoids by files of members.
The driver holds a centroid for each cluster, MOST_CLUSTERS of a channel at most; more are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Scratch
from . import assign, density, spanning, vector

#: Points of a channel that one task clusters; clusters whose centroids the driver compares.
MOST_POINTS, MOST_CLUSTERS = 3_000, 20_000
LIMIT = 10
LABELS = ("workspace_id", "embedding_type", "asset_id", "label", "merged_label")


def cluster_runs(
    vectors: DataFrame, dimension: int | None = 8, parameters: density.Parameters | None = None, gates: density.MergeGates = density.MergeGates(), most: int = MOST_POINTS
) -> DataFrame:
    """density.cluster_runs() of channels of any size. asset_ids of a channel must differ."""
    return _runs(vectors, dimension, parameters, gates, most, _placed)


def cluster_labels(
    vectors: DataFrame, dimension: int | None = 8, parameters: density.Parameters | None = None, gates: density.MergeGates = density.MergeGates(), most: int = MOST_POINTS
) -> DataFrame:
    """LABELS of cluster_runs(), for which large channels need no medoids, distances and roles."""
    return _runs(vectors, dimension, parameters, gates, most, lambda members, scratch: members.select(*LABELS)).select(*LABELS)


def _runs(
    vectors: DataFrame, dimension: int | None, parameters: density.Parameters | None, gates: density.MergeGates, most: int, told: Callable[[DataFrame, Scratch], DataFrame]
) -> DataFrame:
    kinds = ["workspace_id", "embedding_type"]
    with Scratch(vectors.sparkSession) as scratch:
        vectors = scratch.cut(vectors.select(*kinds, "asset_id", "source_file_id", "embedding"), "vectors")
        small, large = vectors, []
        for row in vectors.groupBy(*kinds).count().where(F.col("count") > most).orderBy(*kinds).collect():
            own = F.lit(True)
            for kind in kinds:
                own = own & F.col(kind).eqNullSafe(F.lit(row[kind]))
            small = small.where(~own)
            large.append(vectors.where(own))

        def run(rows: DataFrame) -> DataFrame:
            with Scratch(rows.sparkSession) as own:
                return own.keep(told(_labelled(rows, own, dimension, parameters, gates), own), "run")

        out = density.cluster_runs(small, dimension, parameters, gates)
        # A channel's rounds are many small jobs: some channels run side by side.
        with ThreadPoolExecutor(4) as pool:
            for part in pool.map(run, large):
                out = out.select(part.columns).unionByName(part)
        return scratch.keep(out, "runs")


def _labelled(rows: DataFrame, scratch: Scratch, dimension: int | None, parameters: density.Parameters | None, gates: density.MergeGates) -> DataFrame:
    """The channel's rows with their numbers, places y, labels and merged labels."""
    # Numbers in the order of asset_id, by which equal distances are decided.
    rows = scratch.cut(rows.orderBy("asset_id").withColumn("id", F.monotonically_increasing_id()), "ordered")
    points = scratch.cut(spanning.project(rows.select("id", F.col("embedding").cast("array<double>").alias("x")), dimension), "points")
    labels = spanning.cluster(points, parameters)
    members = scratch.cut(rows.join(labels, "id").join(points, "id"), "members")
    told = members.sparkSession.createDataFrame(list(merged_labels(members.select("label", "embedding"), gates).items()), "label int, into int")
    members = members.join(F.broadcast(told), "label", "left").withColumn("merged_label", F.when(F.col("label") >= 0, F.coalesce("into", "label"))).drop("into", "embedding")
    return scratch.cut(members, "merged")


def _placed(members: DataFrame, scratch: Scratch) -> DataFrame:
    """cluster_runs() of a channel, of _labelled()."""
    inside = members.where("merged_label is not null")
    found = assign.medoids(inside.select(F.col("merged_label").alias("label"), F.col("id").alias("embedding_id"), F.col("y").alias("embedding")))
    centers = inside.join(vector.counted(found.select(F.col("label").alias("merged_label"), F.col("medoid").alias("id"))), ["merged_label", "id"])
    centers = centers.select("merged_label", F.col("id").alias("center"), F.col("y").alias("_y"))
    gap = F.aggregate(F.zip_with("y", "_y", lambda a, b: (a - b) ** 2), F.lit(0.0), lambda s, v: s + v)
    placed = scratch.cut(members.join(vector.counted(centers), "merged_label", "left").withColumn("distance", F.sqrt(gap)).drop("y", "_y"), "placed")
    roles = representatives(placed.where("merged_label is not null"))
    out = placed.join(roles, "id", "left")
    return out.select("workspace_id", "embedding_type", "asset_id", "label", "merged_label", "probability", "distance", "role", "rank")


def _sums(members: DataFrame) -> DataFrame:
    """(label, n, total): sizes of clusters and sums of their unit vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy()
            if len(label):
                x = density.unit_rows(spanning.matrix(batch.column("embedding")))
                kinds, of, n = np.unique(label, return_inverse=True, return_counts=True)
                total = np.zeros((len(kinds), x.shape[1]))
                np.add.at(total, of, x)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(n, pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], ["label", "n", "total"])

    parts = members.mapInArrow(add, "label int, n long, total array<double>")
    each = parts.select("label", "n", F.posexplode("total").alias("at", "v")).groupBy("label", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return each.groupBy("label").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "v"))).getField("v").alias("total"))


def merged_labels(members: DataFrame, gates: density.MergeGates = density.MergeGates()) -> dict[int, int]:
    """density.merge_similar() of members(label, embedding): the new labels of those that change."""
    members = members.where("label >= 0")
    sums = _sums(members).orderBy("label").limit(MOST_CLUSTERS + 1).collect()
    if len(sums) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    names, held = [r["label"] for r in sums], [[r["label"]] for r in sums]
    n, total = [r["n"] for r in sums], [np.array(r["total"]) for r in sums]
    into: dict[int, int] = {}
    known: dict[tuple[tuple[int, ...], tuple[int, ...]], float] = {}
    while len(names) > 1:
        mean = np.array(total) / np.array(n)[:, None]
        center = density.unit_rows(mean)
        nearest, cosine = np.zeros(len(names), int), np.zeros(len(names))
        for at in range(0, len(names), 512):
            some = center[at : at + 512] @ center.T
            some[np.arange(len(some)), np.arange(at, at + len(some))] = -np.inf
            nearest[at : at + 512] = some.argmax(1)
            cosine[at : at + 512] = some.max(1)
        pairs = [(i, j) for i, j in enumerate(nearest.tolist()) if i < j and nearest[j] == i and cosine[i] >= gates.centroid and mean[i] @ mean[j] >= gates.cross_mean]
        if new := [(i, j) for i, j in pairs if (tuple(held[i]), tuple(held[j])) not in known]:
            for k, least in _least_cosines(members, [(held[i] + held[j], total[i] + total[j]) for i, j in new]).items():
                known[tuple(held[new[k][0]]), tuple(held[new[k][1]])] = least
        passed = []
        for i, j in pairs:
            least = known[tuple(held[i]), tuple(held[j])]
            if least >= gates.member_min:
                passed.append((-cosine[i], -float(mean[i] @ mean[j]), -least, i, j))
        if not passed:
            break
        *_, i, j = min(passed)
        into |= dict.fromkeys(held[j], names[i])
        held[i], n[i], total[i] = held[i] + held[j], n[i] + n[j], total[i] + total[j]
        for own in (names, held, n, total):
            own.pop(j)
    return into


def _least_cosines(members: DataFrame, groups: list[tuple[list[int], np.ndarray]]) -> dict[int, float]:
    """Of each group (labels, a vector) the least cosine of its members with the vector, by one scan."""
    of = {label: k for k, (labels, _) in enumerate(groups) for label in labels}
    middles = np.array([v / np.linalg.norm(v) for _, v in groups])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(middles), np.inf)
        for batch in batches:
            k = np.array([of.get(x, -1) for x in batch.column("label").to_numpy().tolist()], int)
            if (k >= 0).any():
                x = density.unit_rows(spanning.matrix(batch.column("embedding").filter(pa.array(k >= 0))))
                k = k[k >= 0]
                np.minimum.at(least, k, (x * middles[k]).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(middles))), pa.array(least)], ["k", "least"])

    rows = members.mapInArrow(scan, "k long, least double").groupBy("k").agg(F.min("least").alias("least")).collect()
    return {r["k"]: r["least"] for r in rows}


def representatives(placed: DataFrame, limit: int = LIMIT, edges: int = 2, per_source: int = 2) -> DataFrame:
    """(id, role, rank) of placed(id, merged_label, center, distance, asset_id, source_file_id, probability), as density.representatives().

    Of a source at most `per_source` members are chosen, so that its first ones in either order are all that can be; one
    task then has some rows of each cluster.
    """
    rows = placed.select("id", "merged_label", "center", "distance", "asset_id", "source_file_id", "probability")
    sizes = rows.groupBy("merged_label").agg(F.count(F.lit(1)).alias("size"))
    near, unsure = ["distance", "asset_id"], ["probability", "distance", "asset_id"]
    others, found = rows.where("id <> center"), rows.where("id = center")
    for order, of_source in ((near, per_source), (unsure, 2 * per_source)):
        some = others.withColumn("_n", F.row_number().over(Window.partitionBy("merged_label", "source_file_id").orderBy(*order))).where(F.col("_n") <= of_source)
        some = some.withColumn("_n", F.row_number().over(Window.partitionBy("merged_label").orderBy(*order))).where(F.col("_n") <= 8 * limit).drop("_n")
        found = found.unionByName(some)
    found = found.dropDuplicates(["id"]).join(vector.counted(sizes), "merged_label")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        center = int(np.flatnonzero(pdf["id"] == pdf["center"])[0])
        away, names = pdf["distance"].to_numpy(), pdf["asset_id"].tolist()
        order = sorted((i for i in range(len(pdf)) if i != center), key=lambda i: (away[i], names[i]))
        chosen = density.choose(center, order, int(pdf["size"].iloc[0]), away, names, pdf["source_file_id"].tolist(), pdf["probability"].to_numpy(), limit, edges, per_source)
        return pd.DataFrame({"id": [pdf["id"].iloc[i] for i, _ in chosen], "role": [r for _, r in chosen], "rank": range(len(chosen))})

    return found.groupBy("merged_label").applyInPandas(choose, "id long, role string, rank int")
