"""Current clusters: incremental assignment, status, publication and membership commands.

State is immutable: a command takes tables and returns new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Scratch, load_arrays, save_arrays
from . import assets, spanning, vector

THRESHOLD = 0.88
#: Vectors of a label that a task of medoids() has on either side.
BLOCK = 2048


def assign(fresh: DataFrame, reps: DataFrame, excluded: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(asset_id, cluster_id, mode, score): for fresh(asset_id, embedding) the best of reps(cluster_id, mode, rep).

    A resident_open cluster wins over dynamic ones whatever the score; then the larger score, then the larger id.
    resident_manual clusters admit nobody, excluded(asset_id, cluster_id) pairs are out. One representative for each
    current cluster of a channel is a small set, which is counted and broadcast. Of more than vector.MOST_BROADCAST, each
    asset meets a share of them in each of as many tasks.
    """
    side = reps.where("mode <> 'resident_manual'").where(vector.is_valid("rep"))
    fresh = fresh.where(vector.is_valid("embedding"))
    n = side.count()
    if n <= vector.MOST_BROADCAST:
        pairs = fresh.join(F.broadcast(side), F.size("embedding") == F.size("rep"))
    else:
        # Shares of the representatives by assets dealt evenly: no key holds all of either.
        shares = -(-n // vector.MOST_BROADCAST)
        side = side.withColumn("_share", F.pmod(F.xxhash64("cluster_id"), F.lit(shares))).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(63))))
        fresh = fresh.withColumn("_deal", F.pmod(F.xxhash64("asset_id"), F.lit(64)).cast("int")).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
        pairs = fresh.join(side, ["_share", "_deal"]).where(F.size("embedding") == F.size("rep")).drop("_share", "_deal")
    pairs = pairs.withColumn("score", vector.cosine("embedding", "rep")).drop("embedding", "rep").where(F.col("score") >= threshold)
    pairs = pairs.join(excluded.select("asset_id", "cluster_id"), ["asset_id", "cluster_id"], "left_anti")
    first = F.when(F.col("mode") == "resident_open", 0).otherwise(1)
    w = Window.partitionBy("asset_id").orderBy(first, F.desc("score"), F.desc("cluster_id"))
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def new_asset_status(inputs: DataFrame, baseline: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """(asset_id, status) of inputs(asset_id, embedding_id) that baseline(embedding_id) does not have."""
    fresh = inputs.join(baseline, "embedding_id", "left_anti")
    own = members.join(clusters.select("cluster_id", "mode"), "cluster_id").select("asset_id", "mode")
    status = F.when(F.col("mode").isNull(), "pending").when(F.col("mode") == "resident_manual", "manual_management").otherwise("incrementally_clustered")
    return fresh.join(own, "asset_id", "left").select("asset_id", status.alias("status"))


def bootstrap(records: DataFrame, live_assets: DataFrame, busy: DataFrame, least: int = 50) -> DataFrame:
    """(embedding_type, eligible, start) by channel; busy(embedding_type) have a baseline or a run under way."""
    text = assets.feature_text(F.col("feature_status"), F.col("feature_value"), F.col("feature_user_value"))
    met = records.where("status = 'indexed'").select("asset_id", "embedding_type").join(live_assets, "asset_id")
    met = met.where(assets.eligible(F.col("embedding_type"), F.col("description"), text))
    met = met.where(assets.supports(F.col("embedding_type"), F.col("asset_type")))
    counts = met.groupBy("embedding_type").agg(F.count_distinct("asset_id").alias("n"))
    out = records.select("embedding_type").distinct().join(counts, "embedding_type", "left")
    out = out.join(busy.withColumn("busy", F.lit(True)), "embedding_type", "left").withColumn("eligible", F.coalesce("n", F.lit(0).cast("long")))
    return out.select("embedding_type", "eligible", ((F.col("eligible") >= least) & F.col("busy").isNull()).alias("start"))


def without_residents(vectors: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    resident = members.join(clusters.where("mode <> 'dynamic'").select("cluster_id"), "cluster_id", "left_semi").select("asset_id")
    return vectors.join(resident, "asset_id", "left_anti")


def publish(clusters: DataFrame, new: DataFrame, channel: int) -> DataFrame:
    """clusters with the dynamic ones of a channel replaced by new(cluster_id, ch)."""
    kept = clusters.where(~((F.col("ch") == channel) & (F.col("mode") == "dynamic"))).select("cluster_id", "ch", "mode")
    return kept.unionByName(new.select("cluster_id", "ch", F.lit("dynamic").alias("mode")))


def attach(members: DataFrame, wish: DataFrame, clusters: DataFrame, excluded: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(members, exclusions) after adding wish(asset_id, cluster_id) in one channel.

    source 'algorithm': only assets without a cluster, into clusters that are not resident_manual, exclusions hold.
    source 'user': moves the asset wherever it was and clears its exclusion from the cluster.
    """
    fine = wish.join(clusters.select("cluster_id", "mode"), "cluster_id").dropDuplicates(["asset_id"])
    old = members.select("asset_id", "cluster_id", "member_source").withColumn("fresh", F.lit(False))
    if source == "algorithm":
        fine = fine.where("mode <> 'resident_manual'").join(members.select("asset_id"), "asset_id", "left_anti")
        fine = fine.join(excluded, ["cluster_id", "asset_id"], "left_anti")
    else:
        old = old.join(fine.select("asset_id"), "asset_id", "left_anti")
        excluded = excluded.join(fine.select("cluster_id", "asset_id"), ["cluster_id", "asset_id"], "left_anti")
    new = fine.select("asset_id", "cluster_id", F.lit(source).alias("member_source"), F.lit(True).alias("fresh"))
    return old.unionByName(new), excluded


def detach(members: DataFrame, gone: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, exclusions) after taking gone(asset_id, cluster_id) out for good."""
    left = members.join(gone, ["asset_id", "cluster_id"], "left_anti")
    return left, excluded.unionByName(gone.select("cluster_id", "asset_id")).distinct()


def detach_and_reassign(
    members: DataFrame, gone: DataFrame, excluded: DataFrame, vectors: DataFrame, reps: DataFrame, threshold: float = THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """(members, exclusions) after taking gone(asset_id, cluster_id) out: each asset goes to the best other cluster that admits it.

    members has asset_id, cluster_id and member_source; vectors(asset_id, embedding) and reps are as for assign().
    """
    taken = gone.join(members, ["asset_id", "cluster_id"], "left_semi")
    left, excluded = detach(members, taken, excluded)
    free = vectors.join(taken.select("asset_id").distinct(), "asset_id", "left_semi").join(left.select("asset_id"), "asset_id", "left_anti")
    new = assign(free, reps, excluded, threshold).select("asset_id", "cluster_id", F.lit("algorithm").alias("member_source"))
    return left.select("asset_id", "cluster_id", "member_source").unionByName(new), excluded


def _totals(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of each row of x the sum of its distances to the rows of y, times their weights."""
    total, sq, columns = np.zeros(len(x)), (y**2).sum(axis=1), np.ascontiguousarray(y.T)
    for at in range(0, len(x), 128):
        some = x[at : at + 128]
        both = (some**2).sum(axis=1)[:, None] + sq
        d = both - 2 * (some @ columns)
        # Near pairs are differences of almost equal numbers: they are computed from the components.
        r, c = np.nonzero(~(d > 0.01 * both))
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        for first in range(0, len(r), 65536):
            i, j = r[first : first + 65536], c[first : first + 65536]
            d[i, j] = np.sqrt(((some[i] - y[j]) ** 2).sum(axis=1))
        total[at : at + 128] = d @ weight
    return total


class _Rough:
    """Totals in single precision with a bound of their error: they tell which rows can have the least."""

    def __init__(self, x: np.ndarray):
        self.middle = x.mean(axis=0)
        most = float(np.abs(x - self.middle).max(initial=0))
        self.scale = 2.0 ** -int(np.clip(np.ceil(np.log2(most)), -1000, 1000)) if 0 < most < np.inf else 1.0
        own = (x - self.middle) * self.scale
        sq = (own**2).sum(axis=1)
        self.norm, self.rows = np.sqrt(sq), np.column_stack([own, np.ones(len(x)), sq]).astype(np.float32)
        self.total, self.error = np.zeros(len(x)), np.zeros(len(x))

    def add(self, y: np.ndarray, weight: np.ndarray) -> None:
        own = (y - self.middle) * self.scale
        sq = (own**2).sum(axis=1)
        columns = np.ascontiguousarray(np.column_stack([-2 * own, sq, np.ones(len(y))]).astype(np.float32).T)
        # A sum over at most 512 columns each: fewer roundings.
        share = np.zeros((len(y), -(-len(y) // 512)), np.float32)
        share[np.arange(len(y)), np.arange(len(y)) // 512] = weight
        every = float(weight.sum())
        for at in range(0, len(self.rows), 128):
            d = self.rows[at : at + 128] @ columns
            # Of a square distance; those under `near` count as `near`.
            wrong = 1.3e-7 * (y.shape[1] + 8) * (self.norm[at : at + 128] + np.sqrt(sq.max())) ** 2 + 1e-30
            near = (1000 * wrong).astype(np.float32)
            np.sqrt(np.maximum(d, near[:, None], out=d), out=d)
            least, total = np.sqrt(near.astype(np.float64)), (d @ share).sum(axis=1, dtype=np.float64)
            r, c = np.nonzero(d <= (1.000001 * least)[:, None].astype(np.float32))
            close = np.bincount(r, weight[c], len(d))
            self.total[at : at + 128] += total
            self.error[at : at + 128] += every * 1.01 * wrong / least + 1.01 * close * least + 4e-5 * total

    def candidates(self) -> np.ndarray:
        """Rows that can have the least total; all if it cannot be told."""
        within = ~(self.total - self.error > (self.total + self.error).min()) if np.isfinite(self.total + self.error).all() else np.ones(len(self.total), bool)
        return np.flatnonzero(within)


def medoids(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(label, medoid, total) of rows(label, embedding_id, embedding): least sum of Euclidean distances, then smallest id.

    ids must differ. Equal vectors of a label are one with a weight. Labels of up to `block` vectors are a group each. The
    vectors of larger ones are dealt into files of about `block` in the shared folder; a task reads a label's files one after another for each of its own, so that nothing of a pair is
    shuffled. Totals in single precision tell which vectors to compute exactly. Work grows with the square of a label's
    distinct vectors, memory and what is shuffled do not.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("label", "embedding_id")}
    own = rows.where("label is not null").groupBy("label", "embedding").agg(F.min("embedding_id").alias("embedding_id"), F.count(F.lit(1)).cast("double").alias("weight"))
    with Scratch(rows.sparkSession) as scratch:
        own, folder = scratch.cut(own, "distinct"), scratch.path("members")
        counts = own.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))
        # Labels are fewer than vectors, but may be many: the join broadcasts them or shuffles.
        counts = scratch.cut(counts, "counts")
        every = own.join(counts, "label")

        def least(label: pa.ChunkedArray, ids: pa.Array, total: np.ndarray) -> pa.Table:
            # Totals are compared after rounding: what may yet be the least leaves the task.
            few = np.flatnonzero(~(total > total.min() + 1e-8))
            return pa.table({"label": label.take(pa.array(np.zeros(len(few), np.int64))), "embedding_id": ids.take(pa.array(few)), "total": total[few]})

        def alone(table: pa.Table) -> pa.Table:
            x = spanning.matrix(table.column("embedding").combine_chunks())
            return least(table.column("label"), table.column("embedding_id"), _totals(x, x, table.column("weight").to_numpy()))

        dealt = every.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("embedding_id"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("name", F.sha2(F.col("label").cast("string"), 256))

        def save(table: pa.Table) -> pa.Table:
            name, part = table.column("name")[0].as_py(), table.column("part")[0].as_py()
            x = spanning.matrix(table.column("embedding").combine_chunks())
            save_arrays(folder, f"{name}-{part}.npz", x=x, weight=table.column("weight").to_numpy())
            ids = pa.array([table.column("embedding_id").to_pylist()], pa.list_(table.schema.field("embedding_id").type))
            return pa.table({"label": table.column("label")[:1], "name": [name], "part": pa.array([part], pa.int32()), "ids": ids})

        files = scratch.cut(dealt.groupBy("name", "part").applyInArrow(save, f"label {kinds['label']}, name string, part int, ids array<{kinds['embedding_id']}>"), "files")
        # A part that no vector fell into has no file.
        there = files.groupBy("name").agg(F.sort_array(F.collect_list("part")).alias("parts"))
        tasks = files.join(there, "name").repartition(max(1, min(files.count(), 10_000)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    name, part, parts = (batch.column(c)[i].as_py() for c in ("name", "part", "parts"))
                    x = load_arrays(folder, f"{name}-{part}.npz")["x"]
                    rough = _Rough(x)
                    for other in parts:
                        held = load_arrays(folder, f"{name}-{other}.npz")
                        rough.add(held["x"], held["weight"])
                    some = rough.candidates()
                    total = np.zeros(len(some))
                    for other in parts:
                        held = load_arrays(folder, f"{name}-{other}.npz")
                        total += _totals(x[some], held["x"], held["weight"])
                    yield from least(batch.column("label")[i : i + 1], batch.column("ids")[i].values.take(pa.array(some)), total).to_batches()

        schema = f"label {kinds['label']}, embedding_id {kinds['embedding_id']}, total double"
        found = every.where("parts = 1").drop("parts").groupBy("label").applyInArrow(alone, schema).unionByName(tasks.mapInArrow(run, schema))
        best = found.groupBy("label").agg(F.min_by("embedding_id", F.struct(F.round("total", 9).alias("t"), "embedding_id")).alias("medoid"), F.min("total").alias("total"))
        return scratch.keep(best.select("label", "medoid", F.round("total", 6).alias("total")), "medoids")


def nearest_to_medoid(rows: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """(label, rank, embedding_id, distance): the `limit` members nearest to each medoid of found(label, medoid), itself first.

    Ranks go by Euclidean distance, then embedding_id; Spark keeps `limit` rows of a label in each task before they meet.
    """
    centers = rows.join(found.select("label", F.col("medoid").alias("embedding_id")), ["label", "embedding_id"], "left_semi")
    centers = centers.groupBy("label").agg(F.first("embedding").alias("_center"))
    gap = F.aggregate(F.zip_with("embedding", "_center", lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, v: s + v)
    met = rows.select("label", "embedding_id", "embedding").join(vector.counted(centers), "label").withColumn("distance", F.sqrt(gap))
    order = Window.partitionBy("label").orderBy("distance", "embedding_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("label", "rank", "embedding_id", "distance")
