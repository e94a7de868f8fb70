"""Relevance evaluation: precision at 5, recall at 10, by query type, with gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Scratch, load_arrays, save_arrays

#: The gates on mean precision at 5 by query type, and on mean recall at 10.
PRECISION_GATES = {"text": 0.75, "image": 0.70, "image_text": 0.70}
RECALL_GATE = 0.75
#: Vectors of a file, and queries that a task holds.
ROWS, QUERIES = 4096, 512


def evaluate(cases: DataFrame) -> DataFrame:
    """(query_type, cases, precision_at_5, recall_at_10, passed) of cases(query_type, ranked array, relevant array)."""
    at5 = F.size(F.array_intersect(F.slice("ranked", 1, 5), "relevant"))
    at10 = F.size(F.array_intersect(F.slice("ranked", 1, 10), "relevant"))
    return evaluate_counts(cases.select("query_type", at5.alias("hits_5"), at10.alias("hits_10"), F.size("relevant").alias("relevant")))


def evaluate_counts(cases: DataFrame) -> DataFrame:
    """evaluate() of cases(query_type, hits_5, hits_10, relevant): how many of the first 5 and 10 are relevant, and how many are at all."""
    at5, at10 = F.col("hits_5") / 5.0, F.col("hits_10") / F.greatest("relevant", F.lit(1))
    out = cases.groupBy("query_type").agg(F.count(F.lit(1)).alias("cases"), F.avg(at5).alias("precision_at_5"), F.avg(at10).alias("recall_at_10"))
    gate = F.create_map(*[F.lit(x) for kv in PRECISION_GATES.items() for x in kv])
    return out.withColumn("passed", (F.col("precision_at_5") >= gate[F.col("query_type")]) & (F.col("recall_at_10") >= RECALL_GATE))


def _first(scores: np.ndarray, ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The `limit` largest scores of each row and their ids, equal scores by id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :limit]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def nearest(queries: DataFrame, rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """(qid, rank, vec_id) of queries(qid, q) over rows(vec_id, embedding): the `limit` largest inner products, ties to smaller vec_id.

    The rows are files in the shared folder, by a number that a task's rows and their place give. A task holds some queries
    and reads all files one after another, so that of pairs only the result leaves it. Products that a matrix product shows
    to be among the largest are summed from the first component to the last.
    """
    folder = scratch.path("rows")
    own = rows.where("embedding is not null").select("vec_id", "embedding")
    parts = max(1, -(-own.count() // ROWS))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if some := [b for b in batches if b.num_rows]:
            t = pa.Table.from_batches(some)
            part = t.column("part")[0].as_py()
            save_arrays(folder, f"rows-{part}.npz", ids=t.column("vec_id").to_numpy(), x=np.array(t.column("embedding").to_pylist(), np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])

    dealt = own.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    files = sorted(r["part"] for r in dealt.repartitionById(parts, F.col("part")).mapInArrow(save, "part int").collect())

    def run(table: pa.Table) -> pa.Table:
        qid, q = table.column("qid").to_numpy(), np.array(table.column("q").to_pylist(), np.float64)
        best, who = np.full((len(q), limit), -np.inf), np.full((len(q), limit), np.iinfo(np.int64).max)
        length = np.sqrt((q**2).sum(1))
        for part in files:
            held = load_arrays(folder, f"rows-{part}.npz")
            x, ids = held["x"], held["ids"]
            slack = 1e-15 * (q.shape[1] + 4) * length * np.sqrt((x**2).sum(1).max()) + 1e-300
            g = q @ x.T
            least = best[:, -1]
            if (open_ := np.isinf(least)).any() and g.shape[1] > limit:
                least = np.where(open_, np.partition(g, g.shape[1] - limit, axis=1)[:, g.shape[1] - limit], least)
            r, c = np.nonzero(~(g < (least - slack)[:, None]))
            for i in np.unique(r).tolist():
                pick = c[np.searchsorted(r, i) : np.searchsorted(r, i, "right")]
                score = np.zeros(len(pick))
                for k in range(q.shape[1]):
                    score += q[i, k] * x[pick, k]
                score = np.where(np.isnan(score), np.inf, score)
                both, names = _first(np.concatenate([best[i], score])[None], np.concatenate([who[i], ids[pick]])[None], limit)
                best[i], who[i] = both[0], names[0]
        fine = who < np.iinfo(np.int64).max
        rank = np.broadcast_to(np.arange(1, limit + 1, dtype=np.int32), fine.shape)
        return pa.table({"qid": np.repeat(qid, limit)[fine.ravel()], "rank": rank[fine], "vec_id": who[fine]})

    asked = queries.where("q is not null").select("qid", "q")
    shares = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("share", F.pmod(F.xxhash64("qid"), F.lit(shares)).cast("int")).repartitionById(shares, F.col("share"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if some := [b for b in batches if b.num_rows]:
            yield from run(pa.Table.from_batches(some)).to_batches()

    return asked.select("qid", "q").mapInArrow(each, "qid long, rank int, vec_id long")
