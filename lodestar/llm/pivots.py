"""Hard negatives from a pivot table.

A shard's vectors get one more component, the square root of M^2 - |x|^2 for the longest norm M of the shard, and a query
gets a zero there: then |q - x|^2 = |q|^2 + M^2 - 2 qx, and an inner product is a distance. A shard stores, for a few of
its points, the pivots, the distance of every point to each. By the triangle inequality |d(q,p) - d(x,p)| <= d(q,x) <=
d(q,p) + d(x,p) for every pivot p, so the table brackets each score from both sides before a vector is touched. Rows whose
bracket can matter are scored exactly; the bounds have slack for rounding, so none is lost.

M and the pivots belong to a shard: one very long vector loosens the bounds of its own shard only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, load_arrays, new_path, numbered, read, save_arrays

POSITIVES, NEGATIVES = 5, 3
#: A negative's score, in percent of the positive's: these two and between.
LOW, HIGH = 50, 95
#: Rows of a shard, anchors of a block, shards that a task goes through at most, pivots of a shard.
SHARD, ANCHORS, RUN, PIVOTS = 16_384, 64, 64, 12
#: Rows of the highest upper bounds that are scored first, for a threshold.
AHEAD = 64
_NONE = np.iinfo(np.int64).min
#: Scores below this are whole numbers that doubles hold exactly.
_EXACT = 2.0**53


def quantise(vectors: DataFrame, scale: int = 256, column: str = "embedding") -> DataFrame:
    """vectors whose column has neither a null nor a non-finite component, each component x as floor(scale * x), a double."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # floor() of a double is a long, and would be cut off beyond it: such components stay as they are, being whole.
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**40, F.floor(v.cast("double") * scale).cast("double")).otherwise(v.cast("double") * scale))
    return vectors.where(x.isNotNull() & fine).withColumn(column, whole)


def table(points: np.ndarray, count: int = PIVOTS) -> dict[str, np.ndarray]:
    """A shard's pivot table: pivots (each the farthest from those before), distances of all points to them, and M^2."""
    squares = (points**2).sum(1)
    top = squares.max()
    lifted = np.column_stack([points, np.sqrt(top - squares)])
    at, nearest, chosen, columns = int(squares.argmax()), np.full(len(points), np.inf), [], []
    for _ in range(min(count, len(points))):
        d = np.sqrt(((lifted - lifted[at]) ** 2).sum(1))
        chosen.append(at)
        columns.append(d)
        nearest = np.minimum(nearest, d)
        at = int(nearest.argmax())
    return {"pivots": lifted[chosen], "distances": np.array(columns), "top": np.array(top)}


def brackets(queries: np.ndarray, held: dict[str, np.ndarray], rows: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of queries and a shard's rows, by its pivot table alone."""
    squares, top = (queries**2).sum(1), float(held["top"])
    d = ((queries[:, None, :] - held["pivots"][None, :, :-1]) ** 2).sum(2) + held["pivots"][:, -1] ** 2
    d = np.sqrt(d)
    own = held["distances"][:, rows]
    least, most = np.zeros((len(queries), own.shape[1])), np.full((len(queries), own.shape[1]), np.inf)
    for p in range(len(own)):
        np.maximum(least, np.abs(d[:, p, None] - own[p]), out=least)
        np.minimum(most, d[:, p, None] + own[p], out=most)
    whole = (squares + top)[:, None]
    slack = 1e-10 * whole + 0.25
    return (whole - most**2) / 2 - slack, (whole - least**2) / 2 + slack


def products(points: np.ndarray, query: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products of whole numbers, int64; top is the largest square of a norm among points."""
    if np.sqrt(top) * np.sqrt((query**2).sum()) < _EXACT:
        return (points @ query).astype(np.int64)
    q = [int(v) for v in query]
    found = [sum(int(a) * b for a, b in zip(row, q, strict=True)) for row in points]
    if any(abs(s) >= 1 << 63 for s in found):
        raise ValueError("an inner product does not fit in a long")
    return np.array(found, np.int64)


class Best:
    """The k best (score, id, row) of one list: highest score first, ties by id, then row."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.rows = k, *(np.zeros(0, np.int64) for _ in range(3))

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else _NONE

    def take(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(score) > self.k:
            fine = score >= np.partition(score, -self.k)[-self.k]
            score, ids, rows = score[fine], ids[fine], rows[fine]
        if len(score):
            score, ids, rows = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.rows, rows)))
            order = np.lexsort((rows, ids, -score))[: self.k]
            self.score, self.ids, self.rows = score[order], ids[order], rows[order]


def nearest(asked: dict, held: dict, best: list[Best]) -> None:
    """Puts a shard's rows of an anchor's own label among its best. A shard's rows are in the order of their labels."""
    for label in np.unique(asked["label"]):
        rows = slice(*np.searchsorted(held["label"], [label, label], "left").tolist())
        rows = slice(rows.start, int(np.searchsorted(held["label"], label, "right")))
        if rows.start == rows.stop:
            continue
        who = np.flatnonzero(asked["label"] == label)
        x, ids, numbers = held["x"][rows], held["ids"][rows], held["rows"][rows]
        _, upper = brackets(asked["x"][who], held, rows)
        for a, high in zip(who.tolist(), upper, strict=True):
            high[numbers == asked["rows"][a]] = -np.inf  # itself
            for ahead in (True, False):
                at = np.flatnonzero(high >= max(best[a].least(), -1e300))
                if ahead and len(at) > AHEAD:
                    at = at[np.argpartition(high[at], -AHEAD)[-AHEAD:]]
                best[a].take(products(x[at], asked["x"][a], float(held["top"])), ids[at], numbers[at])
                high[at] = -np.inf


def between(asked: dict, held: dict, wanted: list[tuple[int, int, int]], best: list[Best]) -> None:
    """Puts a shard's rows of other labels among the best of each (anchor, lowest, highest score) wanted, in anchors' order."""
    lower, upper = brackets(asked["x"], held)
    at = 0
    while at < len(wanted):
        a, end = wanted[at][0], at
        while end < len(wanted) and wanted[end][0] == a:
            end += 1
        floor = min(max(low, best[i].least()) for i, (_, low, _) in enumerate(wanted[at:end], at))
        top = max(high for _, _, high in wanted[at:end])
        rows = np.flatnonzero((upper[a] >= floor) & (lower[a] <= top) & (held["label"] != asked["label"][a]))
        score = products(held["x"][rows], asked["x"][a], float(held["top"]))
        for i, (_, low, high) in enumerate(wanted[at:end], at):
            fine = (score >= low) & (score <= high)
            best[i].take(score[fine], held["ids"][rows[fine]], held["rows"][rows[fine]])
        at = end


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    shard: int = SHARD,
    block: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors(vec_id, label, embedding).

    embedding holds whole numbers (see quantise). `anchors` tells the rows that ask. An anchor's positives are the best
    other rows of its label by inner product; for each, the best rows of other labels whose score is from `low` to `high`
    percent of the positive's are its negatives. Ties go by smaller vec_id. Rows that repeat a vec_id are rows of their
    own, also as anchors, ordered by their place in the table. Rows with a null in one of the columns take no part; an
    anchor without positives, or a positive without negatives, has no row. Vectors of several lengths, and scores that do
    not fit in a long, are a ValueError. Columns by other names are not looked at; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    named = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = numbered(vectors.where("vec_id is not null and label is not null and embedding is not null"))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", "_row", F.coalesce(anchors, F.lit(False)).alias("_asks"))
    size = F.size("embedding")
    n, m, shortest, longest = rows.agg(F.count(F.lit(1)), F.count_if("_asks"), F.min(size), F.max(size)).first()
    if not n or not m:
        return spark.createDataFrame([], named)
    if shortest != longest:
        raise ValueError(f"vectors of {shortest} to {longest} components; all must have as many")
    shards, blocks, folder = -(-n // shard), -(-m // block), new_path(spark, "pivots")

    def keep(kind: str, indexed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if own := [b for b in batches if b.num_rows]:
                t = pa.Table.from_batches(own).sort_by([("label", "ascending"), ("_row", "ascending")])
                number, x = t.column("_to")[0].as_py(), _matrix(t.column("embedding"))
                arrays = {"x": x, "ids": t.column("vec_id").to_numpy(), "label": t.column("label").to_numpy(), "rows": t.column("_row").to_numpy()}
                save_arrays(folder, f"{kind}-{number}.npz", **arrays, **(table(x) if indexed else {}))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], ["made"])

        return run

    def kept(df: DataFrame, count: int, kind: str, indexed: bool) -> list[int]:
        to = df.withColumn("_to", F.pmod(F.xxhash64("_row"), F.lit(count)).cast("int"))
        return sorted(r[0] for r in to.repartitionById(count, F.col("_to")).mapInArrow(keep(kind, indexed), "made int").collect())

    tables = kept(rows, shards, "table", True)
    packs = kept(rows.where("_asks"), blocks, "block", False)
    run = max(1, min(RUN, len(tables) * len(packs) // (2 * spark.sparkContext.defaultParallelism), len(tables)))
    runs = -(-len(tables) // run)
    tasks = spark.range(0, runs * len(packs), 1, runs * len(packs))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, Iterator[dict]]]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                first, pack = task % runs * run, packs[task // runs]
                yield pack, load_arrays(folder, f"block-{pack}.npz"), (load_arrays(folder, f"table-{t}.npz") for t in tables[first : first + run])

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, asked, those in each(batches):
            best = [Best(positives) for _ in asked["rows"]]
            for held in those:
                nearest(asked, held, best)
            lengths = [len(b.score) for b in best]
            columns = [np.repeat(asked["rows"], lengths), *(np.concatenate([getattr(b, c) for b in best]) for c in ("ids", "rows", "score"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(sum(lengths), pack, np.int32)), *map(pa.array, columns)], ["_to", "anchor", "positive_id", "positive", "positive_score"])

    found = tasks.mapInArrow(find_positives, "_to int, anchor long, positive_id long, positive long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    best = cut(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives), "positives")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own := [b for b in batches if b.num_rows]:
            t = pa.Table.from_batches(own).sort_by([("anchor", "ascending"), ("n", "ascending")])
            number = t.column("_to")[0].as_py()
            save_arrays(folder, f"positives-{number}.npz", **{c: t.column(c).to_numpy() for c in ("anchor", "positive_id", "positive", "positive_score")})
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], ["made"])

    answered = {r[0] for r in best.repartitionById(max(packs) + 1, F.col("_to")).mapInArrow(gather, "made int").collect()}

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, asked, those in each(batches):
            if pack not in answered:
                continue
            own = load_arrays(folder, f"positives-{pack}.npz")
            place = {row: i for i, row in enumerate(asked["rows"].tolist())}
            scores = own["positive_score"].tolist()
            # From low to high percent, in whole numbers: rounded up, and down.
            wanted = [(place[a], -(-low * s // 100), high * s // 100) for a, s in zip(own["anchor"].tolist(), scores, strict=True)]
            fine = [i for i, (_, a, b) in enumerate(wanted) if a <= b]
            least = [Best(negatives) for _ in fine]
            for held in those:
                between(asked, held, [wanted[i] for i in fine], least)
            lengths = [len(b.score) for b in least]
            which = np.repeat(np.array(fine, np.int64), lengths)
            ids = asked["ids"][[wanted[i][0] for i in which.tolist()]]
            columns = [ids, *(own[c][which] for c in ("anchor", "positive_id", "positive", "positive_score"))]
            columns += [np.concatenate([np.zeros(0, np.int64), *(getattr(b, c) for b in least)]) for c in ("ids", "rows", "score")]
            names = ["anchor_id", "anchor", "positive_id", "positive", "positive_score", "negative_id", "negative", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    schema = "anchor_id long, anchor long, positive_id long, positive long, positive_score long, negative_id long, negative long, negative_score long"
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id", "negative")
    out = tasks.mapInArrow(find_negatives, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.pmod("vec_id", F.lit(50)) == 0)


OP12_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id,
  p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 3
"""
