"""Density clustering of a channel of any size: its minimum spanning tree of mutual reachability, by blocks of points.

Points are dealt into blocks of near ones by the medians of a sample, so that a block's box tells how near another block's
points can be. A task holds two blocks at once: it goes through the other blocks by the distance of their boxes and ends
where none can matter. One such pass gives every point's core distance and a list of its nearest others. Boruvka's rounds
then take every component whose least edge the lists prove, without a distance; only what they leave open is searched for in
passes again, and not from the largest component, which the others join. Components join along these edges by joins of
tables, on the driver once there are few. Edges are in one strict order (weight, then ids), and the weight of an edge is the same number wherever it is
computed, so no round makes a cycle.

Equal points are one place with a weight. The place's least id takes part in the rounds; in the strict order each other
copy is a leaf of the tree, whose one edge follows from what is within the place's core distance.

Two blocks meet by a matrix product in single precision, whose error is bounded: it only tells which pairs can matter, and
those are computed exactly.

What the hierarchy needs of a channel at last is the tree's edges, some 24 bytes a point, no vector: they are condensed in
one task, of MOST_EDGES at most; more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Scratch, load_arrays, save_arrays
from . import density

#: Points of a block (fewer of a small channel, so that there are tasks), points of the sample whose medians split the
#: space, rows of a block that are compared at once, nearest others that are listed for each point.
BLOCK, LEAST_BLOCK, SAMPLE, ROWS, LISTED = 4096, 512, 50_000, 256, 16
#: Edges that one task condenses: 20 million points. Components whose edges the driver follows; more are joined by tables.
MOST_EDGES, MOST_FOLLOWED = 20_000_000, 200_000


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of lists, all of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column) or column.null_count or len(np.unique(np.diff(column.offsets.to_numpy()))) > 1:
        raise ValueError("vectors must be there and of one length")
    return values.reshape(len(column), -1)


def project(vectors: DataFrame, dimension: int | None) -> DataFrame:
    """density.project() of a table vectors(id, x): unit rows, their principal components, unit rows again, as y.

    Sums and products of components are added up in the tasks; the driver gets one d x d matrix from each. Rows that are
    not finite or zero are an error.
    """
    d = vectors.select(F.size("x")).first()
    if d is None:
        return vectors.select("id", F.col("x").cast("array<double>").alias("y"))
    d = d[0]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = density.unit_rows(matrix(batch.column("x")))
                n, total, products = n + len(x), total + x.sum(0), products + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total], pa.list_(pa.float64())), pa.array([products.ravel()], pa.list_(pa.float64()))], ["n", "total", "products"])

    n, total, products = 0, np.zeros(d), np.zeros((d, d))
    for row in vectors.select("x").mapInArrow(moments, "n long, total array<double>, products array<double>").toLocalIterator():
        n, total, products = n + row["n"], total + np.array(row["total"]), products + np.array(row["products"]).reshape(d, d)
    target = min(dimension or d, n - 1, d) if n > 1 else d
    loadings, mean = None, total / max(n, 1)
    if target < d:
        values, found = np.linalg.eigh(products / n - np.outer(mean, mean))
        found = found[:, np.argsort(-values, kind="stable")[:target]].T
        loadings = (found * np.sign(found[np.arange(target), np.abs(found).argmax(1)])[:, None]).T

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = density.unit_rows(matrix(batch.column("x")))
                y = x
                if loadings is not None:
                    # Component by component: equal rows stay equal, which a matrix product does not promise.
                    x, y = np.ascontiguousarray((x - mean).T), np.zeros((len(x), target))
                    for values, loading in zip(x, loadings, strict=True):
                        y += values[:, None] * loading
                length = np.linalg.norm(y, axis=1, keepdims=True)
                y = y / np.where(length > np.finfo(np.float32).eps, length, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(y), pa.list_(pa.float64()))], ["id", "y"])

    return vectors.select("id", "x").mapInArrow(turn, "id long, y array<double>")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, component by component: that of two points is one number whatever else is computed with it."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        total += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(total)


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """distances() of the pairs of columns of a and b, the same numbers."""
    total = np.zeros(a.shape[1])
    for u, v in zip(a, b, strict=True):
        total += (u - v) ** 2
    return np.sqrt(total)


class Near:
    """Which pairs of two blocks can be within a distance: points scaled by a power of two, so that no square overflows."""

    def __init__(self, x: np.ndarray, scale: float):
        self.x, self.scale = np.ascontiguousarray(x.T), scale
        own = x * scale
        self.sq = (own**2).sum(1)
        self.norm = np.sqrt(self.sq)
        self.rows = np.column_stack([own, np.ones(len(x))]).astype(np.float32)
        self.columns = np.ascontiguousarray(np.column_stack([own, -self.sq / 2]).astype(np.float32).T)

    def products(self, some: np.ndarray, other: Near, columns: np.ndarray | None = None) -> np.ndarray:
        """a b - b b / 2: the larger, the nearer b is to a."""
        return self.rows[some] @ (other.columns if columns is None else other.columns[:, columns])

    def slack(self, some: np.ndarray, other: Near) -> np.ndarray:
        """A bound of the products' errors."""
        most = float(other.norm.max(initial=0))
        return 1.3e-7 * (len(self.x) + 6) * (self.norm[some] * most + most**2 / 2 + self.sq[some]) + 1e-30

    def least(self, some: np.ndarray, other: Near, within: np.ndarray) -> np.ndarray:
        """What the product of a pair within these distances reaches at least."""
        far = np.minimum(within * self.scale, 1e15) ** 2
        bound = (self.sq[some] - far) / 2
        return np.where(np.isfinite(within), bound - self.slack(some, other) - 2.4e-7 * np.abs(bound), -np.inf).astype(np.float32)

    def exact(self, a: np.ndarray, other: Near, b: np.ndarray) -> np.ndarray:
        return pair_distances(self.x[:, a], other.x[:, b])


def _to_box(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A bound of the distances of points (or of a box's two corners) to a box, with slack for rounding."""
    gap = np.maximum(np.maximum(low - x[..., -1, :], x[..., 0, :] - high), 0) if x.ndim == 3 else np.maximum(np.maximum(low - x, x - high), 0)
    return np.sqrt((gap**2).sum(-1)) * (1 - 1e-9)


def _cells(sample: np.ndarray, count: int) -> list[tuple[int, float, int, int]]:
    """Splits (component, value, left, right) of the sample's space into `count` cells or some less; a cell is -1 - its number."""
    nodes: list[tuple[int, float, int, int]] = []
    cells = 0

    def split(x: np.ndarray, most: int) -> int:
        nonlocal cells
        wide = int((x.max(0) - x.min(0)).argmax())
        own = x[:, wide]
        middle = float(np.median(own))
        if most > 1 and own.max() > own.min() and not (own < middle).any():
            # Over half of the points share the least value: the others part from them.
            middle = float(own[own > middle].min())
        left = own < middle
        if most < 2 or not left.any():
            cells += 1
            return -cells
        at, share = len(nodes), min(most - 1, max(1, round(most * float(left.mean()))))
        nodes.append((wide, middle, 0, 0))
        nodes[at] = (wide, middle, split(x[left], share), split(x[~left], most - share))
        return at

    root = split(sample, count)
    return nodes if root >= 0 else []


def _cell_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if nodes else []
    while todo:
        node, own = todo.pop()
        wide, middle, left, right = nodes[node]
        below = x[own, wide] < middle
        for child, some in ((left, own[below]), (right, own[~below])):
            if child < 0:
                out[some] = -1 - child
            elif len(some):
                todo.append((child, some))
    return out


class Blocks:
    """The blocks' files in the shared folder, and what is known of each: its number, its size and its box."""

    def __init__(self, points: DataFrame, scratch: Scratch, block: int | None = None):
        """points(id long, y array<double>): a written table with ids of their own. A point may have a weight, for its copies."""
        if "weight" not in points.columns:
            points = points.withColumn("weight", F.lit(1).cast("long"))
        self.folder, self.spark = scratch.path("blocks"), points.sparkSession
        n, self.numbers = points.count(), []
        block = block or min(BLOCK, max(LEAST_BLOCK, -(-n // 48)))
        self.count = n
        if not n:
            return
        sample = points.orderBy(F.xxhash64("id")).limit(SAMPLE).select("y").collect()
        nodes = _cells(np.array([r[0] for r in sample], np.float64), -(-n // block))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = _cell_of(matrix(batch.column("y")), nodes)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("weight"), pa.array(cell)], ["id", "y", "weight", "cell"])

        dealt = scratch.cut(points.select("id", "y", "weight").mapInArrow(deal, "id long, y array<double>, weight long, cell long"), "dealt")
        # A cell that the sample took for smaller than it is, or of equal points, becomes several blocks.
        sizes = dealt.groupBy("cell").count().orderBy("cell").collect()
        parts, first, rows = [], 0, []
        for cell, count in sizes:
            parts.append(-(-count // (2 * block)))
            rows.append((cell, first, parts[-1]))
            first += parts[-1]
        told = self.spark.createDataFrame(rows, "cell long, first long, parts long")
        placed = dealt.join(F.broadcast(told), "cell").select("id", "y", "weight", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int").alias("block"))
        folder = self.folder

        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if own := [b for b in batches if b.num_rows]:
                t = pa.Table.from_batches(own).sort_by("id")
                b, x = t.column("block")[0].as_py(), matrix(t.column("y").combine_chunks())
                save_arrays(folder, f"points-{b}.npz", ids=t.column("id").to_numpy(), x=x, weight=t.column("weight").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.min(0)], pa.list_(pa.float64())), pa.array([x.max(0)], pa.list_(pa.float64()))], ["block", "low", "high"])

        made = placed.repartitionById(max(first, 1), F.col("block")).mapInArrow(save, "block int, low array<double>, high array<double>").collect()
        made = sorted((r["block"], r["low"], r["high"]) for r in made)
        self.numbers = [b for b, _, _ in made]
        self.low, self.high = (np.array([r[k] for r in made]) for k in (1, 2))
        most = float(np.abs([self.low, self.high]).max())
        self.scale = 2.0 ** -int(np.clip(np.ceil(np.log2(most)), -1000, 1000)) if most > 0 else 1.0

    def tasks(self) -> DataFrame:
        return self.spark.range(0, len(self.numbers), 1, max(1, len(self.numbers)))

    def load(self, i: int, *more: str) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for kind in ("points", *more):
            out |= load_arrays(self.folder, f"{kind}-{self.numbers[i]}.npz")
        return out

    def others(self, i: int) -> list[tuple[float, int]]:
        """(distance of the boxes, block) of all other blocks, the nearest first."""
        gap = np.sqrt((np.maximum(np.maximum(self.low - self.high[i], self.low[i] - self.high), 0) ** 2).sum(1)) * (1 - 1e-9)
        return [(float(gap[j]), int(j)) for j in np.argsort(gap, kind="stable") if j != i]

    def for_each(self, run, schema: str) -> DataFrame:
        """run(block) -> record batch or None, of every block, one in a task."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    if (found := run(i)) is not None:
                        yield found

        return self.tasks().mapInArrow(each, schema)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "spark"}


def core_distances(blocks: Blocks, k: int, listed: int = 0) -> None:
    """Writes every block's core distances: of each point that to its k-th nearest other, its copies among them.

    With `listed`, also its nearest others but copies, as many: their distances `far`, their blocks `there` and rows `row` (-1: none).
    """
    most = max(k, listed)

    def run(i: int) -> pa.RecordBatch:
        mine = blocks.load(i)
        x = mine["x"]
        own, heavy = Near(x, blocks.scale), np.zeros((len(x), most), np.int64)
        best, there, place = np.full((len(x), most), np.inf), np.full((len(x), most), -1, np.int32), np.full((len(x), most), -1, np.int32)

        def meet(rows: np.ndarray, other: Near, weight: np.ndarray, j: int) -> None:
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                g = own.products(some, other)
                least = own.least(some, other, best[some, -1])
                if (open_ := np.flatnonzero(np.isinf(best[some, -1]))).size:
                    # No bound yet: what can be among the nearest of this block. The point itself may be one of them.
                    m = min(most + 1, g.shape[1])
                    least[open_] = np.partition(g[open_], g.shape[1] - m, axis=1)[:, g.shape[1] - m] - 2 * own.slack(some[open_], other).astype(np.float32)
                r, c = np.divmod(np.flatnonzero(g >= least[:, None]), g.shape[1])
                if i == j:
                    r, c = r[some[r] != c], c[some[r] != c]
                d = own.exact(some[r], other, c)
                near = d < best[some[r], -1]
                r, c, d = r[near], c[near], d[near]
                order = np.lexsort((c, d, r))
                r, c, d = r[order], c[order], d[order]
                touched, first, of = np.unique(r, return_index=True, return_inverse=True)
                if not len(touched):
                    continue
                rank = np.arange(len(r)) - first[of]
                fine = rank < most
                new, col = np.full((len(touched), most), np.inf), np.full((len(touched), most), -1, np.int32)
                new[of[fine], rank[fine]], col[of[fine], rank[fine]] = d[fine], c[fine]
                at_ = some[touched]
                both = np.concatenate([best[at_], new], axis=1)
                pick = np.argsort(both, axis=1, kind="stable")[:, :most]
                best[at_] = np.take_along_axis(both, pick, 1)
                heavy[at_] = np.take_along_axis(np.concatenate([heavy[at_], np.where(col < 0, 0, weight[col])], axis=1), pick, 1)
                if listed:
                    there[at_] = np.take_along_axis(np.concatenate([there[at_], np.where(col < 0, -1, j).astype(np.int32)], axis=1), pick, 1)
                    place[at_] = np.take_along_axis(np.concatenate([place[at_], col], axis=1), pick, 1)

        meet(np.arange(len(x)), own, mine["weight"], i)
        for gap, j in blocks.others(i):
            if gap >= best[:, -1].max():
                break
            rows = np.flatnonzero(_to_box(x, blocks.low[j], blocks.high[j]) < best[:, -1])
            if len(rows):
                held = blocks.load(j)
                meet(rows, Near(held["x"], blocks.scale), held["weight"], j)
        # Fewer other points than k: the farthest there is.
        met = np.cumsum(np.column_stack([mine["weight"] - 1, heavy]), axis=1)
        core = np.where((np.column_stack([np.zeros(len(x), int), met[:, :-1]]) < k) & np.isfinite(both := np.column_stack([np.zeros(len(x)), best])), both, 0).max(1)
        save_arrays(blocks.folder, f"core-{blocks.numbers[i]}.npz", core=core)
        if listed:
            save_arrays(blocks.folder, f"list-{blocks.numbers[i]}.npz", far=best, there=there, row=place)
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32())], ["made"])

    blocks.for_each(run, "made int").count()


def core_table(blocks: Blocks) -> DataFrame:
    """(id, core) of all points, after core_distances()."""

    def run(i: int) -> pa.RecordBatch:
        own = blocks.load(i, "core")
        return pa.RecordBatch.from_arrays([pa.array(own["ids"]), pa.array(own["core"])], ["id", "core"])

    return blocks.for_each(run, "id long, core double")


_FOUND = "comp long, w double, low long, high long, other long"


def proven_edges(blocks: Blocks, kind: str | None) -> DataFrame:
    """nearest_others() of those components whose least edge the lists of core_distances() prove.

    An edge that a point's list lacks weighs no less than the list's last distance and the point's core distance: an edge
    that weighs less than this for all points of its component is the least one.
    """

    def run(i: int) -> pa.RecordBatch:
        own = blocks.load(i, "core", "list", *([kind] if kind else []))
        ids, core, there, row = own["ids"], own["core"], own["there"], own["row"]
        comp = own["comp"] if kind else ids
        partner, theirs, reach = np.zeros(there.shape, np.int64), np.broadcast_to(comp[:, None], there.shape).copy(), np.full(there.shape, np.inf)
        for j in np.unique(there[there >= 0]).tolist():
            held = own if j == i else blocks.load(j, "core", *([kind] if kind else []))
            at = there == j
            partner[at], theirs[at], reach[at] = held["ids"][row[at]], (held["comp"] if kind else held["ids"])[row[at]], held["core"][row[at]]
        w = np.maximum(np.maximum(own["far"], core[:, None]), reach)
        w[theirs == comp[:, None]] = np.inf
        unseen = np.maximum(own["far"][:, -1], core)  # infinite where the list has all other points
        low, high = np.minimum(ids[:, None], partner), np.maximum(ids[:, None], partner)
        kinds, of = np.unique(comp, return_inverse=True)
        every = np.repeat(of, w.shape[1])
        order = np.lexsort((high.ravel(), low.ravel(), w.ravel(), every))
        first = order[np.concatenate([[True], every[order][1:] != every[order][:-1]])]
        bound = np.full(len(kinds), np.inf)
        np.minimum.at(bound, of, unseen)
        values = [kinds, *(v.ravel()[first] for v in (w, low, high, theirs)), bound]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["comp", "w", "low", "high", "other", "bound"])

    found = blocks.for_each(run, f"{_FOUND}, bound double")
    least = found.groupBy("comp").agg(F.min(F.struct("w", "low", "high", "other")).alias("e"), F.min("bound").alias("bound"))
    return least.where(F.col("e.w") < F.col("bound")).select("comp", "e.*")


def copy_edges(blocks: Blocks) -> DataFrame:
    """(place, to, w): where each copy of the places with a weight over 1 is tied to, after core_distances().

    An edge of a copy weighs the core distance at least, and that much to all that are within it and have no larger one: the
    least id of them, or of the place, is the other end.
    """

    def run(i: int) -> pa.RecordBatch | None:
        own = blocks.load(i, "core", "list")
        some = np.flatnonzero(own["weight"] > 1)
        if not len(some):
            return None
        x, core, far, there, row, to = own["x"][some], own["core"][some], own["far"][some], own["there"][some], own["row"][some], own["ids"][some].copy()
        for j in np.unique(there[there >= 0]).tolist():
            held = own if j == i else blocks.load(j, "core")
            r, c = np.nonzero((there == j) & (far <= core[:, None]))
            q = row[r, c]
            fine = held["core"][q] <= core[r]
            np.minimum.at(to, r[fine], held["ids"][q[fine]])
        # So many are just as far that the list may lack some.
        if (open_ := np.flatnonzero(far[:, -1] <= core)).size:
            for gap, j in [(0.0, i), *blocks.others(i)]:
                if gap > core[open_].max():
                    break
                rows = open_[_to_box(x[open_], blocks.low[j], blocks.high[j]) <= core[open_]]
                held = own if j == i else blocks.load(j, "core") if len(rows) else None
                for at in range(0, len(rows), ROWS):
                    a = rows[at : at + ROWS]
                    fine = (distances(x[a], held["x"]) <= core[a, None]) & (held["core"][None, :] <= core[a, None])
                    r, c = np.nonzero(fine)
                    np.minimum.at(to, a[r], held["ids"][c])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (own["ids"][some], to, core)], ["place", "to", "w"])

    return blocks.for_each(run, "place long, to long, w double")


def nearest_others(blocks: Blocks, kind: str | None, single: dict[int, int], skipped: int | None = None) -> DataFrame:
    """Of every component but `skipped` the least edge to another: comp, w, low, high (the points' ids), other (the component).

    kind names the blocks' files of components, none if each point is one. single: the component of blocks that have one.
    """

    def comps(held: dict[str, np.ndarray]) -> np.ndarray:
        return held["comp"] if kind else held["ids"]

    names = ("core", kind) if kind else ("core",)

    def run(i: int) -> pa.RecordBatch | None:
        if skipped is not None and single.get(i) == skipped:
            return None
        own = blocks.load(i, *names)
        asked = np.flatnonzero(comps(own) != skipped) if skipped is not None else np.arange(len(own["ids"]))
        if not len(asked):
            return None
        # Rows are those of the components that are asked for; as columns all points of a block count.
        x, ids, core = own["x"][asked], own["ids"][asked], own["core"][asked]
        near = Near(x, blocks.scale)
        kinds, of = np.unique(comps(own)[asked], return_inverse=True)
        w, low, high, other = np.full(len(kinds), np.inf), *(np.full(len(kinds), np.iinfo(np.int64).max) for _ in range(2)), np.zeros(len(kinds), np.int64)

        def update(a: np.ndarray, d: np.ndarray, held: dict[str, np.ndarray], q: np.ndarray) -> None:
            """Takes the edges of rows a and points q of a block, at distances d."""
            least = np.maximum(np.maximum(d, core[a]), held["core"][q])
            fine = least <= w[of[a]]
            a, q, least = a[fine], q[fine], least[fine]
            if not len(a):
                return
            lo, hi = np.minimum(ids[a], held["ids"][q]), np.maximum(ids[a], held["ids"][q])
            order = np.lexsort((hi, lo, least, of[a]))
            first = order[np.concatenate([[True], of[a][order][1:] != of[a][order][:-1]])]
            c = of[a][first]
            better = np.array([(p, s, t) < (u, v, z) for p, s, t, u, v, z in zip(least[first], lo[first], hi[first], w[c], low[c], high[c], strict=True)], bool)
            first, c = first[better], c[better]
            w[c], low[c], high[c], other[c] = least[first], lo[first], hi[first], comps(held)[q[first]]

        def meet(rows: np.ndarray, held: dict[str, np.ndarray], theirs: Near) -> None:
            comp = comps(held)
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                some = some[core[some] <= w[of[some]]]
                if not len(some):
                    continue
                g = near.products(some, theirs)
                if (open_ := np.flatnonzero(np.isinf(w[of[some]]))).size:
                    # A first edge for each component that has none.
                    apart = np.where(comp[None, :] == kinds[of[some[open_]], None], -np.inf, g[open_])
                    q = apart.argmax(1)
                    has = np.isfinite(apart[np.arange(len(q)), q])
                    a, q = some[open_][has], q[has]
                    update(a, near.exact(a, theirs, q), held, q)
                lim = w[of[some]]
                r, c = np.divmod(np.flatnonzero(g >= near.least(some, theirs, lim)[:, None]), g.shape[1])
                fine = (comp[c] != kinds[of[some[r]]]) & (held["core"][c] <= lim[r])
                r, c = r[fine], c[fine]
                update(some[r], near.exact(some[r], theirs, c), held, c)

        if len(np.unique(comps(own))) > 1:
            meet(np.arange(len(x)), own, Near(own["x"], blocks.scale))
        for gap, j in blocks.others(i):
            if gap > w.max():
                break
            # An edge is as long as a core distance and as the way to the box; equal ones count for the order of ids.
            fine = (_to_box(x, blocks.low[j], blocks.high[j]) <= w[of]) & (core <= w[of])
            if j in single:
                fine &= kinds[of] != single[j]
            rows = np.flatnonzero(fine)
            if len(rows):
                held = blocks.load(j, *names)
                meet(rows, held, Near(held["x"], blocks.scale))
        fine = np.isfinite(w)
        return pa.RecordBatch.from_arrays([pa.array(v[fine]) for v in (kinds, w, low, high, other)], ["comp", "w", "low", "high", "other"])

    found = blocks.for_each(run, _FOUND)
    least = found.groupBy("comp").agg(F.min(F.struct("w", "low", "high", "other")).alias("e"))
    return least.select("comp", "e.*")


def joined(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(comp, root) by the edges comp -> other, of which a component has one or none: they lead to a pair of components that
    point at each other, or to one without an edge, which has no row."""
    back = edges.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    now = edges.select("comp", "other").join(back, "other", "left").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("root"))
    now = scratch.cut(now, "roots")
    while True:
        ahead = now.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        onward = F.coalesce("next", "root")
        then = scratch.cut(now.join(ahead, "root", "left").select("comp", onward.alias("root"), (onward != F.col("root")).alias("moved")), "roots")
        now = then.select("comp", "root")
        if not then.where("moved").limit(1).count():
            return now


def followed(comp: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The roots of comp, in ascending order, as joined() has them."""
    at = np.searchsorted(comp, other)
    has = comp[np.minimum(at, len(comp) - 1)] == other
    at = np.where(has, at, 0)
    end = has & (other[at] == comp) & (comp < other)
    # Places of the roots: those without an edge come after the others.
    names, extra = np.unique(other[~has], return_inverse=True)
    to = np.where(end, np.arange(len(comp)), at)
    to[~has] = len(comp) + extra
    to = np.concatenate([to, np.arange(len(comp), len(comp) + len(names))])
    while not np.array_equal(then := to[to], to):
        to = then
    return np.concatenate([comp, names])[to[: len(comp)]]


def spanning_tree(points: DataFrame, scratch: Scratch, min_samples: int = 3, block: int | None = None) -> DataFrame:
    """(low, high, w): the n - 1 edges of the minimum spanning tree of points(id, y), a written table, by mutual reachability."""
    spark = points.sparkSession
    places = scratch.cut(points.groupBy("y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "places")
    blocks = Blocks(places, scratch, block)
    if not blocks.numbers:
        return spark.createDataFrame([], "low long, high long, w double")
    core_distances(blocks, min_samples, LISTED)
    copies = points.join(places.where("weight > 1").select("y", F.col("id").alias("place")), "y").where("id <> place").select("id", "place")
    tied = copies.join(copy_edges(blocks), "place")
    tree = scratch.cut(tied.select(F.least("id", "to").alias("low"), F.greatest("id", "to").alias("high"), "w"), "copies")
    kind, single = None, {}
    components, lists, turn = blocks.count, True, 0
    while components > 1:
        if lists:
            found = proven_edges(blocks, kind)
        else:
            # The largest component may hold nearly all points; the others' edges join them to it.
            found = nearest_others(blocks, kind, single, _largest(blocks, kind))
        edges = scratch.cut(found, "nearest")
        n = edges.count()
        # Two components that point at each other have one edge. Few components' edges are followed on the driver.
        few = edges.select("comp", "other").orderBy("comp").toArrow() if n <= MOST_FOLLOWED else None
        if not n:
            count = 0
        elif few is not None:
            comp, other = (few.column(c).to_numpy() for c in ("comp", "other"))
            at = np.minimum(np.searchsorted(comp, other), n - 1)
            count = n - int(((comp[at] == other) & (other[at] == comp)).sum()) // 2
        else:
            count = edges.select("low", "high").distinct().count()
        # Lists that hardly prove an edge any more are left.
        if not count and not lists:
            raise RuntimeError(f"{components} components without an edge")
        lists = lists and count > components // 16
        if not count:
            continue
        components -= count
        tree = tree.unionByName(edges.select("low", "high", "w").distinct())
        if components > 1:
            then, turn = f"comps{turn}", turn + 1
            if few is not None:
                save_arrays(blocks.folder, f"roots-{then}.npz", comp=comp, root=followed(comp, other))
                single = _renamed(blocks, kind, then)
            else:
                single = _spread(blocks, kind, joined(edges, scratch), then)
            kind = then
    return tree


def _largest(blocks: Blocks, kind: str | None) -> int:
    def sizes(i: int) -> pa.RecordBatch:
        own = blocks.load(i, *([kind] if kind else []))
        return pa.RecordBatch.from_arrays([pa.array(v) for v in np.unique(own["comp" if kind else "ids"], return_counts=True)], ["comp", "n"])

    return blocks.for_each(sizes, "comp long, n long").groupBy("comp").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "comp").first()["comp"]


_SAVED = "block int, single long"


def _saved(blocks: Blocks, i: int, comp: np.ndarray, kind: str) -> pa.RecordBatch:
    save_arrays(blocks.folder, f"{kind}-{blocks.numbers[i]}.npz", comp=comp)
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([int(comp[0]) if (comp == comp[0]).all() else None], pa.int64())], ["block", "single"])


def _renamed(blocks: Blocks, kind: str | None, then: str) -> dict[int, int]:
    """_spread() by a file of the roots."""

    def run(i: int) -> pa.RecordBatch:
        own, roots = blocks.load(i, *([kind] if kind else [])), load_arrays(blocks.folder, f"roots-{then}.npz")
        comp = own["comp" if kind else "ids"]
        at = np.minimum(np.searchsorted(roots["comp"], comp), len(roots["comp"]) - 1)
        return _saved(blocks, i, np.where(roots["comp"][at] == comp, roots["root"][at], comp), then)

    return {r["block"]: r["single"] for r in blocks.for_each(run, _SAVED).collect() if r["single"] is not None}


def _spread(blocks: Blocks, kind: str | None, roots: DataFrame, then: str) -> dict[int, int]:
    """Writes the components of kind under their roots(comp, root); (block: component) of those that have one only."""

    def where(i: int) -> pa.RecordBatch:
        own = blocks.load(i, *([kind] if kind else []))
        return pa.RecordBatch.from_arrays([pa.array(own["ids"]), pa.array(own["comp" if kind else "ids"]), pa.array(np.full(len(own["ids"]), i, np.int32))], ["id", "comp", "block"])

    # A component may hold most points: the join on it splits or broadcasts, as roots have each component once.
    placed = blocks.for_each(where, "id long, comp long, block int").join(roots, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"), "block")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own := [b for b in batches if b.num_rows]:
            t = pa.Table.from_batches(own).sort_by("id")
            yield _saved(blocks, t.column("block")[0].as_py(), t.column("comp").to_numpy(), then)

    made = placed.repartitionById(len(blocks.numbers), F.col("block")).mapInArrow(save, _SAVED).collect()
    return {r["block"]: r["single"] for r in made if r["single"] is not None}


def cluster(points: DataFrame, parameters: density.Parameters | None = None, block: int | None = None) -> DataFrame:
    """(id, label, probability) of points(id long, y array<double>): what density.cluster() says of them; -1 is noise.

    ids must differ. A single point is noise, no point gives an empty table.
    """
    spark, p = points.sparkSession, parameters or density.Parameters()
    with Scratch(spark) as scratch:
        points = scratch.cut(points.select("id", "y"), "points")
        tree = spanning_tree(points, scratch, p.min_samples, block)
        n = points.count()
        if n > MOST_EDGES:
            raise ValueError(f"{n} points exceed {MOST_EDGES}")

        def condense(table: pa.Table) -> pa.Table:
            low, high, w, ids = (table.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high", "w", "id"))
            ids = np.sort(ids[np.isnan(w)].astype(np.int64))
            edge = np.flatnonzero(~np.isnan(w))
            low, high, w = low[edge].astype(np.int64), high[edge].astype(np.int64), w[edge]
            order = np.lexsort((high, low, w))
            rows = np.column_stack([np.searchsorted(ids, low[order]), np.searchsorted(ids, high[order]), w[order]])
            labels, probability = density.labels_of(rows, len(ids), p)
            return pa.table({"id": ids, "label": labels.astype(np.int32), "probability": probability})

        nan, none = F.lit(float("nan")), F.lit(-1).cast("long")
        rows = tree.select("low", "high", "w", none.alias("id")).unionByName(points.select(none.alias("low"), none.alias("high"), nan.alias("w"), "id"))
        found = rows.withColumn("run", F.lit(0)).groupBy("run").applyInArrow(condense, "id long, label int, probability double")
        return scratch.keep(found, "labels")


def cluster_table(vectors: DataFrame, dimension: int | None = 8, parameters: density.Parameters | None = None, block: int | None = None) -> DataFrame:
    """cluster() of vectors(id, x) after project()."""
    return cluster(project(vectors, dimension), parameters, block)
