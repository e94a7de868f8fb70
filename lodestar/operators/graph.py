"""Approximate filtered recall over layered small-world graphs, one for each shard of a channel.

The index is a table with a row for each shard: the shard's vectors, what filters and hits need of their rows, and the
links of every layer. A search is a scan of that table without a shuffle: the filter is a Spark expression over the rows'
payload, and each task walks its shards' graphs from layer to layer. The walk goes through rows that the filter leaves
out, so that a narrow filter does not tear the graph, but only admitted rows are found.

Reading is what an exact scan reads; saved are the distances: some hundred a shard and query instead of all. Where a
filter admits no more rows of a shard than the walk keeps, all of them are compared and the search is exact.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vector

#: Links of a row (twice as many on the lowest layer), rows looked at for its links, and rows that a walk keeps.
LINKS, CONSTRUCTION, KEPT = 16, 200, 128
#: Vectors of a shard; a shard's similarities are held at once, 64 MB.
SHARD = 4096
#: Shards of a file of a written index: a reader takes all rows of a file up to 4,096 at once, and a shard's row is long.
FILE_SHARDS = 4


def layers(ids: list[str], links: int = LINKS) -> np.ndarray:
    """The highest layer of each row: by its id, so that every run builds one graph."""
    draw = np.array([zlib.crc32(i.encode()) for i in ids], np.float64)
    return np.floor(-np.log((draw + 1) / 2**32) / math.log(links)).astype(np.int32)


def _looked_at(some: np.ndarray, far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the columns looked at, `most` of all at most and as many of `far`, nearest first, and their similarities; -inf where there are fewer."""
    near, value = [], []
    # Blocks of rows stay in the processor's cache.
    for at in range(0, len(some), 256):
        block, picked = some[at : at + 256], []
        for part, columns in ((block, None), (block[:, far], far)):
            if k := min(most, part.shape[1]):
                top = np.argpartition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k :]
                picked.append(top if columns is None else columns[top])
        columns = np.sort(np.concatenate(picked, axis=1), axis=1)
        similar = np.take_along_axis(block, columns, axis=1)
        similar[:, 1:][columns[:, 1:] == columns[:, :-1]] = -np.inf
        order = np.argsort(-similar, axis=1, kind="stable")
        near.append(np.take_along_axis(columns, order, axis=1))
        value.append(np.take_along_axis(similar, order, axis=1))
    return np.concatenate(near), np.concatenate(value)


def _diverse(near: np.ndarray, value: np.ndarray, cosine: np.ndarray, most: int) -> np.ndarray:
    """For each row up to `most` of its candidates (of `near`, by falling similarities `value`), -1 beyond: nearest first, but none nearer to a chosen one than to the row.

    Left-over places go to the nearest that were passed over.
    """
    chosen, count = np.full((len(near), most), -1), np.zeros(len(near), int)
    passed, rows = np.zeros(near.shape, bool), np.arange(len(near))
    for r in range(near.shape[1]):
        # Rows that have all their links, or no candidate left, are done.
        rows = rows[(count[rows] < most) & (value[rows, r] > -np.inf)]
        if not len(rows):
            break
        c, own = near[rows, r], chosen[rows, :r]
        held = np.where(own >= 0, cosine[c[:, None], own], -np.inf).max(1, initial=-np.inf)
        fine = held < value[rows, r]
        chosen[rows[fine], count[rows[fine]]] = c[fine]
        count[rows[fine]] += 1
        passed[rows[~fine], r] = True
    for i in np.flatnonzero(count < most).tolist():
        left = near[i][passed[i]][: most - count[i]]
        chosen[i, count[i] : count[i] + len(left)] = left
    return chosen


def _joined(some: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Further links by which every row is reached from the first: again and again the nearest pair of a reached row and one that is not."""
    reached = np.zeros(len(links), bool)

    def spread(start: int) -> np.ndarray:
        found, last = [], np.array([start])
        while len(last):
            reached[last] = True
            found.append(last)
            last = np.unique(links[last])
            last = last[(last >= 0) & ~reached[last]]
        return np.concatenate(found)

    more, new = [], np.sort(spread(0))
    outside = np.flatnonzero(~reached)
    # For each row outside the nearest reached one, the first of equal ones; a row that is reached is compared once.
    best, who = np.full(len(outside), -np.inf, some.dtype), np.full(len(outside), len(links))
    while len(outside):
        similar = some[np.ix_(new, outside)]
        at = similar.argmax(0)
        similar, at = similar[at, np.arange(len(outside))], new[at]
        better = (similar > best) | ((similar == best) & (at < who)) | (who == len(links))
        best[better], who[better] = similar[better], at[better]
        b = int(best.argmax())
        if len(equal := np.flatnonzero(best == best[b])) > 1:
            b = int(equal[who[equal].argmin()])
        more.append((int(who[b]), int(outside[b])))
        new = np.sort(spread(int(outside[b])))
        left = ~reached[outside]
        outside, best, who = outside[left], best[left], who[left]
    return more


def layer_links(cosine: np.ndarray, own: np.ndarray, most: int, above: np.ndarray, looked_at: int = CONSTRUCTION) -> tuple[np.ndarray, np.ndarray]:
    """The links of one layer's rows, as pairs in order: diverse neighbours, both ways, the nearest 2 * most; every row can be reached.

    Half of the rows looked at are the nearest of the layer, half the nearest of the layer `above`, which lie farther off
    and tie groups of near rows together. The diagonal of `cosine` is -inf.
    """
    if len(own) < 2:
        return own[:0], own[:0]
    n = len(own)
    some = cosine if n == len(cosine) else cosine[np.ix_(own, own)]
    near, value = _looked_at(some, np.flatnonzero(np.isin(own, above)), looked_at // 2)
    k = min(looked_at, n - 1)
    picked = _diverse(near[:, :k], value[:, :k], some, min(most, k))
    i, r = np.nonzero(picked >= 0)
    j = picked[i, r]
    a, b = np.divmod(np.unique(np.concatenate([i * n + j, j * n + i])), n)
    order = np.lexsort((b, -some[a, b], a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    a, b, rank = (v[rank < 2 * most] for v in (a, b, rank))
    links = np.full((n, 2 * most), -1)
    links[a, rank] = b
    if more := np.array(_joined(some, links)).reshape(-1, 2).T.astype(int).tolist():
        # These go beyond the bound; they come after the others, in the order in which they were found.
        inside, outside = (np.array(m, int) for m in more)
        pairs = np.stack([inside, outside, outside, inside], 1).reshape(-1, 2)
        a, b = np.concatenate([a, pairs[:, 0]]), np.concatenate([b, pairs[:, 1]])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
    return own[a], own[b]


class Graph:
    """One shard's graph: unit vectors, and the links of each layer as starts and targets."""

    def __init__(self, x: np.ndarray, starts: np.ndarray, targets: np.ndarray):
        self.x = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.starts, self.targets = starts.reshape(-1, len(x) + 1), targets
        top = np.diff(self.starts[-1])
        self.entry = int(top.argmax()) if top.any() else 0

    @staticmethod
    def build(x: np.ndarray, ids: list[str], links: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
        """(starts, targets) of all layers, the lowest first."""
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        cosine, high = unit @ unit.T, layers(ids, links)
        np.fill_diagonal(cosine, -np.inf)
        starts, targets, n = [], [], 0
        for layer in range(int(high.max()) + 1):
            own = np.flatnonzero(high >= layer)
            if layer and len(own) < 2:
                break
            rows, found = layer_links(cosine, own, links, np.flatnonzero(high > layer))
            starts.append(n + np.searchsorted(rows, np.arange(len(x) + 1)))
            targets.append(found)
            n += len(found)
        return np.concatenate(starts).astype(np.int32), np.concatenate(targets).astype(np.int32)

    def near(self, layer: int, i: int) -> np.ndarray:
        return self.targets[self.starts[layer, i] : self.starts[layer, i + 1]]

    def search(self, query: np.ndarray, admitted: np.ndarray, kept: int) -> list[int]:
        """Up to `kept` admitted rows, the best first, near the query (of length one).

        A layer's walk starts at the best of the layer above, LINKS of them, so that groups of rows far apart are all met.
        """
        if np.count_nonzero(admitted) <= kept:
            # The walk would go to the end and find them all.
            own = np.flatnonzero(admitted)
            return own[np.argsort(-(self.x[own] @ query), kind="stable")].tolist()
        every, at = np.ones(len(self.x), bool), [self.entry]
        for layer in range(len(self.starts) - 1, 0, -1):
            at = self._walk(layer, at, query, every, LINKS)
        return self._walk(0, at, query, admitted, kept)

    def _walk(self, layer: int, at: list[int], query: np.ndarray, admitted: np.ndarray, kept: int) -> list[int]:
        seen = np.zeros(len(self.x), bool)
        seen[at] = True
        todo = [(-s, i) for i, s in zip(at, (self.x[at] @ query).tolist(), strict=True)]
        heapq.heapify(todo)
        found = [(-s, -i) for s, i in todo if admitted[i]]
        heapq.heapify(found)
        while todo:
            away, i = heapq.heappop(todo)
            if len(found) >= kept and -away < found[0][0]:
                break
            near = self.near(layer, i)
            near = near[~seen[near]]
            seen[near] = True
            for j, s in zip(near.tolist(), (self.x[near] @ query).tolist(), strict=True):
                if len(found) < kept or s > found[0][0]:
                    heapq.heappush(todo, (-s, j))
                    if admitted[j]:
                        (heapq.heappush if len(found) < kept else heapq.heapreplace)(found, (s, -j))
        return [-j for _, j in sorted(found, reverse=True)]


def index(vectors: DataFrame, shard: int = SHARD, links: int = LINKS) -> DataFrame:
    """A row for each shard of vectors(embedding_type, embedding_id, embedding, ..): embedding_type, shard, payload, x, starts, targets.

    payload has all other columns, which filters may use. Invalid vectors are left out; a channel's must have one length.
    Write the result once, FILE_SHARDS rows a file, and search that: each search of an unwritten index would build it
    again. A channel is dealt over shards by its embedding_ids, so that no channel or shard is larger than others,
    whatever their numbers.
    """
    fine = vectors.where(vector.is_valid("embedding"))
    # Channels are few: their numbers of shards are broadcast.
    sizes = fine.groupBy("embedding_type").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("_shards"))
    dealt = fine.join(F.broadcast(sizes), "embedding_type").withColumn("shard", F.pmod(F.xxhash64("embedding_id"), "_shards").cast("int"))
    payload = F.struct(*[c for c in vectors.columns if c not in ("embedding", "embedding_type")])
    rows = dealt.select("embedding_type", "shard", payload.alias("payload"), "embedding")

    def one(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = table.column("payload").combine_chunks()
        ids = own.field("embedding_id").to_pylist()
        order = np.argsort(np.array(ids), kind="stable")
        table, own = table.take(order), own.take(order)
        flat = table.column("embedding").combine_chunks().flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)
        starts, targets = Graph.build(x, [ids[i] for i in order], links)
        whole = pa.array([0, len(x)], pa.int32())
        columns = [
            table.column("embedding_type")[:1].combine_chunks(), table.column("shard")[:1].combine_chunks(), pa.ListArray.from_arrays(whole, own),
            pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), pa.array([starts], pa.list_(pa.int32())), pa.array([targets], pa.list_(pa.int32())),
        ]
        return pa.table(columns, ["embedding_type", "shard", "payload", "x", "starts", "targets"])

    schema = T.StructType([
        *rows.select("embedding_type", "shard").schema, T.StructField("payload", T.ArrayType(rows.schema["payload"].dataType)),
        T.StructField("x", T.ArrayType(rows.schema["embedding"].dataType.elementType)),
        T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("targets", T.ArrayType(T.IntegerType())),
    ])
    return rows.groupBy("embedding_type", "shard").applyInArrow(one, schema)


def recall(index: DataFrame, queries: DataFrame, limit: int, admit: Callable[[Column], Column] | None = None, kept: int = KEPT) -> DataFrame:
    """recall_each() with one filter or none, without its number."""
    return recall_each(index, queries, limit, [admit or (lambda _: F.lit(True))], kept).drop("filter_no")


def recall_each(index: DataFrame, queries: DataFrame, limit: int, admits: list[Callable[[Column], Column]], kept: int = KEPT) -> DataFrame:
    """search.recall() over an index() under each of some filters, in one scan: up to `limit` hits of queries(query_no, embedding_type, weight, query), about the best.

    A filter tells from a row's payload whether it may be found; rows for which it is null may not. filter_no is its place
    in `admits`, from 0. The score is the exact cosine in double precision; ranks go by it, then embedding_id. A query that
    is invalid or of another length than its channel's vectors finds nothing. There may be vector.MOST_BROADCAST queries at
    most; give more in parts.
    """
    asked = queries.select("query_no", "embedding_type", "weight", "query").limit(vector.MOST_BROADCAST + 1).collect()
    if len(asked) > vector.MOST_BROADCAST:
        raise ValueError(f"more than {vector.MOST_BROADCAST} queries")
    own: dict[str, list[tuple[int, np.ndarray]]] = {}
    for r in asked:
        q = np.array([np.nan if v is None else v for v in r["query"] or []], np.float64)
        if len(q) and np.isfinite(q).all() and q.any():
            own.setdefault(r["embedding_type"], []).append((r["query_no"], q))
    kept = max(kept, limit)
    hit = F.transform("payload", lambda p: F.struct(p["embedding_id"].alias("embedding_id"), p["asset_id"].alias("asset_id"), p["embedding_revision"].alias("embedding_revision")))
    flags = F.array(*[F.transform("payload", lambda p: F.coalesce(admit(p), F.lit(False))) for admit in admits])
    rows = index.where(F.col("embedding_type").isin(list(own))).select("embedding_type", "x", "starts", "targets", hit.alias("hit"), flags.alias("admitted"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                kind = batch.column("embedding_type")[i].as_py()
                x, starts, targets = (batch.column(c)[i].values.to_numpy() for c in ("x", "starts", "targets"))
                hits, filters = batch.column("hit")[i].values, [f.values.to_numpy(zero_copy_only=False) for f in batch.column("admitted")[i]]
                x = x.astype(np.float64).reshape(len(hits), -1)
                graph = Graph(x, starts, targets)
                for (number, q), (at, admitted) in itertools.product(own[kind], enumerate(filters)):
                    if len(q) != x.shape[1] or not admitted.any():
                        continue
                    nodes = graph.search(q / np.linalg.norm(q), admitted, kept)[:kept]
                    score = np.clip(x[nodes] @ q / (np.linalg.norm(x[nodes], axis=1) * np.linalg.norm(q)), -1, 1)
                    numbers = [pa.array(np.full(len(nodes), n, np.int32)) for n in (at, number)]
                    yield pa.RecordBatch.from_arrays([*numbers, hits.take(pa.array(nodes)), pa.array(score)], ["filter_no", "query_no", "hit", "score"])

    found = rows.mapInArrow(walk, f"filter_no int, query_no int, hit {rows.schema['hit'].dataType.elementType.simpleString()}, score double")
    order = Window.partitionBy("filter_no", "query_no").orderBy(F.desc("score"), "embedding_id")
    ranked = found.select("filter_no", "query_no", "hit.*", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    told = queries.select(F.col("query_no").cast("int"), "embedding_type", "weight")
    return ranked.join(F.broadcast(told), "query_no")
