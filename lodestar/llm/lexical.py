"""Ranked lexical search over variable blocks of postings.

The index is a table of postings by shard and term: the documents that hold the term, what each occurrence adds to a score
but for the term's weight (the impact), and blocks with the largest impact of each. A shard is some consecutive documents
of a scan task. Where a posting list is split into blocks is chosen by dynamic programming: of all partitions into blocks
of up to LONGEST postings the one with the least sum, over its blocks, of the bound's errors (largest impact less each
posting's impact) and a fixed cost. Runs of low impacts so get low bounds of their own, which fixed blocks would not have.

A search reads the lists of its terms only and works shard by shard. The blocks' largest impacts, times the terms' weights,
add up to a bound for every document of the shard. Documents whose bound does not reach the score of the last result so far
are skipped with their blocks; of the others those are scored whose own terms' bounds reach it (the pivot test). Results are
exact: what is skipped cannot be among them. A first wave of a few shards gives every query a score that its last result
must reach, so that the other shards return few rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

#: Results of a query.
K = 50
#: Bytes of text and documents of a shard, at most (but for a longer text, which is a shard by itself).
SHARD_BYTES, SHARD_DOCS = 24_000_000, 8192
#: Postings of a block at most, and what a block costs beside its errors, in units of impact.
LONGEST, COST = 64, 600_000
#: Lists that are split together, which bounds the memory of it.
TOGETHER = 4096
#: Queries, and terms of queries, that are searched at once; shards of the first wave; documents scored at once.
QUERIES, TERMS, WAVE, STEP = 1000, 200_000, 6, 512
#: A term: letters and digits of ASCII and everything beyond it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INDEX = "shard long, term binary, docs array<int>, impacts array<int>, ends array<int>, most array<int>, ids array<long>"


def totals(docs: DataFrame) -> tuple[int, int]:
    """(N, L): documents with a term, and all terms, of docs(text)."""
    n = F.regexp_count("text", F.lit(TERM)).cast("long")
    found = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    return found[0], found[1] or 0


def blocks(lengths: np.ndarray, impacts: np.ndarray, longest: int = LONGEST, cost: int = COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, ends, most) of the best partitions of posting lists that follow one another in `impacts`.

    counts: blocks of each list; ends: the last posting of each block, counted from 0 in its list; most: its largest
    impact.
    """
    start, back = np.cumsum(lengths) - lengths, np.ones(len(impacts), np.int16)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 1]
    for i in range(0, len(order), TOGETHER):
        some = order[i : i + TOGETHER]
        _advance(lengths[some], start[some], impacts, back, longest, cost)
    # From the ends of the lists back to their beginnings, all lists together.
    at = lengths - 1
    lists, ends = [], []
    live = np.flatnonzero(at >= 0)
    while len(live):
        lists.append(live)
        ends.append(at[live])
        at[live] -= back[start[live] + at[live]]
        live = live[at[live] >= 0]
    if not lists:
        return np.zeros(len(lengths), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists, ends = np.concatenate(lists), np.concatenate(ends)
    order = np.lexsort((ends, lists))
    lists, ends = lists[order], ends[order]
    first = np.concatenate([[True], lists[1:] != lists[:-1]])
    opens = start[lists] + np.where(first, 0, np.concatenate([[0], ends[:-1] + 1]))
    return np.bincount(lists, minlength=len(lengths)), ends, np.maximum.reduceat(impacts, opens)


def _advance(size: np.ndarray, begin: np.ndarray, impacts: np.ndarray, back: np.ndarray, longest: int, cost: int) -> None:
    """Sets back[i] to the length of the best last block of a list up to posting i, for lists of falling size.

    All lists advance together, one posting a step; of each the last `longest` positions are kept.
    """
    longest = min(longest, int(size[0]))
    # Of the block of the last b + 1 postings: its largest and summed impact; of the list before it, the least cost.
    top, total, before = (np.zeros((len(size), longest), np.int64) for _ in range(3))
    least, width = np.zeros(len(size), np.int64), np.arange(1, longest + 1)
    for j in range(int(size[0])):
        active = int(np.searchsorted(-size, -j, "left"))  # lists longer than j
        x = impacts[begin[:active] + j].astype(np.int64)[:, None]
        top = np.maximum(np.column_stack([x, top[:active, :-1]]), x)
        total = np.column_stack([x, total[:active, :-1] + x])
        before = np.column_stack([least[:active], before[:active, :-1]])
        b = min(j + 1, longest)
        sums = before[:, :b] + top[:, :b] * width[:b] - total[:, :b]
        best = sums.argmin(1)
        least = sums[np.arange(active), best] + cost
        back[begin[:active] + j] = best + 1


def impact(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What tf occurrences add to a document of `length` terms, before the term's weight; all in whole numbers."""
    m = 50 + (50 * length * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _shard(number: int, ids: list[int], texts: list[bytes], n: int, total: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: a row of its documents' ids, with a null term, and one for each term."""
    known: dict[bytes, int] = {}
    docs, terms, lengths = [], [], []
    for text in texts:
        own = _TERM.findall(text.lower())  # goes by ASCII only
        lengths.append(len(own))
        found = np.fromiter((known.setdefault(t, len(known)) for t in own), np.int64, len(own))
        docs.append(len(own))
        terms.append(found)
    keys = np.concatenate(terms) * len(ids) + np.repeat(np.arange(len(ids)), docs) if terms else np.zeros(0, np.int64)
    del terms
    keys, tf = np.unique(keys, return_counts=True)
    term, doc = keys // len(ids), keys % len(ids)
    x = impact(tf.astype(np.int64), np.array(lengths, np.int64)[doc], n, total) if len(keys) else tf
    sizes = np.bincount(term, minlength=len(known))
    counts, ends, most = blocks(sizes, x)
    names = pa.array(list(known), pa.binary())
    at, of = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(counts)])
    schema = ["shard", "term", "docs", "impacts", "ends", "most", "ids"]
    none = pa.nulls(1, pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([None], pa.binary()), none, none, none, none, pa.array([ids], pa.list_(pa.int64()))], schema
    )
    step = 20_000
    for i in range(0, len(known), step):
        j = min(i + step, len(known))
        p, q, b, e = at[i], at[j], of[i], of[j]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(j - i, number)), names[i:j],
                _lists(at[i : j + 1] - p, doc[p:q], pa.int32()), _lists(at[i : j + 1] - p, x[p:q], pa.int32()),
                _lists(of[i : j + 1] - b, ends[b:e], pa.int32()), _lists(of[i : j + 1] - b, most[b:e], pa.int32()),
                pa.nulls(j - i, pa.list_(pa.int64())),
            ],
            schema,
        )


def index(docs: DataFrame, n: int, total: int, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The postings of docs(doc_id, text), written: a row for each shard and term, and one of each shard's doc_ids (term null).

    n and total are the corpus's totals(). Texts are indexed where they are read and not shuffled. Null texts and those
    without a term, and rows with a null doc_id, are in no list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py()
                if ids and (held + len(text) > shard_bytes or len(ids) >= shard_docs):
                    yield from _shard(number, ids, texts, n, total)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i.as_py())
                texts.append(text)
                held += len(text)
        if ids:
            yield from _shard(number, ids, texts, n, total)

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return cut(rows.mapInArrow(run, _INDEX), "postings")


class _Query:
    """One query's lists of a shard, laid end to end: documents, scores, blocks with their documents and bounds."""

    def __init__(self, lists: list[tuple[int, tuple]]):
        self.docs = np.concatenate([x[0] for _, x in lists])
        self.score = np.concatenate([w * x[1] for w, x in lists])
        bound = np.concatenate([w * x[3] for w, x in lists])
        size = np.concatenate([np.diff(x[2], prepend=-1) for _, x in lists])
        # Where each block begins among all postings, and its first and last document.
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.first, self.last, self.bound = self.docs[self.begin], self.docs[self.end - 1], bound

    def bounds(self, n: int) -> np.ndarray:
        """For every document the sum of the bounds of the blocks whose range it is in."""
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, self.first, self.bound)
        np.subtract.at(change, self.last + 1, self.bound)
        return np.cumsum(change)[:n]

    def scores(self, docs: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of those of docs whose own terms' bounds reach `least`; blocks without one are not read."""
        wanted = np.zeros(n, bool)
        wanted[docs] = True
        before = np.concatenate([[0], np.cumsum(wanted)])
        met = np.flatnonzero(before[self.last + 1] > before[self.first])
        size = self.end[met] - self.begin[met]
        at = np.repeat(self.begin[met] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        block = np.repeat(met, size)
        hit = wanted[self.docs[at]]
        at, block = at[hit], block[hit]
        pivot = np.zeros(n, np.int64)
        np.add.at(pivot, self.docs[at], self.bound[block])
        fine = pivot[self.docs[at]] >= least
        at = at[fine]
        total = np.zeros(n, np.int64)
        np.add.at(total, self.docs[at], self.score[at])
        found = np.flatnonzero(total)
        return found, total[found]


def best(query: _Query, ids: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_ids, scores) of a shard's k best documents of `least` and more, by score, then doc_id."""
    bounds = query.bounds(len(ids))
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] >= max(least, 1)]
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(order), STEP):
        some = order[at : at + STEP]
        some = some[bounds[some] >= least]
        if not len(some):
            break
        docs, own = query.scores(some, len(ids), least)
        found, scores = np.concatenate([found, ids[docs]]), np.concatenate([scores, own])
        kept = np.lexsort((found, -scores))[:k]
        found, scores = found[kept], scores[kept]
        if len(scores) == k:
            least = max(least, int(scores[-1]))
    fine = scores >= max(least, 1)
    return found[fine], scores[fine]


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term binary): the distinct terms of each item of queries(item_id, text)."""
    lower = F.translate("text", _UPPER, _LOWER)
    terms = F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))
    return queries.where("item_id is not null").select("item_id", F.explode(terms).alias("term")).distinct().withColumn("term", F.col("term").cast("binary"))


def search(postings: DataFrame, queries: DataFrame, n: int, k: int = K, block: int = QUERIES, most_terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index() for each item of queries(item_id, text).

    Ranks go by score, then doc_id; documents without a term of the item have no rank, so an item without a term, or with
    a null text, has no row. Rows of one item_id are one item. Queries are searched in blocks of `block` items and
    `most_terms` distinct terms, whose terms and weights are broadcast; an item of more terms is a block by itself. Columns
    by other names are not looked at; empty tables give an empty table.
    """
    spark = postings.sparkSession
    terms = cut(query_terms(queries), "query_terms")
    sizes = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    out = spark.createDataFrame([], f"item_id {terms.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    # Items one after another: ids and sizes are fetched, some bytes for an item.
    group, many, groups = [], 0, []
    for item, own in sizes.orderBy("item_id").toLocalIterator():
        if group and (len(group) >= block or many + own > most_terms):
            groups.append(group)
            group, many = [], 0
        group.append(item)
        many += own
    for own in [*groups, group] if group else []:
        # Ids from the first to the last of a block, as they are in order.
        some = terms.where((F.col("item_id") >= F.lit(own[0])) & (F.col("item_id") <= F.lit(own[-1])))
        found = _search(postings, some, n, k)
        out = found if len(groups) == 0 else out.unionByName(cut(found, "ranked"))
    return out


def _search(postings: DataFrame, terms: DataFrame, n: int, k: int) -> DataFrame:
    spark = postings.sparkSession
    # At most `most_terms` distinct terms, or one item's.
    distinct = terms.select("term").distinct()
    lists = cut(postings.join(F.broadcast(distinct), "term", "left_semi").unionByName(postings.where("term is null")), "query_postings")
    df = lists.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weights = {bytes(t): weight(n, d) for t, d in df.collect()}
    asked: dict = {}
    for item, term in terms.collect():
        if weights.get(bytes(term), 0) > 0:
            asked.setdefault(item, []).append(bytes(term))
    items = list(asked)
    schema = "item int, doc_id long, score long"
    told = spark.sparkContext.broadcast((weights, [asked[i] for i in items]))

    def wave(rows: DataFrame, least: list[int]) -> DataFrame:
        def run(key: tuple, table: pa.Table) -> pa.Table:
            weights, asked = told.value
            ids, held = None, {}
            columns = [table.column(c) for c in ("term", "docs", "impacts", "ends", "most", "ids")]
            for term, docs, x, ends, most, names in zip(*columns, strict=True):
                if term.is_valid:
                    held[term.as_py()] = tuple(v.values.to_numpy().astype(np.int64) for v in (docs, x, ends, most))
                else:
                    ids = names.values.to_numpy()
            item, doc, score = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, own in enumerate(asked):
                if there := [(weights[t], held[t]) for t in own if t in held]:
                    found, scores = best(_Query(there), ids, k, least[i])
                    item.append(np.full(len(found), i, np.int32))
                    doc.append(found)
                    score.append(scores)
            return pa.table({"item": np.concatenate(item), "doc_id": np.concatenate(doc), "score": np.concatenate(score)})

        return rows.groupBy("shard").applyInArrow(run, schema)

    # The first wave: a few shards, the same in every run. Its k-th best is what the others' results must reach.
    shards = [r[0] for r in lists.where("term is null").select("shard").orderBy(F.xxhash64("shard"), "shard").limit(WAVE).collect()]
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    first = cut(wave(lists.where(F.col("shard").isin(shards)), [1] * len(items)), "first_wave")
    last = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("item", "score").collect()
    least = dict(map(tuple, last))
    rest = wave(lists.where(~F.col("shard").isin(shards)), [least.get(i, 1) for i in range(len(items))])
    both = first.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items)), f"item int, item_id {terms.schema['item_id'].dataType.simpleString()}")
    return both.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """search() of queries(item_id, text) over all docs(doc_id, text); docs without a doc_id take no part."""
    docs = docs.where("doc_id is not null")
    n, total = totals(docs)
    return search(index(docs, n, max(total, 1)), queries, n, k)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), docs AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0
), totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs
), terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term
), dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM dfs, totals
), scored AS (
  SELECT t.item_id, f.r, any_value(d.doc_id) AS doc_id,
    CAST(sum(w.weight * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (100 - 50 + (50 * d.n * nn) // ll)))) AS BIGINT) AS score
  FROM terms t JOIN weights w USING (term) JOIN tfs f USING (term) JOIN docs d USING (r), totals
  GROUP BY t.item_id, f.r
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w <= 50
"""
