"""Near-duplicate detection with ProbMinHash signatures, banding and exact verification.

A document's shingles are its runs of five words (\\w+ of the lower-cased text; a text of fewer words has one shingle),
each of weight 1 however often it occurs. Every shingle is a Poisson process whose rate is its weight; each arrival hits a
random one of M registers, and a register keeps the shingle that arrives first. Two documents agree in a register with the
probability Jaccard similarity of their shingles, which is with equal weights the Jaccard similarity that links go by.
Arrivals are only drawn up to a horizon by which all registers are likely hit; documents with a register left are drawn on
to twice the horizon, so that the outcome is that of the unbounded processes.

BANDS bands of ROWS registers give candidate pairs; a pair of similarity 0.8 is missed with a chance of 5e-5. A link is a
candidate pair whose exact Jaccard similarity of distinct shingles is at least 0.8. A class is a connected component of
links, found without listing a bucket's pairs:

1. Copies with equal words are one text. Each bucket's texts are compared with its first text (a star); components follow.
   A center meets its texts in as many shares as keep a share at SALT texts.
2. A bucket whose other texts lie in several components may hide links between those. Its texts are dealt into blocks of
   about BLOCK: a component of more texts has blocks of its own, smaller ones share blocks. Every two blocks are compared
   in a task, but for two of one component; a task gives at most a spanning forest. So a component of many copies meets
   the few texts outside it once for each block of those, and is never compared with itself.

So every candidate pair is either compared or known to be connected.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, cut, map_texts, mix, numbered, read, side, word_hash
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
M = BANDS * ROWS
BLOCK, SALT = 500, 1000
#: Word hashes that a task keeps, in each of two generations, and characters of the texts that it looks at together.
CACHED_WORDS, GROUP_CHARS = 100_000, 300_000
_WORD = re.compile(r"\w+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

def shingle_lists(texts: list[str | None], hashes: Memo | None = None) -> tuple[list[tuple[int, int] | None], np.ndarray, np.ndarray]:
    """(content hash of each text, owner of each shingle, its hash); shingles of a text lie together.

    The content hash is None for null and empty texts; texts without a word have one, but no shingle.
    """
    hashes = Memo(word_hash) if hashes is None else hashes
    content: list[tuple[int, int] | None] = []
    flat: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if not text:
            content.append(None)
            continue
        words = _WORD.findall(text.lower())
        h = xxhash.xxh3_128_intdigest(" ".join(words) if words else "\0" + text)
        content.append(((h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63))
        flat.extend(map(hashes.__getitem__, words))
        sizes[i] = len(words)
    hv = np.array(flat, np.uint64)
    ends = np.cumsum(sizes)
    n = np.where(sizes > 0, np.maximum(sizes - WORDS + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(ends - sizes, n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    g = np.zeros(len(owner), np.uint64)
    for k in range(WORDS):
        inside = at + k < ends[owner]
        h = hv[np.minimum(at + k, max(len(hv) - 1, 0))] if len(hv) else hv
        g = mix(g * np.uint64(0x100000001B3) + np.where(inside, h, np.uint64(k)) + _GOLDEN)
    return content, owner, g


def distinct_shingles(owner: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, occurrences), sorted."""
    order = np.lexsort((g, owner))
    owner, g = owner[order], g[order]
    first = np.ones(len(g), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(first)
    return owner[at], g[at], np.diff(np.append(at, len(g)))


def signatures(owner: np.ndarray, g: np.ndarray, weight: np.ndarray, docs: int, m: int = M) -> np.ndarray:
    """Registers (docs, m) of each document's weighted shingles; zeros for a document without any."""
    total = np.bincount(owner, weights=weight, minlength=docs)
    registers = np.zeros((docs, m), np.uint64)
    todo = np.flatnonzero(total > 0)
    reach = np.log(m) + 2.0
    while len(todo):
        slot = np.full(docs, -1)
        slot[todo] = np.arange(len(todo))
        mine = slot[owner] >= 0
        own, h, w = slot[owner[mine]], g[mine], weight[mine]
        horizon = (reach * m / total[todo])[own]
        best = np.full(len(todo) * m, np.inf)
        held = np.zeros(len(todo) * m, np.uint64)
        time, step = np.zeros(len(h)), 0
        while len(h):
            step += 1
            r = mix(h + np.uint64(step * int(_GOLDEN) % 2**64))
            # Bits 11 up give the waiting time, an independent mix of them the register.
            time = time - np.log(((r >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / w
            alive = np.flatnonzero(time <= horizon)
            own, h, w, time, horizon = own[alive], h[alive], w[alive], time[alive], horizon[alive]
            at = own * m + (mix(r[alive] ^ _GOLDEN) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best, at, time)
            won = best[at] == time
            held[at[won]] = h[won]
        full = np.isfinite(best).reshape(-1, m).all(axis=1)
        registers[todo[full]] = held.reshape(-1, m)[full]
        todo, reach = todo[~full], reach * 2
    return registers


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit key a band."""
    r = registers.reshape(len(registers), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, r.shape[:2])
    for k in range(rows):
        key = mix(key * np.uint64(0x100000001B3) + r[:, :, k])
    return key.view(np.int64)


def _whole(texts: pa.Array, most: int = GROUP_CHARS):
    """Groups of (row number, text) of about `most` characters; texts are never cut, null and empty ones left out."""
    group: list[tuple[int, str]] = []
    n = 0
    for i, text in enumerate(texts):
        if not (t := text.as_py()):
            continue
        group.append((i, t))
        n += len(t)
        if n >= most:
            yield group
            group, n = [], 0
    if group:
        yield group


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, c1, c2, bands array<long>) of docs(doc_id, _row, text); c1 is null for null and empty texts."""

    def run(batches):
        hashes = Memo(word_hash, CACHED_WORDS)
        for batch in batches:
            n = batch.num_rows
            c1: list[int | None] = [None] * n
            c2: list[int | None] = [None] * n
            keys = np.zeros((n, BANDS), np.int64)
            has = np.zeros(n, bool)
            for group in _whole(batch.column(2)):
                content, owner, g = shingle_lists([t for _, t in group], hashes)
                owner, g, _ = distinct_shingles(owner, g)
                found = band_keys(signatures(owner, g, np.ones(len(g)), len(group)))
                some = np.bincount(owner, minlength=len(group)) > 0
                for k, ((i, _), c) in enumerate(zip(group, content, strict=True)):
                    c1[i], c2[i] = c
                    keys[i], has[i] = found[k], some[k]
            offsets = np.append(0, np.cumsum(np.where(has, BANDS, 0))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel()))
            columns = [batch.column(0), batch.column(1), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_row", "c1", "c2", "bands"])

    return map_texts(docs.select("doc_id", "_row", "text"), run, "doc_id long, _row long, c1 long, c2 long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(uid, shingles array<long>) of docs(_row, text): the distinct shingles, sorted."""

    def run(batches):
        hashes = Memo(word_hash, CACHED_WORDS)
        for batch in batches:
            for group in _whole(batch.column(1)):
                _, owner, g = shingle_lists([t for _, t in group], hashes)
                owner, g, _ = distinct_shingles(owner, g)
                offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(group)))).astype(np.int32)
                uid = batch.column(0).take(pa.array([i for i, _ in group]))
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([uid, sets], ["uid", "shingles"])

    return map_texts(docs.select("_row", "text"), run, "uid long, shingles array<long>")


def links_across(uid: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of components that a link between two of the texts joins; at most a spanning forest of them."""
    comps, label = np.unique(comp, return_inverse=True)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1  # a shingle of one text alone is in no intersection
    used, code = np.unique(code[shared], return_inverse=True)
    owner = owner[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(used), 4096):
        part = (code >= at) & (code < at + 4096)
        x = np.zeros((len(sets), min(4096, len(used) - at)), np.float32)
        x[owner[part], code[part] - at] = 1
        common += x @ x.T
    union = size[:, None] + size[None, :] - common
    near = (common >= similarity * union) & (label[:, None] < label[None, :])
    pairs = np.unique(label[np.argwhere(near)], axis=0) if near.any() else np.zeros((0, 2), int)
    root = list(range(len(comps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a, b in pairs.tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            out.append((int(comps[a]), int(comps[b])))
    return out


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("uid")
    out = links_across(pdf["uid"].to_numpy(), pdf["comp"].to_numpy(), [np.asarray(s) for s in pdf["shingles"]])
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _blocks(of: DataFrame, block: int) -> DataFrame:
    """(key, uid, comp, own): the block of each text of the mixed buckets of(key, uid, n, comp).

    `own` is a struct of the component, or null for a block that small components share, and a number.
    """
    large = of.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.any_value("n").alias("n")).where(F.col("size") > block)
    large = cut(large, "large_components")
    placed = of.join(side(large.select("key", "comp", "size")), ["key", "comp"], "left")
    # A component's texts are dealt over its blocks, small components as a whole over the shared ones.
    number = F.when(F.col("size").isNotNull(), F.pmod(F.xxhash64("uid"), F.ceil(F.col("size") / F.lit(block)))).otherwise(
        F.pmod(F.xxhash64("comp"), F.ceil(F.col("n") / F.lit(block)))
    )
    own = F.struct(F.when(F.col("size").isNotNull(), F.col("comp")).alias("comp"), number.alias("number"))
    return placed.select("key", "uid", "comp", own.alias("own"))


def hidden_links(of: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(a, b): links between components, of the texts of mixed buckets of(key, uid, n, comp)."""
    placed = cut(_blocks(of, block), "blocks")
    blocks = placed.groupBy("key", "own").agg(F.count(F.lit(1)).alias("size"))
    pairs = blocks.alias("x").join(blocks.alias("y"), F.expr("x.key = y.key and (x.own < y.own or x.own = y.own)"))
    # Two blocks of one component, and one block with itself if it has but that, hold nothing to compare.
    pairs = pairs.where(F.expr("x.own.comp is null or not (x.own.comp <=> y.own.comp)"))
    pairs = pairs.select(F.col("x.key").alias("key"), F.col("x.own").alias("i"), F.col("y.own").alias("j"))
    pairs = pairs.withColumn("own", F.explode(F.array_distinct(F.array("i", "j"))))
    asked = placed.join(pairs, ["key", "own"]).select("key", "i", "j", "uid", "comp")
    return asked.join(sets, "uid").groupBy("key", "i", "j").applyInPandas(_compare, "a long, b long").distinct()


def classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, _row, class_row, class_id) of docs(doc_id, _row, text), one row per row.

    class_row and class_id are _row and doc_id of the class's first row in the order of _row. Null and empty texts are
    classes of their own. Texts without a word are copies of equal texts only. Repeated rows share a class; long texts are
    compared whole; an empty table gives an empty one. _row must be the same in every scan, as numbered() gives it.
    """
    prints = cut(fingerprints(docs), "prints")
    texts = prints.where("c1 is not null").groupBy("c1", "c2").agg(F.min("_row").alias("uid"), F.any_value("bands").alias("bands"))
    texts = cut(texts, "texts")

    # Buckets of two texts or more; one of those with the same texts stands for all.
    member = texts.select("uid", F.explode("bands").alias("key"))
    bucket = member.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("uid").alias("center"), F.max("uid").alias("top"), F.expr("bit_xor(xxhash64(uid))").alias("mark")
    )
    bucket = bucket.where("n > 1").groupBy("n", "center", "top", "mark").agg(F.min("key").alias("key")).select("key", "n", "center")
    bucket = cut(bucket, "buckets")
    member = cut(member.join(side(bucket), "key"), "members")

    wanted = cut(member.select("uid").distinct(), "wanted")
    chosen = docs.select("_row", "text").join(side(wanted.withColumnRenamed("uid", "_row")), "_row", "left_semi")
    sets = cut(shingle_sets(chosen), "shingles")

    pair = member.where("uid <> center").groupBy("center", "uid").agg(F.max("n").alias("n"))
    pair = pair.withColumn("salts", F.expr(f"cast(1 as bigint) << cast(ceil(log2(ceil(n / {SALT}))) as int)"))
    heads = pair.select("center", "salts").distinct().join(sets.select(F.col("uid").alias("center"), F.col("shingles").alias("other")), "center")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    pair = pair.withColumn("salt", F.pmod(F.xxhash64("uid"), "salts")).join(sets, "uid").join(heads, ["center", "salts", "salt"])
    common = F.size(F.array_intersect("shingles", "other"))
    union = F.size("shingles") + F.size("other") - common
    star = cut(pair.where(common >= SIMILARITY * union).select(F.col("uid").alias("a"), F.col("center").alias("b")), "star_links")
    first = cut(components(star), "first_components")

    of = member.join(side(first.withColumnRenamed("node", "uid")), "uid", "left")
    of = cut(of.select("key", "uid", "n", "center", F.coalesce("root", "uid").alias("comp")), "placed")
    rest = of.where("uid <> center").groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rest = cut(rest, "mixed")
    more = cut(hidden_links(of.join(side(rest), "key", "left_semi"), sets, block), "more_links")

    final = components(star.unionByName(more)).withColumnRenamed("node", "uid").withColumnRenamed("root", "class_row")
    known = prints.join(texts.select("c1", "c2", "uid"), ["c1", "c2"], "left").join(final, "uid", "left")
    known = cut(known.select("doc_id", "_row", F.coalesce("class_row", "uid", "_row").alias("class_row")), "classes")
    head = known.where("_row = class_row").select("class_row", F.col("doc_id").alias("class_id"))
    return known.join(head, "class_row").select("doc_id", "_row", "class_row", "class_id")


def dedup(docs: DataFrame) -> DataFrame:
    """docs, with the columns it has, less all but the first row of each class.

    Null and empty texts stay, as every row of them is a class. Requires doc_id and text; columns by any other name are
    returned as they are. An empty table gives an empty table.
    """
    rows = numbered(docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text"))
    kept = cut(classes(rows.select("doc_id", "_row", "text")).where("_row = class_row").select("_row"), "kept")
    return rows.join(side(kept), "_row", "left_semi").select("_doc.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(numbered(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "class_id", (F.col("_row") == F.col("class_row")).alias("kept"))
