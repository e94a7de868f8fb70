"""Near-duplicates by SimHash fingerprints, linked through covering locality-sensitive hashing.

Bit i of a fingerprint gets a vector v(i) of radius + 1 bits, none of them zero, dealt in turn. Every non-zero vector u of
as many bits makes one table, whose mask keeps the bits i with an odd inner product of u and v(i). The vectors of any
`radius` bits span less than the whole space, so some u is orthogonal to all of them: two fingerprints that differ in
these bits agree under that u's mask. Every pair within the radius so shares a key of some table, for certain.

Fingerprints that share a key are candidates. They are not compared pair by pair: each is named under itself and under
every way to flip up to radius / 2 of the bits that its shared tables leave out, and two fingerprints are within the
radius just if they share such a name. A name has as many takers as there are flips, at most, whatever the corpus holds.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, side
from .components import components

BITS, RADIUS = 64, 2
#: Words of a shingle and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
_BLANK = re.compile(rb"[ \t-\r]")


def masks(radius: int = RADIUS) -> list[int]:
    """One mask for each of the 2^(radius + 1) - 1 tables: the bits that its keys keep."""
    vectors = range(1, 1 << (radius + 1))
    of = [vectors[i % len(vectors)] for i in range(BITS)]
    return [sum(1 << i for i, v in enumerate(of) if (u & v).bit_count() % 2) for u in vectors]


def _pieces(text: bytes) -> Iterator[bytes]:
    """text in pieces of about PIECE bytes that end at a blank."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + PIECE)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a text in UTF-8, unsigned: the majority of every bit over its shingles' hashes."""
    ones, n, words = np.zeros(BITS, np.int64), 0, []
    for piece in _pieces(text or b""):
        words += piece.lower().split()  # both go by ASCII only
        if len(words) >= SHINGLE:
            ones, n = ones + _ones(words), n + len(words) - SHINGLE + 1
            words = words[1 - SHINGLE :]
    if words and not n:
        ones, n = _ones([b" ".join(words)], 1), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _ones(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """How many of the shingles' hashes have each bit."""
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8", len(words) - size + 1)
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row of docs(doc_id, text); fp is the fingerprint's bits as a signed number.

    A null or empty text, or one of blanks, has fingerprint zero; a text of fewer words than a shingle has its whole
    sequence for one. A long text passes in pieces of PIECE bytes, and is never shortened.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of the distinct prints(fp long) of at most `radius` differing bits, enough to connect all such pairs.

    radius is even. prints is read twice and should be a written table.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for t, m in enumerate(masks(radius))))
    keys = prints.select("fp", F.explode(tables).alias("k")).select("fp", "k.*")
    shared = cut(keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key"), "shared_keys")
    free = F.element_at(F.array(*(_signed(~m & (1 << BITS) - 1) for m in masks(radius))), F.col("t") + 1)
    met = keys.join(side(shared), ["t", "key"], "left_semi").groupBy("fp").agg(F.bit_or(free).alias("free"))
    flips = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in itertools.combinations(range(BITS), k)]
    own = F.filter(F.array(*map(_signed, flips)), lambda x: x.bitwiseAND(F.bitwise_not("free")) == 0)
    named = met.select("fp", F.explode(own).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("name"))
    takers = named.groupBy("name").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    pairs = takers.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, F.size("fps"))).alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs(doc_id, text).

    component_id is the smallest doc_id of the rows that links of at most `radius` differing bits reach, its own included;
    equal fingerprints link. Rows of one doc_id are rows of their own. A null doc_id has a component like any other and
    names none, unless all its rows have none. Columns by other names are not looked at; an empty table gives an empty one.
    """
    prints = cut(fingerprints(docs), "fingerprints")
    kinds = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct_fingerprints")
    joined = cut(components(links(kinds, radius)), "fingerprint_components")
    # Each fingerprint's component, and the least id of a component of several fingerprints.
    rooted = cut(kinds.join(side(joined), F.col("fp") == F.col("node")).select("fp", "root", "low"), "rooted")
    least = cut(rooted.groupBy("root").agg(F.min("low").alias("low")), "least")
    linked = rooted.select("fp", "root").join(side(least), "root").select("fp", F.col("low").alias("linked"))
    named = kinds.join(linked, "fp", "left").where("n > 1 or linked is not null or low is null")
    named = cut(named.select("fp", F.coalesce("linked", "low").alias("class")), "named_fingerprints")
    # A fingerprint of one row and no link is not listed: its row is its component.
    out = prints.join(side(named), "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("class", "doc_id").alias("component_id"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
