"""Line deduplication with a deletion-neighbourhood join over words.

A line's words are its lower-cased parts between white space. A line is removed if an earlier one, by (doc_id, row, line
number), has the same words; or, where both have near_words words or more, if an earlier one is within one inserted,
deleted or replaced word of it. Lines of fewer than min_words words are never removed. The query and the pipeline ask for
EVERY_LINE: repeats of all lines with a word, and near copies from 4 words on. dedup() alone has the defaults MIN_WORDS
and NEAR_WORDS.

Two lines are within one edit exactly if one is the other with a word deleted, or if both give the same words on deleting
the word at the same place. So each line emits a hashed key for every deletion variant with the place, and one for itself
at place 0. All lines of one (variant, place) are within one edit of each other: only their earliest has to be known,
whatever the size of the group. Likewise a line and all lines of which it is a variant. Both are plain minimum
aggregates, so no group's pairs are ever listed. Each line found is then verified against its earlier one.

Variants are emitted only for lines that can have a partner: of two lines within one edit, either the first halves or the
second halves are equal. A count over hashed halves tells which lines share one; this loses no pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, cut, mix, numbered, read, side, word_hash

MIN_WORDS = 4
NEAR_WORDS = 10
#: No line is exempt from exact repeats; of fewer than four words, one changed word makes another line.
EVERY_LINE = {"min_words": 1, "near_words": 4}
#: An odd base of polynomial hashes and its inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _words(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(line), r"\s+", " ")), " ")


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, _row, line int from 0, words) of the lines of docs(doc_id, _row, text) with min_words words or more."""
    rows = docs.select("doc_id", "_row", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    rows = rows.select("doc_id", "_row", "line", _words(F.col("raw")).alias("words"))
    # A blank line splits into one empty word.
    return rows.where((F.size("words") >= min_words) & (F.get("words", F.lit(0)) != ""))


#: Of lines a, b within one edit, sizes differ by one at most: the first and last words as many as half of the shorter one
#: do not overlap in either, so one edit leaves the first or the last equal. The shorter one has {near} words or more.
_HALVES = """
    if(n >= {near}, array_distinct(array(
        xxhash64(1, slice(words, 1, greatest(n - 1, {near}) div 2)), xxhash64(1, slice(words, 1, n div 2)),
        xxhash64(2, slice(words, -(greatest(n - 1, {near}) div 2), greatest(n - 1, {near}) div 2)),
        xxhash64(2, slice(words, -(n div 2), n div 2))
    )), array())
"""


def within_one_edit(a: str, b: str) -> str:
    """SQL: the word arrays a and b are within one inserted, deleted or replaced word."""
    differ = f"aggregate(zip_with({a}, {b}, (x, y) -> if(x <=> y, 0, 1)), 0, (s, x) -> s + x)"

    def deleted(long: str, short: str) -> str:
        at = f"array_position(zip_with({long}, {short}, (x, y) -> x <=> y), false)"
        return f"slice({long}, cast({at} as int) + 1, size({long})) = slice({short}, cast({at} as int), size({short}))"

    return (
        f"case size({a}) - size({b}) when 0 then {differ} <= 1 when 1 then {deleted(a, b)} "
        f"when -1 then {deleted(b, a)} else false end"
    )


def deletion_variants(words: DataFrame) -> DataFrame:
    """(at, place, key): hashed keys of words(at, words) itself, at place 0, and of it without its i-th word, at place i.

    The hash of words w1..wn is the sum of h(wi) B^i modulo 2^64, finished by a mix: sums before and after the gap give
    every variant's hash at once. Equal words hash alike wherever they come from.
    """
    kind = words.schema["at"].dataType

    def run(batches):
        hashes = Memo(word_hash, 150_000)
        for batch in batches:
            lists = batch.column(1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h = np.array([hashes[w] for w in lists.flatten().to_pylist()], np.uint64)
            owner = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            powers = np.cumprod(np.append(np.uint64(1), np.full(int(n.max(initial=0)), _BASE)), dtype=np.uint64)
            term = h * powers[nth]
            total = np.append(np.uint64(0), np.cumsum(term, dtype=np.uint64))
            begin, end = total[(np.cumsum(n) - n)[owner]], total[np.cumsum(n)[owner]]
            before, after = total[:-1] - begin, end - total[1:]
            whole = total[np.cumsum(n)] - total[np.cumsum(n) - n]
            key = mix(np.concatenate([whole, before + after * _INVERSE])).view(np.int64)
            place = np.concatenate([np.zeros(len(n), np.int64), nth + 1])
            at = batch.column(0).take(pa.array(np.concatenate([np.arange(len(n)), owner])))
            yield pa.RecordBatch.from_arrays([at, pa.array(place.astype(np.int32)), pa.array(key)], ["at", "place", "key"])

    schema = T.StructType([T.StructField("at", kind), *T.StructType.fromDDL("place int, key long").fields])
    return words.select("at", "words").mapInArrow(run, schema)


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(_row, line) of the lines to remove from docs(doc_id, _row, text)."""
    every = lines(docs, min_words).withColumn("n", F.size("words"))
    every = every.select(
        F.struct("doc_id", "_row", "line").alias("at"),
        F.xxhash64("words").alias("h"),
        F.hash("words").alias("h2"),
        F.expr(_HALVES.format(near=near_words)).alias("halves"),
    )
    every = cut(every, "lines")

    distinct = every.groupBy("h", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.max("halves").alias("halves"))
    distinct = cut(distinct, "distinct_lines")

    repeated = side(distinct.where("n > 1").select("h", "h2", "first"))
    again = every.select("at", "h", "h2").join(repeated, ["h", "h2"]).where("at > first").select("at._row", "at.line")

    halves = distinct.select("h", "h2", F.explode("halves").alias("half"))
    shared = cut(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), "halves")
    partnered = halves.join(side(shared), "half", "left_semi").select("h", "h2").distinct()
    partnered = cut(partnered.join(distinct.select("h", "h2", "first"), ["h", "h2"]), "partnered")

    # The words of those lines, read again from their first occurrences; other lines and documents are not split.
    first = partnered.groupBy(F.col("first._row").alias("_row")).agg(F.sort_array(F.collect_set("first.line")).alias("wanted"))
    first = cut(first, "wanted")
    words = docs.select("doc_id", "_row", "text").join(side(first), "_row")
    words = words.withColumn("raw", F.split("text", "\n")).select("doc_id", "_row", "raw", F.explode("wanted").alias("line"))
    words = words.select(F.struct("doc_id", "_row", "line").alias("at"), _words(F.get("raw", "line")).alias("words"))
    words = cut(words, "partnered_words")
    variants = cut(deletion_variants(words), "variants")

    same_place = variants.where("place > 0").groupBy("key", "place").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    same_place = same_place.where("n > 1").select("key", "place", "first")
    by_key = variants.groupBy("key").agg(
        F.min(F.when(F.col("place") == 0, F.col("at"))).alias("whole"), F.min(F.when(F.col("place") > 0, F.col("at"))).alias("variant")
    )
    by_key = by_key.where("whole is not null and variant is not null")
    met = same_place.unionByName(by_key.select("key", F.lit(0).alias("place"), F.col("variant").alias("first")))
    met = cut(met.unionByName(by_key.select("key", F.lit(-1).alias("place"), F.col("whole").alias("first"))), "met")
    earlier = side(met)
    # Place -1 is met by every variant of its key: the earlier line is then the variant itself as a whole line.
    asked = variants.select("at", "key", F.explode(F.expr("if(place > 0, array(place, -1), array(0))")).alias("place"))
    found = asked.join(earlier, ["key", "place"]).where("first < at").select("at", "first").distinct()
    both = found.join(words, "at").join(words.select(F.col("at").alias("first"), F.col("words").alias("earlier")), "first")
    near = both.where(F.expr(within_one_edit("words", "earlier"))).select("at").distinct()
    # A near line's repetitions are removed already, as they are not the first of their words.
    return again.unionByName(near.select("at._row", "at.line")).distinct()


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with `text` less the removed lines, and n_lines int, removed array<int> (line numbers from 0).

    Requires doc_id and text. Null texts stay null with n_lines 0, empty ones empty; the other lines of a text keep their
    order and line breaks. Rows with equal doc_id count in the table's order; so of repeated rows the first keeps its
    lines. Long texts are handled whole; an empty table gives an empty one. Columns named n_lines or removed are replaced,
    all others returned as they are.

    min_words and near_words define what a repeat is: a line of fewer words than min_words is never one, and a line of
    fewer than near_words only if it has the same words as an earlier one.
    """
    docs = docs.drop("n_lines", "removed")
    rows = numbered(docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text"))
    gone = removed_lines(rows.select("doc_id", "_row", "text"), min_words, near_words).groupBy("_row").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    gone = cut(gone, "removed")
    out = rows.select("_row", "_doc").join(side(gone), "_row", "left")
    # A column of its own, and used more than once, so that Spark splits a text once and not once a line.
    out = out.withColumn("_parts", F.split("_doc.text", "\n"))
    # By way of a hash set of the numbers: linear in the lines, however many are removed.
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("removed"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("_parts", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("_doc.text")).otherwise(kept)
    n = F.when(F.col("_doc.text").isNull(), 0).otherwise(F.size("_parts"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(F.col("_doc").withField("text", text).alias("_doc"), n.alias("n_lines"), removed.alias("removed")).select("_doc.*", "n_lines", "removed")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), **EVERY_LINE).select("doc_id", "n_lines", "removed", "text")
