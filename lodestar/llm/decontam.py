"""Benchmark decontamination with a broadcast hash set of test n-grams; DataFrame functions only.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. A test item of n words or more has one
window for each n consecutive words; a shorter one, but not an empty one, is a window as a whole.

1. One scan of the texts meets the hash set: a document is a candidate if a shorter gram at every `stride`-th word is a
   gram of a test window. A window of L words that occurs anywhere covers a whole gram of g words that begins at a multiple
   of L - g + 1, so no occurrence escapes. Only numbers and hashes leave the scan.
2. Candidates are read again; all their windows meet the test windows, words and all, so that a hit is verified.
3. Overlapping hits become runs of hit words, by a window function over a document's hits. Test windows of the same items
   are listed once, so a passage that many items share brings one list and no product of hits and items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, numbered, read, side

#: Fixed by the contract: the characters of a word, once A-Z are lower-cased; WORD_ANY_CASE has A-Z too.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most grams, 8 bytes each, that are broadcast as a hash set; more meet the texts' grams by a shuffle of hashes alone.
MOST_IN_PLAN = 2_000_000


def words(text: Column) -> Column:
    """The words of a text. Only ASCII texts and words are lower-cased as a whole, as other letters keep their case."""

    def plain(c: Column) -> Column:
        return F.octet_length(c) == F.length(c)

    lowered = F.transform(
        F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0)), lambda w: F.when(plain(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))
    )
    found = F.when(plain(text), F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).otherwise(lowered)
    return F.coalesce(found, F.array().cast("array<string>"))


def windows(bench: DataFrame, n: int = 10) -> DataFrame:
    """(size int, window string, items array): the distinct windows of bench(item_id, text) and the items they are of."""
    w = bench.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("size", F.least(F.size("w"), F.lit(n)))
    w = w.select("item_id", "size", "w", F.explode(F.expr("sequence(1, size(w) - size + 1)")).alias("i"))
    w = w.select("item_id", "size", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("window"))
    return w.groupBy("size", "window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _gram(size: int) -> tuple[int, int]:
    """(words of a gram, stride) that cover every window of `size` words."""
    g = (size + 2) // 2
    return g, size - g + 1


def _grams(of: str, n: str, g: int, stride: int) -> str:
    """SQL: the hashes of the grams of the word array `of`, of n words, at every stride-th word."""
    return f"if({n} >= {g}, transform(sequence(1, {n} - {g - 1}, {stride}), i -> xxhash64(slice({of}, i, {g}))), array())"


def scan(rows: DataFrame, ws: DataFrame, sizes: list[int], most_in_plan: int = MOST_IN_PLAN) -> DataFrame:
    """(_row, _keep, n_words, gram) of rows(_row, _keep, text), written once.

    Each row of rows comes once with a null gram, and once more for every gram of it that a window of ws has.
    """
    split = ws.select("size", F.split("window", " ").alias("w"))
    grams = [split.where(F.col("size") == size).select(F.explode(F.expr(_grams("w", str(size), _gram(size)[0], 1))).alias("gram")) for size in sizes]
    base = rows.select("_row", "_keep", words(F.col("text")).alias("_w"))
    base = base.withColumn("n_words", F.size("_w").cast("long"))
    own = ", ".join(["array(cast(null as bigint))", *(_grams("_w", "size(_w)", *_gram(size)) for size in sizes)])
    base = base.select("_row", "_keep", "n_words", F.explode(F.expr(f"concat({own})")).alias("gram"))
    if not grams:
        return cut(base, "scanned")
    listed = grams[0]
    for more in grams[1:]:
        listed = listed.union(more)
    listed = cut(listed.select(F.col("gram").alias("_listed")).distinct(), "grams")
    listed = F.broadcast(listed) if listed.count() <= most_in_plan else listed
    met = base.join(listed, F.col("gram") == F.col("_listed"), "left")
    return cut(met.where("gram is null or _listed is not null").drop("_listed"), "scanned")


def located(rows: DataFrame, scanned: DataFrame, ws: DataFrame, sizes: list[int]) -> DataFrame:
    """(_row, spans, items) of the rows(_row, text) that hold a window of ws: runs of hit words, and the sorted item ids."""
    near = cut(scanned.where("gram is not null").select("_row").distinct(), "candidates")
    asked = rows.select("_row", "text").join(side(near), "_row", "left_semi").select("_row", words(F.col("text")).alias("_w"))
    every = ["cast(array() as array<struct<pos: int, size: int, window: string>>)"]
    every += [
        f"if(size(_w) >= {k}, transform(sequence(1, size(_w) - {k - 1}), i -> struct(i as pos, {k} as size, array_join(slice(_w, i, {k}), ' ') as window)), array())"
        for k in sizes
    ]
    found = asked.select("_row", F.explode(F.expr(f"concat({', '.join(every)})")).alias("_at")).select("_row", "_at.*")
    # Windows of the same items go by one number; the items themselves are listed apart.
    same = ws.groupBy("items").agg(F.min(F.struct("size", "window")).alias("set"))
    known = cut(ws.join(same, "items").select("size", "window", "set"), "windows")
    lists = cut(same, "item_sets")
    found = cut(found.join(side(known), ["size", "window"]).select("_row", "pos", "size", "set"), "hits")

    order = Window.partitionBy("_row").orderBy("pos", "size")
    before = F.max(F.col("pos") + F.col("size") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.select("_row", "pos", "size", (F.coalesce(before, F.lit(-1)) < F.col("pos") - 1).cast("int").alias("_new"))
    runs = runs.withColumn("_run", F.sum("_new").over(order))
    runs = runs.groupBy("_row", "_run").agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("size")).alias("end"))
    spans = runs.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("end") - F.col("pos")).alias("size")))).alias("spans"))
    items = found.select("_row", "set").distinct().join(side(lists), "set")
    items = items.select("_row", F.explode("items").alias("item")).distinct()
    items = items.groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return cut(spans.join(items, "_row", "left"), "located")


def hits(docs: DataFrame, bench: DataFrame, n: int = 10, most_in_plan: int = MOST_IN_PLAN) -> DataFrame:
    """One row per row of docs(text, ...): its other columns, n_words, spans array<struct<pos, size>>, items array.

    `spans` has the runs of words in verified occurrences of windows (pos is the first word's number from 1), `items` the
    sorted ids of the items that they are of. Null and wordless texts have no words; long texts are matched whole; a null
    item id is matched but not listed. Repeated rows of docs keep a row each; without test items nothing is hit, and an
    empty table gives an empty one. Columns of docs named n_words, spans or items are replaced; columns by any other name,
    of any type, are returned as they are.
    """
    ws = cut(windows(bench, n), "test_windows")
    sizes = sorted(r["size"] for r in ws.select("size").distinct().collect())
    keep = [c for c in docs.columns if c not in ("text", "n_words", "spans", "items")]
    kept = F.struct(*keep) if keep else F.struct(F.lit(0).alias("_none"))
    rows = numbered(docs.select(kept.alias("_keep"), "text"))
    scanned = scan(rows, ws, sizes, most_in_plan)
    found = located(rows, scanned, ws, sizes)
    out = scanned.where("gram is null").join(side(found), "_row", "left")
    nothing = "cast(array() as array<struct<pos: int, size: int>>)"
    none = F.array().cast(found.schema["items"].dataType)
    return out.select(*(f"_keep.{c}" for c in keep), "n_words", F.coalesce("spans", F.expr(nothing)).alias("spans"), F.coalesce("items", none).alias("items"))


def n_hit(spans: Column) -> Column:
    """The number of words in the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["size"])


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, remove: str = "spans") -> DataFrame:
    """docs, with the columns it has, without what it shares with the test items.

    remove='documents' drops every document with a hit. remove='spans' cuts the hit words, each with the characters up
    to the next word, out of the text and keeps every document. Documents without a hit are returned as they are. `text`
    is required; columns by any name are returned, as they travel in a struct. Null texts stay null; repeated rows are
    treated alike; an empty table gives an empty one.
    """
    rows = numbered(docs.select(F.struct(*docs.columns).alias("_doc"), "text"))
    ws = cut(windows(bench, n), "test_windows")
    sizes = sorted(r["size"] for r in ws.select("size").distinct().collect())
    # Only what is hit is gathered, then met with its rows by number: clean texts are not shuffled.
    slim = rows.select("_row", F.struct(F.lit(0).alias("_none")).alias("_keep"), "text")
    found = side(located(slim, scan(slim, ws, sizes), ws, sizes).select("_row", "spans"))
    if remove == "documents":
        return rows.select("_row", "_doc").join(found.select("_row"), "_row", "left_anti").select("_doc.*")
    out = rows.select("_row", "_doc").join(found, "_row", "left")
    pieces = F.regexp_extract_all("_doc.text", F.lit(f"{WORD_ANY_CASE}{BREAK}"), F.lit(0))
    out = out.withColumn("_pieces", F.when(F.col("spans").isNotNull(), pieces))
    lead = F.regexp_extract("_doc.text", f"^{BREAK}", 0)
    # What lies between one span and the next, before the first and behind the last.
    begin = "if(k = 0, 1, spans[k - 1].pos + spans[k - 1].size)"
    end = "if(k = size(spans), size(_pieces) + 1, spans[k].pos)"
    kept = F.expr(f"flatten(transform(sequence(0, size(spans)), k -> slice(_pieces, {begin}, {end} - {begin})))")
    text = F.when(F.col("spans").isNull(), F.col("_doc.text")).otherwise(F.concat(lead, F.array_join(kept, "")))
    return out.select(F.col("_doc").withField("text", text).alias("_doc")).select("_doc.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    hit = n_hit(F.col("spans"))
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP9_SQL = r"""
with words as (
    select 'd' as kind, doc_id as id, row_number() over () as rid,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), wins as (
    select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
    from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)
), sizes as (select distinct size from wins),
docwins as (
    select rid, size, i, array_to_string(w[i:i + size - 1], ' ') as win
    from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as i from words, sizes where len(w) >= size)
), found as (
    select d.rid, d.i, d.size, b.item_id from docwins d join wins b on d.size = b.size and d.win = b.win
), cover as (
    select rid, count(distinct p) as n_hit
    from (select rid, unnest(range(i, i + size)) as p from (select distinct rid, i, size from found)) group by rid
), listed as (
    select rid, count(*) as n_items, string_agg(x, ',' order by x) as items
    from (select distinct rid, cast(item_id as varchar) as x from found) group by rid
)
select w.id as doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit,
    cast(coalesce(l.n_items, 0) as bigint) as n_items, sha256(coalesce(l.items, '')) as items_sha256,
    coalesce(c.n_hit, 0) > 0 as contaminated
from words w left join cover c using (rid) left join listed l using (rid)
"""
