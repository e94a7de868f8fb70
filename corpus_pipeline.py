"""The corpus pipeline: STAGES are applied to documents one after another, each written and read again.

Every stage but the last takes and returns the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import common, decontam, langid, linedup, packing, probminhash


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all columns in one, so that no name clashes with what an operator adds."""
    return docs.select(F.struct(*docs.columns).alias("_all"), "doc_id", "text")


def _with_text(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with text, and n_chars as its length, as `found` has it now."""
    whole = F.col("_all").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        whole = whole.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(whole.alias("_all")).select("_all.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null and empty texts, and texts without a letter, go.

    Whole texts count, however long; where languages tie the first by name is told, so the document stays. Repeated rows
    stay or go together; an empty table gives an empty one; columns of any name are returned as they are.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    found = langid.identify(_carried(docs).select("_all"), model, within="_all")
    return found.where(found.lang_pred != langid.UNDETERMINED).select("_all.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that an earlier document, or the same, has; documents of which nothing is left go.

    Of repeated rows, and of rows with one doc_id, the first by the table's order is the earlier; so of two equal texts
    the second goes. Null and empty texts, and those of blank lines, stay as they are. Long texts are handled whole; an
    empty table gives an empty one; columns of any name are returned as they are.
    """
    found = linedup.dedup(_carried(docs), **linedup.EVERY_LINE)
    return _with_text(found.where((F.size("removed") == 0) | (F.trim("text") != "")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by the table's order, of each class of near-duplicates.

    Null and empty texts stay, each a class of its own; of repeated rows the first stays. Long texts are compared whole; an
    empty table gives an empty one; columns of any name are returned as they are.
    """
    return probminhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the words that test items have in a window; documents with null texts, or of which nothing is left, go.

    Long texts are matched whole, repeated rows alike; a null or empty test item, or none at all, removes nothing; an
    empty table gives an empty one; columns of any name are returned as they are.
    """
    bench = common.read(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontam.decontaminate(_carried(docs), bench, remove="spans")
    return _with_text(found.where(F.trim("text") != ""), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4096 tokens.

    A null or empty text is its end id alone; a long one is cut into pieces; pieces of equal length go in the order of
    doc_id, and repeated rows each have a place. An empty table gives an empty one. Other columns than doc_id and text are
    not looked at.
    """
    return packing.pack(packing.pieces(docs.select("doc_id", "text")))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pack", pack),
]

#: Cross-parsing, word edits, components and tokens are beyond SQL; a test holds the stages, one after another, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.released(spark):
            docs = common.cut(stage(spark, docs, sf_dir), name)
    return docs
