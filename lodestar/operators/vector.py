"""Vector expressions in double precision, inside whole-stage code where Spark allows it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, summed from the first component to the last."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def is_valid(a: Column | str, dimension: int | None = None) -> Column:
    """Of the right length, finite and not all zero; false for null."""
    col = F.col(a) if isinstance(a, str) else a
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = finite & F.exists(col, lambda x: x != 0)
    return F.coalesce(fine & (F.size(col) == dimension) if dimension else fine, F.lit(False))


def normalise(a: Column | str) -> Column:
    """The unit vector; null for invalid ones."""
    col = F.col(a) if isinstance(a, str) else a
    n = norm(col)
    return F.when(is_valid(col), F.transform(col, lambda x: x.cast("double") / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity within [-1, 1]; null for invalid vectors and unequal lengths."""
    ok = is_valid(a) & is_valid(b) & (F.size(a) == F.size(b))
    value = dot(a, b) / (norm(a) * norm(b))
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


#: Vectors up to which a table of them is broadcast.
MOST_BROADCAST = 5_000


def counted(vectors: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """vectors with a hint to broadcast them if they are `most` at most; counting ends at one more than that."""
    return F.broadcast(vectors) if vectors.limit(most + 1).count() <= most else vectors


def lookup(vectors: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """vectors whose embedding_id is in ids(embedding_id), each id once; invalid ones are silently left out."""
    return vectors.where(is_valid("embedding", size)).join(ids.select("embedding_id").distinct(), "embedding_id", "left_semi")


#: The fields that a table of vectors must have.
FIELDS = (
    "embedding_id", "workspace_id", "project_id", "asset_id", "source_file_id", "asset_type", "file_type", "embedding_type", "model_name",
    "embedding_revision", "created_at_ts", "vector",
)


def ensure_table(spark: SparkSession, path: str, dimension: int, schema: T.StructType) -> bool:
    """True if a table of vectors was made at path, false if one was there and fits.

    One that lacks fields of FIELDS is made anew if it has no row, else it is an error, as is a vector of another
    dimension: one that is there is looked for, and the search ends at the first. schema is that of a new table.
    """
    if missing := sorted(set(FIELDS) - set(schema.fieldNames())):
        raise ValueError(f"the schema misses fields {missing}")
    try:
        table = spark.read.parquet(path)
    except AnalysisException:  # no table, or one without a file
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        return True
    if missing := sorted(set(FIELDS) - set(table.columns)):
        if not table.isEmpty():
            raise ValueError(f"the table at {path} misses fields {missing} and has rows; migrate it before searching")
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        return True
    if wrong := table.where(F.size("vector") != dimension).select(F.size("vector")).first():
        raise ValueError(f"the table at {path} has vectors of dimension {wrong[0]}, expected {dimension}")
    return False
