"""What the paths of a cluster's members tell: its directories, the words of directory names, and files that speak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import checks, text

#: How many directories, words and files are told, and from how many members on a word is.
DIRECTORIES, TERMS, FILES, LEAST = 5, 8, 5, 2


def normalised(path: Column) -> Column:
    """A relative path with forward slashes and without empty or '.' parts; null for blank, absolute and climbing ones."""
    clean = F.regexp_replace(F.trim(path), r"\\", "/")
    parts = F.filter(F.split(clean, "/"), lambda p: (p != "") & (p != "."))
    fine = (clean != "") & ~clean.startswith("/") & ~F.array_contains(parts, "..")
    return F.when(fine, F.array_join(parts, "/"))


def deepest_term(path: Column, generic: tuple[str, ...], suffixes: tuple[str, ...]) -> Column:
    """The last directory name that tells what is inside; null if none does."""
    parts = F.filter(F.split(text.directory(path), "/"), lambda p: checks.semantic_term(p, F.lower(F.trim(p)).isin(*generic), suffixes))
    return F.trim(F.try_element_at(parts, F.lit(-1)))


def _ranked(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first rows of each cluster; Spark cuts every partition's to as many before they meet."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).where(F.col("rank") <= most)


def contexts(members: DataFrame, generic: tuple[str, ...], suffixes: tuple[str, ...]) -> DataFrame:
    """(cluster_id, kind, rank, value, n) of all clusters of members(cluster_id, asset_id, relative_path) at once.

    kind directory: the most frequent directories of files, ties by name, n their members. kind term: each path's deepest
    telling directory name, those of LEAST members and more. kind file: distinct paths, those with a readable name first, n
    their members. Members without a usable path count for nothing; a cluster of such members has no row.
    """
    rows = members.select("cluster_id", normalised(F.col("relative_path")).alias("path")).where("path is not null")
    # One row for each path and cluster from here on: a file with many assets is counted before it is looked at.
    paths = rows.groupBy("cluster_id", "path").agg(F.count(F.lit(1)).alias("n"))
    paths = paths.withColumns({"directory": text.directory(F.col("path")), "term": deepest_term(F.col("path"), generic, suffixes)})

    def counted(column: str, least: int) -> DataFrame:
        return paths.where(F.col(column) != "").groupBy("cluster_id", F.col(column).alias("value")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    found = {
        "directory": _ranked(counted("directory", 1), DIRECTORIES, F.desc("n"), "value"),
        "term": _ranked(counted("term", LEAST), TERMS, F.desc("n"), "value"),
        "file": _ranked(paths.select("cluster_id", F.col("path").alias("value"), "n"), FILES, ~checks.readable_name(F.col("value")), "value"),
    }
    out = None
    for kind, df in found.items():
        df = df.select("cluster_id", F.lit(kind).alias("kind"), "rank", "value", "n")
        out = df if out is None else out.unionByName(df)
    return out
