"""Pieces the operators share: table access, cut lineage, text batching, memoised word hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import io
import posixpath
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that one numpy pass works on at once; bounds a Python worker's memory.
PASS_CHARS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is spark.checkpoint.dir. Where that is unset a temporary folder serves, but only with a local
    master: on a cluster a machine-local folder would lose the files with the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return f"file://{_local}"


_local: str | None = None


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"


_made: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes all tables that this process has cut; call it once no result that reads them is needed."""
    while _made:
        delete(spark, _made.pop())


@contextlib.contextmanager
def released(spark: SparkSession):
    """Deletes, at its end, the tables that were cut within it, but for the last, which is the result."""
    before = len(_made)
    yield
    for path in _made[before:-1]:
        delete(spark, path)
    del _made[before:-1]


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there: ends the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Kinds of plan nodes that keep the rows of the scan below them as they are, but for rows that they drop.
_PLAIN_NODES = ("Project", "Filter", "SubqueryAlias")
#: Bytes of file names, and of a counted table, that are broadcast; beyond it there is another way.
MOST_BROADCAST_BYTES = 64_000_000


def _is_parquet_scan(docs: DataFrame) -> bool:
    """Whether docs is one scan of Parquet files, with projections and filters at most."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in _PLAIN_NODES:
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat" and "_metadata" not in list(plan.schema().fieldNames())


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _row long: a number of each row, ascending in the table's order, that every scan gives alike.

    Over Parquet files it is the file's place among the file names times 2^40, plus the row's place in the file; splits,
    and so the number of cores, don't matter. Any other input, and one of more file names than are broadcast, is numbered
    once and written to the shared folder. docs must not have a column _row.
    """
    if _is_parquet_scan(docs):
        files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
        if sum(map(len, files)) + 64 * len(files) <= MOST_BROADCAST_BYTES:
            names = docs.sparkSession.createDataFrame(list(enumerate(files)), "_file long, _name string")
            rows = docs.select(*docs.columns, F.col("_metadata.file_path").alias("_of"), F.col("_metadata.row_index").alias("_at"))
            rows = rows.join(F.broadcast(names), F.col("_of") == F.col("_name"), "left")
            place = F.coalesce("_file", F.raise_error(F.lit("the table has a new file")).cast("long"))
            return rows.select(*docs.columns, (F.shiftleft(place, 40) + F.col("_at")).alias("_row"))
    return cut(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def side(df: DataFrame, most: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """df, a written table, with a hint to broadcast it if it has `most` bytes at most; a larger one meets others by a shuffle."""

    def size(field: T.StructField):
        if isinstance(field.dataType, T.ArrayType):
            return F.coalesce(F.size(field.name), F.lit(0)) * (24 if isinstance(field.dataType.elementType, T.StructType) else 8) + 24
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16 if isinstance(field.dataType, T.StringType) else F.lit(8)

    # Twice the bytes of a row: hash tables keep pointers and free places.
    total = sum((size(f) for f in df.schema.fields), F.lit(16)) * 2
    return F.broadcast(df) if (df.agg(F.sum(total)).first()[0] or 0) <= most else df


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that cut() or a writer made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def store(folder: str, name: str, data: bytes) -> None:
    """Writes a file under another name and moves it, so that a task that is run again or twice does no harm."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    own, final = posixpath.join(path, f".{name}.{uuid.uuid4().hex}"), posixpath.join(path, name)
    with fs.open_output_stream(own) as f:
        f.write(data)
    if not isinstance(fs, pa.fs.LocalFileSystem) and fs.get_file_info(final).type != pa.fs.FileType.NotFound:
        fs.delete_file(final)
    fs.move(own, final)


def load(folder: str, name: str) -> bytes:
    fs, path = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(posixpath.join(path, name)) as f:
        return f.read()


def save_arrays(folder: str, name: str, **arrays: np.ndarray) -> None:
    file = io.BytesIO()
    np.savez(file, **arrays)
    store(folder, name, file.getvalue())


def load_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(load(folder, name))) as data:
        return dict(data)


def passes(texts: list[str | None], most: int = PASS_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, texts) of at most about `most` characters; a longer text comes in several pieces."""
    rows: list[int] = []
    parts: list[str] = []
    n = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        for at in range(0, len(text), most):
            piece = text if len(text) <= most else text[at : at + most]
            if n and n + len(piece) > most:
                yield rows, parts
                rows, parts, n = [], [], 0
            rows.append(i)
            parts.append(piece)
            n += len(piece)
    if parts:
        yield rows, parts


#: Rows of an Arrow batch of whole texts, where the session leaves Spark's 10,000: JVM and Python hold several batches at once.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_texts(docs: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """docs.mapInArrow(run, schema) in batches of BATCH_ROWS, after which workers give free memory back.

    Batches are as the session says if it says so. Spark reads the setting when a plan is executed, so it stays.
    """
    conf = docs.sparkSession.conf
    if conf.get(_BATCH, "0") == "0":
        conf.set(_BATCH, str(BATCH_ROWS))

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return docs.mapInArrow(trimmed, schema)


def give_back() -> None:
    """Returns memory that is free within the process to the system; a worker that waits for its next task needs none."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


class Memo(dict):
    """A two-generation cache of make(key): the younger half is kept when `size` keys are reached.

    Memory stays bounded whatever the vocabulary; a lookup that hits costs one dict access.
    """

    def __init__(self, make: Callable | None = None, size: int = 300_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            if self.make is None:
                raise KeyError(key)
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def unknown(self, keys) -> list:
        """Those of the distinct keys that neither generation holds."""
        return [k for k in set(keys) if k not in self and k not in self.old]


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64), vectorised; uint64 in, uint64 out."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_fields(schema: T.StructType, more: str) -> T.StructType:
    """schema and the fields of the DDL string `more` after it."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])
