"""Tables cut in the folder that driver and executors share, each run with a list of its own."""

from __future__ import annotations

import atexit
import io
import posixpath
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of the driver, which only a local master may use."""
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


class Scratch:
    """Tables of one run. Leaving the `with` block deletes those that are not kept, also after an error."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            self.delete(path)
        self.paths = []

    def path(self, name: str) -> str:
        self.paths.append(f"{shared_dir(self.spark)}/lodestar/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def cut(self, df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
        """df, written once and read from there: its lineage ends, and lost executors cost nothing. A file has file_rows rows at most, if not 0."""
        path = self.path(name)
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """cut(), for a result that outlives the run; it is no longer on the list."""
        out = self.cut(df, name)
        self.paths.pop()
        return out

    def drop(self, *paths: str) -> None:
        """Deletes tables before the run's end."""
        for path in paths:
            self.paths.remove(path)
            self.delete(path)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def save_arrays(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Writes a file under a name of its own and moves it into place, so that a task that runs twice does no harm."""
    data = io.BytesIO()
    np.savez(data, **arrays)
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    own, final = posixpath.join(path, f".{name}.{uuid.uuid4().hex}"), posixpath.join(path, name)
    with fs.open_output_stream(own) as f:
        f.write(data.getvalue())
    if not isinstance(fs, pyarrow.fs.LocalFileSystem) and fs.get_file_info(final).type != pyarrow.fs.FileType.NotFound:
        fs.delete_file(final)
    fs.move(own, final)


def load_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(posixpath.join(path, name)) as f, np.load(io.BytesIO(f.read())) as data:
        return dict(data)
