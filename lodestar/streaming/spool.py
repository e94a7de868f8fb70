"""Durable imports: manifests of ready segments in a spool, and the completion of sources as keyed state with a timer.

A manifest tells of one segment that is ready, and how many its source's generation has. Manifests are written aside and
moved into place, so the spool holds whole ones only; what a crash leaves aside is moved when the import starts again. A
stream reads the spool; its checkpoint has the files read and the state of every source, so a stream that is killed goes
on where it was, and a delivery that comes twice changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

MANIFEST = "source_file_id string, generation int, asset_id string, expected int, bytes long, attempt int"
#: Manifest files that wait at most, and their bytes of media.
MAX_FILES, MAX_BYTES = 100_000, 1 << 40
#: Settings of a query with timers: the store of its state, and no batches without rows, which would never end a run.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class SpoolFull(RuntimeError):
    """The spool holds as much as it may; what reads it must get on first."""


class Spool:
    """A spool under root, a folder that driver and executors share: staged/ while being written, ready/ for the stream."""

    def __init__(self, spark: SparkSession, root: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES):
        self.spark, self.root, self.max_files, self.max_bytes = spark, root.rstrip("/"), max_files, max_bytes
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in ("staged", "ready"):
            self._fs.mkdirs(self._path(f"{self.root}/{name}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")))

    def ready(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/ready")

    def put(self, manifests: DataFrame, name: str) -> int:
        """Adds manifests under a name, as files that appear whole; how many files are new. The same name again adds none.

        SpoolFull if there is no room, before anything is written. A crash while writing leaves nothing, one while moving
        leaves what recover() moves.
        """
        waiting = self._names("ready")
        if any(n.startswith(f"{name}-") for n in waiting):
            return 0
        held = self.ready().agg(F.sum("bytes")).first()[0] or 0 if waiting else 0
        if waiting and (len(waiting) >= self.max_files or held + (manifests.agg(F.sum("bytes")).first()[0] or 0) > self.max_bytes):
            raise SpoolFull(f"{len(waiting)} files and {held} bytes wait")
        staged = f"{name}={uuid.uuid4().hex}"
        fields = [c.split()[0] for c in MANIFEST.split(", ")]
        manifests.select(*fields).write.parquet(f"{self.root}/staged/{staged}")
        return self._move(staged)

    def _move(self, staged: str) -> int:
        """Moves a staged folder's files to ready/, each by a name that its content's first move decides."""
        name, folder, moved = staged.split("=")[0], self._path(f"{self.root}/staged/{staged}"), 0
        parts = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        for part in parts:
            # The part's number names the file: a second writer of one name finds it taken.
            to = self._path(f"{self.root}/ready/{name}-{part.split('-')[1]}.parquet")
            if not self._fs.exists(to):
                moved += self._fs.rename(self._path(f"{self.root}/staged/{staged}/{part}"), to)
        self._fs.delete(folder, True)
        return moved

    def recover(self) -> int:
        """Moves what was wholly written before a crash and drops the rest; how many files were moved."""
        moved = 0
        for staged in self._names("staged"):
            if self._fs.exists(self._path(f"{self.root}/staged/{staged}/_SUCCESS")):
                moved += self._move(staged)
            else:
                self._fs.delete(self._path(f"{self.root}/staged/{staged}"), True)
        return moved

    def release(self, ended: DataFrame) -> int:
        """Deletes the files all of whose manifests are of sources in ended(source_file_id, generation), or older; how many."""
        last = ended.groupBy("source_file_id").agg(F.max("generation").alias("_last"))
        rows = self.ready().select("*", F.input_file_name().alias("_file")).join(F.broadcast(last), "source_file_id", "left")
        done = F.min(F.coalesce(F.col("generation") <= F.col("_last"), F.lit(False)).cast("int"))
        files = [r[0] for r in rows.groupBy("_file").agg(done.alias("done")).where("done = 1").select("_file").toLocalIterator()]
        for file in files:
            self._fs.delete(self._path(file), False)
        return len(files)

    def stream(self, files_per_batch: int = 1) -> DataFrame:
        """The manifests as they become ready; the limit of files is the back-pressure."""
        self.recover()
        return self.spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", files_per_batch).parquet(f"{self.root}/ready")


ENDED = "source_file_id string, generation int, state string, stored long, expected int"


class Completion(StatefulProcessor):
    """Ends each generation of a source once: done with as many segments as expected, error with more or after the patience.

    State: the present generation with what it expects and whether it ended, and the segments seen. A later generation
    starts anew, an earlier one's deliveries are stale and dropped, as are segments seen before.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "generation int, expected int, stored long, ended boolean")
        self.seen = handle.getMapState("seen", "asset_id string", "attempt int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.now.get() if self.now.exists() else None
        generation, expected, stored, ended = held or (-1, 0, 0, False)
        for batch in rows:
            for row in batch.sort_values(["generation", "asset_id"]).itertuples():
                if row.generation < generation:
                    continue
                if row.generation > generation:
                    generation, expected, stored, ended = int(row.generation), int(row.expected), 0, False
                    self.seen.clear()
                    self._wait(timerValues)
                if not self.seen.containsKey((row.asset_id,)):
                    self.seen.updateValue((row.asset_id,), (int(row.attempt),))
                    stored += 1
        state = None
        if not ended and stored >= expected:
            ended, state = True, "done" if stored == expected else "error"
            self._wait(None)
        self.now.update((generation, expected, stored, ended))
        yield self._row(key, generation, state, stored, expected)

    def _wait(self, timers) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if timers is not None:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        generation, expected, stored, ended = self.now.get()
        self.now.update((generation, expected, stored, True))
        yield self._row(key, generation, None if ended else "error", stored, expected)

    @staticmethod
    def _row(key, generation: int, state: str | None, stored: int, expected: int) -> pd.DataFrame:
        rows = [] if state is None else [(key[0], generation, state, stored, expected)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ENDED.split(", ")])

    def close(self) -> None:
        pass


def completions(manifests: DataFrame, patience_ms: int) -> DataFrame:
    """(source_file_id, generation, state, stored, expected) of a stream of manifests: a row when a generation ends, once."""
    fine = manifests.where("source_file_id is not null and asset_id is not null and generation >= 0 and expected > 0")
    return fine.groupBy("source_file_id").transformWithStateInPandas(
        statefulProcessor=Completion(patience_ms), outputStructType=ENDED, outputMode="Append", timeMode="ProcessingTime"
    )


def run(manifests: DataFrame, sink: str, checkpoint: str, patience_ms: int = 3_600_000, before=None) -> StreamingQuery:
    """Starts writing completions of the manifests that are there to sink, a folder for each batch; then it stops.

    A batch that was not committed is handled again under its number and replaces what it had written. `before` is called
    with a batch and its number first. Patience is looked at when rows arrive, of any source. The state is kept by RocksDB;
    a query has the settings of its start, so the session's stay as they were.
    """
    spark = manifests.sparkSession
    kept = {key: spark.conf.get(key) for key in _SETTINGS}

    def handle(batch: DataFrame, number: int) -> None:
        if before:
            before(batch, number)
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        return completions(manifests, patience_ms).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def finalised(assets: DataFrame, sources: DataFrame, ended: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets, sources) after ended(source_file_id, generation, state), of which the last generation counts.

    A source that is done loses its assets of other generations and is completed; one with an error is failed and keeps
    all. A generation that is no longer the source's own ends nothing.
    """
    last = ended.groupBy("source_file_id").agg(F.max_by(F.struct("generation", "state"), "generation").alias("_end"))
    met = sources.join(last, "source_file_id", "left")
    holds = F.coalesce(F.col("_end.generation") == F.col("processing_generation"), F.lit(False))
    status = F.when(holds & (F.col("_end.state") == "done"), "completed").when(holds, "failed").otherwise(F.col("processing_status"))
    done = met.where(holds & (F.col("_end.state") == "done")).select("source_file_id", F.col("_end.generation").alias("_kept"))
    left = assets.join(done, "source_file_id", "left").where("_kept is null or generation = _kept").drop("_kept")
    return left, met.withColumn("processing_status", status).drop("_end")
