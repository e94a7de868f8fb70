"""Structured Streaming forms of the import: incremental enrichment, generation guard, completion gate."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.text import retry_delays


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they arrive; the limit of files is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def current_only(events: DataFrame, sources: DataFrame) -> DataFrame:
    """The generation guard: deliveries for another generation of the source than the present one are dropped."""
    now = sources.select("source_file_id", "processing_generation")
    return events.join(now, "source_file_id").where(F.col("generation") == F.col("processing_generation")).drop("processing_generation")


def upsert(state: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """state with batch: the highest version of a key wins, the batch's at equal versions; a replayed batch changes nothing."""
    both = state.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    fields = [c for c in state.columns]
    best = both.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(version, "_new")).alias("_row"))
    return best.select("_row.*")


def completion(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """(source_file_id, stored, expected, state): waiting with fewer segments than expected, done, or error with more."""
    counts = stored.groupBy("source_file_id").agg(F.count_distinct("asset_id").alias("stored"))
    met = expected.join(counts, "source_file_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0).cast("long")))
    state = F.when(F.col("stored") < F.col("expected"), "waiting").when(F.col("stored") == F.col("expected"), "done").otherwise("error")
    return met.select("source_file_id", "stored", "expected", state.alias("state"))


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, dedupe: str | None = None) -> StreamingQuery:
    """Starts handling all files present, batch by batch, and then stops; after a failure it goes on from the checkpoint.

    Rows of a key given in `dedupe` that came before are dropped. The sink must be idempotent, as a batch that was not
    committed is handled again under its number.
    """
    rows = stream.dropDuplicates([dedupe]) if dedupe else stream
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retried(handle: Callable[[DataFrame, int], None], attempts: int = 5, first: float = 1.0, cap: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """A batch handler that is tried again after a failure, `attempts` times in all, after delays that double up to the cap.

    The last failure is the batch's, so the stream ends there and goes on from its checkpoint. The handler must be
    idempotent under its number, as run_batches() asks anyway.
    """

    def run(batch: DataFrame, number: int) -> None:
        for delay in [*retry_delays(attempts - 1, first, cap), None]:
            try:
                return handle(batch, number)
            except Exception:
                if delay is None:
                    raise
                sleep(delay)

    return run


def enrich_and_assign(assets: DataFrame, vectors: DataFrame, assign: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Assigns the assets of each batch to clusters and writes them under the batch's number, so that replays overwrite."""

    def handle(batch: DataFrame, number: int) -> None:
        fresh = batch.select("asset_id").join(vectors, "asset_id")
        assign(fresh).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return run_batches(assets, handle, checkpoint, "asset_id")
