"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

Documents longer than a sequence are cut into pieces; every piece is then placed in an open sequence, or a new one, such
that the sum over all residual gaps g of (number of open sequences with gap g)² becomes smallest. Pieces go from the
longest to the shortest; where choices tie, the smallest gap that takes the piece wins, which is best fit.

Pieces are dealt by a hash over tasks of about `share` pieces, so that a task sees the same mix of lengths as any other
and memory is bounded. A task's nearly empty sequences are opened again and their pieces packed in a second round over
far fewer tasks; so the loss from dealing stays below a few sequences per task. Only lengths travel, never ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import cut, read

CAPACITY = 4096
#: Pieces that one task packs, and the fill below which a sequence is opened again for the second round.
SHARE = 50_000
REOPEN_BELOW = 0.97
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths are from 1 to capacity. Sequences are numbered from 0."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences by gap; a full one is closed and not counted
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        # Moving a sequence from gap g to g - s changes the sum by 2 (N[g - s] - N[g]) + 2; closing one, at g = s, by 1 - 2 N[s].
        change = 2 * (counts[: capacity - s + 1] - counts[s:]) + 2
        change[0] = 1 - 2 * counts[s]
        change[counts[s:] == 0] = np.iinfo(np.int64).max
        new = 2 * counts[capacity - s] + 1 if s < capacity else 0
        k = int(change.argmin())
        if change[k] <= new:
            gap = k + s
            own = by_gap[gap].pop()
            counts[gap] -= 1
        else:
            gap, own = capacity, made
            made += 1
        sequence[i], offset[i] = own, capacity - gap
        if gap > s:
            counts[gap - s] += 1
            by_gap[gap - s].append(own)
    return sequence, offset


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs(doc_id, text): the ids of the whole text, then the end id."""

    def run(batches):
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            found = encoder.documents(t.as_py() for t in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, x in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def _round(rows: DataFrame, tasks: int, capacity: int, nth: int) -> DataFrame:
    """rows with sequence_id, offset and the sequence's fill; sequence numbers are distinct over tasks and rounds."""

    def run(frames):
        parts = list(frames)
        part = pd.concat(parts) if parts else None
        if part is None or part.empty:
            return
        part = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", na_position="first")
        sequence, offset = sum_of_squares(part["length"].to_numpy(), capacity)
        fill = np.bincount(sequence, weights=part["length"].to_numpy())[sequence].astype(np.int64)
        task = int(part["_task"].iloc[0])
        yield part.assign(sequence_id=(task << 32) + (nth << 31) + sequence, offset=offset, fill=fill)

    # By a hash of the row's number in the written table: repeated rows are dealt evenly too.
    dealt = rows.withColumn("_task", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tasks)).cast("int"))
    dealt = dealt.repartitionById(tasks, F.col("_task"))
    return dealt.mapInPandas(run, f"{PIECES}, _task int, sequence_id long, offset long, fill long").drop("_task")


def pack(pieces_: DataFrame, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """The pieces with sequence_id and offset.

    Pieces have 1 to `capacity` tokens; a null or empty document has the end id alone. Repeated rows are placed one by
    one. An empty table gives an empty table.
    """
    rows = cut(pieces_, "pieces")
    tasks = max(1, -(-rows.count() // share))
    first = cut(_round(rows, tasks, capacity, 0), "packed")
    full = F.col("fill") >= int(REOPEN_BELOW * capacity)
    loose = first.where(~full).drop("sequence_id", "offset", "fill")
    again = _round(loose, max(1, -(-loose.count() // share)), capacity, 1)
    return first.where(full).unionByName(again).drop("fill")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(read(spark, sf_dir, "documents").select("doc_id", "text")))
