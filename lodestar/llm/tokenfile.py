"""Token-id files of patched frame-of-reference blocks.

A shard file holds whole documents, one after another in ascending doc_id order:

    magic            8 bytes, "LSPFOR1\\n"
    counts           4 x uint64: documents, ids, blocks, ids in a block
    valid            uint8 a document: 0 for a null doc_id
    doc_ids          int64 a document
    starts           uint64 a document, and one more: its first id's number in this shard
    block starts     uint64 a block, and one more: its first byte in the payload
    payload          the blocks

A block has min uint32, width uint8, a zero byte, exceptions uint16, the packed words (uint64), the exceptions'
positions (uint16) and their values (uint32). The minimum is subtracted; the width holds PERCENTILE of the differences;
larger ones are exceptions, of which only the low bits are packed. Value j of each 64 begins at bit j * width. All numbers
are little-endian. The last block is filled up with its shard's last id.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, load, new_path, numbered, read, store

MAGIC = b"LSPFOR1\n"
BLOCK = 1024
PERCENTILE = 95
#: Ids after which a shard is closed: bounds a worker's memory, as a longer document only exceeds it alone.
SHARD_IDS = 500_000


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width -> rows of BLOCK / 64 * width words."""
    v = values.reshape(len(values), -1, 64)
    out = np.zeros((*v.shape[:2], width), np.uint64)
    for j in range(64 if width else 0):
        word, off = divmod(j * width, 64)
        out[:, :, word] |= v[:, :, j] << np.uint64(off)
        if off + width > 64:
            out[:, :, word + 1] |= v[:, :, j] >> np.uint64(64 - off)
    return out.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int, block: int) -> np.ndarray:
    w = words.reshape(len(words), block // 64, width)
    out = np.zeros((*w.shape[:2], 64), np.uint64)
    for j in range(64 if width else 0):
        word, off = divmod(j * width, 64)
        out[:, :, j] = w[:, :, word] >> np.uint64(off)
        if off + width > 64:
            out[:, :, j] |= w[:, :, word + 1] << np.uint64(64 - off)
    return (out & np.uint64((1 << width) - 1)).reshape(len(words), block)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """(payload, block starts) of uint32 ids."""
    if not len(ids):
        return b"", np.zeros(1, np.uint64)
    n = -(-len(ids) // block)
    full = np.full(n * block, ids[-1], np.uint64)
    full[: len(ids)] = ids
    full = full.reshape(n, block)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    width = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1].astype(np.int64)
    limit = np.left_shift(np.uint64(1), width.astype(np.uint64))
    patched = rest >= limit[:, None]
    packed: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        words = _pack(rest[rows] & np.uint64((1 << w) - 1), w).astype("<u8")
        for r, x in zip(rows.tolist(), words, strict=True):
            packed[r] = x.tobytes()
    out = []
    starts = np.zeros(n + 1, np.uint64)
    for i in range(n):
        where = np.flatnonzero(patched[i])
        head = int(low[i]).to_bytes(4, "little") + bytes((int(width[i]), 0)) + len(where).to_bytes(2, "little")
        out.append(head + packed[i] + where.astype("<u2").tobytes() + rest[i, where].astype("<u4").tobytes())
        starts[i + 1] = starts[i] + np.uint64(len(out[-1]))
    return b"".join(out), starts


def decode_blocks(payload: bytes, starts: np.ndarray, n: int, block: int = BLOCK, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all), as uint32; n is the number of ids in the whole payload."""
    last = len(starts) - 1 if last is None else last
    out = np.zeros((last - first, block), np.uint64)
    heads = [payload[s : s + 8] for s in starts[first:last].tolist()]
    width = np.array([h[4] for h in heads], np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        size = block // 64 * w * 8
        raw = b"".join(payload[s + 8 : s + 8 + size] for s in starts[first:last][rows].tolist())
        out[rows] = _unpack(np.frombuffer(raw, "<u8").reshape(len(rows), -1), w, block) if w else 0
    for i, (h, s) in enumerate(zip(heads, starts[first:last].tolist(), strict=True)):
        if k := int.from_bytes(h[6:8], "little"):
            at = s + 8 + block // 64 * h[4] * 8
            out[i, np.frombuffer(payload, "<u2", k, at)] = np.frombuffer(payload, "<u4", k, at + 2 * k)
        out[i] += np.uint64(int.from_bytes(h[:4], "little"))
    return out.reshape(-1)[: n - first * block].astype(np.uint32)


def encode_shard(doc_ids: list[int | None], ids: list, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """A shard file's bytes; `ids` has each document's, as an array or as bytes."""
    own = [np.frombuffer(x, "<u4") for x in ids]
    starts = np.cumsum([0, *map(len, own)]).astype("<u8")
    payload, blocks = encode_blocks(np.concatenate(own) if own else np.zeros(0, np.uint32), block, percentile)
    return b"".join(
        (
            MAGIC,
            np.array([len(doc_ids), starts[-1], len(blocks) - 1, block], "<u8").tobytes(),
            np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            starts.tobytes(),
            blocks.astype("<u8").tobytes(),
            payload,
        )
    )


class Shard:
    """Random access to a shard file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        docs, self.n, blocks, self.block = np.frombuffer(data, "<u8", 4, 8).tolist()
        at = 40
        valid = np.frombuffer(data, np.uint8, docs, at)
        ids = np.frombuffer(data, "<i8", docs, at := at + docs)
        self.doc_ids = [i if v else None for i, v in zip(ids.tolist(), valid.tolist(), strict=True)]
        self.starts = np.frombuffer(data, "<u8", docs + 1, at := at + 8 * docs)
        self.blocks = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * (docs + 1))
        self.payload = data[at + 8 * (blocks + 1) :]

    def ids(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document; only the blocks that it touches are read."""
        a, b = int(self.starts[k]), int(self.starts[k + 1])
        first = a // self.block
        part = decode_blocks(self.payload, self.blocks, self.n, self.block, first, -(-b // self.block))
        return part[a - first * self.block : b - first * self.block]

    def all_ids(self) -> np.ndarray:
        return decode_blocks(self.payload, self.blocks, self.n, self.block)


def _key(doc_id: int | None, row: int) -> tuple:
    """The place of a row in the files: a null doc_id first, then by doc_id, then in the table's order."""
    return doc_id is not None, doc_id or 0, row


def _bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """Keys that part rows(doc_id, _row) into `parts` parts of about as many rows; some 40 rows a part are fetched."""
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("_row"), F.lit(1_000_000)) <= 1_000_000 * min(1.0, 40 * parts / max(1, n)))
    keys = sorted(_key(r["doc_id"], r["_row"]) for r in some.select("doc_id", "_row").collect())
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def encoded(rows: DataFrame, bounds: list[tuple], tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """(doc_id, _row, part, wide, ids) of rows(doc_id, _row, text): the ids of each text and the end id, part by `bounds`.

    Ids are unsigned 16-bit integers where all of a text are below 65,536, else `wide` 32-bit ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "_row", "part", "wide", "ids"])

        for batch in batches:
            rows, n = [], 0
            found = encoder.documents(t.as_py() for t in batch.column(2))
            for doc, row, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found, strict=True):
                ids = np.frombuffer(own, np.uint32)
                wide = bool(ids.max() >= 1 << 16)
                part = bisect.bisect_right(bounds, _key(doc, row))
                rows.append((doc, row, part, wide, own if wide else ids.astype("<u2").tobytes()))
                n += len(ids)
                if n >= 4_000_000:
                    yield batch_of(rows)
                    rows, n = [], 0
            if rows:
                yield batch_of(rows)

    return rows.select("doc_id", "_row", "text").mapInArrow(run, "doc_id long, _row long, part int, wide boolean, ids binary")


def write(docs: DataFrame, folder: str, tokenizer: str = tokens.TOKENIZER, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the token ids of docs(doc_id, text) to shard files in `folder`; returns the manifest.

    Manifest: part int, shard int, file string, n_docs long, n_tokens long, start long (ids of all documents before the
    shard's first). Documents go in ascending doc_id order, a null id first; rows of one id, repeated ones too, go in the
    table's order and are dealt over tasks by it. A null or empty text is the end id alone, a long one is encoded whole;
    an empty table writes no file; columns by other names are not looked at. `folder` is a URI that every executor can
    write to. Texts are encoded once, where they are read, and only their ids are sorted, so the parts' bounds are found
    beforehand, from the ids of documents alone.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(docs.select(F.col("doc_id").cast("long"), "text"))
    rows = encoded(rows, _bounds(rows, parts), tokenizer)
    rows = rows.repartitionById(parts, F.col("part")).drop("part").sortWithinPartitions("doc_id", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        doc_ids, ids, n, shard = [], [], 0, 0

        def close():
            name = f"part-{part:06d}-{shard:06d}.pfor"
            store(folder, name, encode_shard(doc_ids, ids))
            row = {"part": [part], "shard": [shard], "file": [name], "n_docs": [len(ids)], "n_tokens": [n]}
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            for doc, wide, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = np.frombuffer(raw.as_py(), "<u4" if wide else "<u2")
                doc_ids.append(doc)
                ids.append(own if wide else own.astype("<u4"))
                n += len(own)
                if n >= shard_ids:
                    yield close()
                    doc_ids, ids, n, shard = [], [], 0, shard + 1
        if ids:
            yield close()

    manifest = cut(rows.mapInArrow(run, "part int, shard int, file string, n_docs long, n_tokens long"), "manifest")
    spark = docs.sparkSession
    # One row a partition comes to the driver; within a partition a window sums up.
    totals = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in totals)]).tolist()
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before[:-1], strict=True)], "part int, base long")
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return manifest.withColumn("own", own).join(base, "part").withColumn("start", F.col("base") + F.col("own")).drop("own", "base")


def read_back(manifest: DataFrame, folder: str, files: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that the manifest lists."""

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(load(folder, name))
                raw = shard.all_ids().astype("<u4").tobytes()
                at = shard.starts.astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = manifest.select("file", "start").repartition(max(1, files), "file")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    manifest = cut(write(read(spark, sf_dir, "documents").select("doc_id", "text"), folder), "starts")
    return read_back(manifest, folder, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
