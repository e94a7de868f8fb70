"""File discovery, content readers and the sinks of snapshots."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The extensions that are read, by the kind of handler.
HANDLERS = {
    "document": ("md", "markdown", "txt", "docx", "pdf"),
    "image": ("jpg", "jpeg", "png", "webp", "gif", "bmp"),
    "video": ("mp4", "mov", "mkv", "webm", "avi"),
}
#: Limits of an archive that is opened: members, bytes unpacked, bytes of media, and ratio unpacked to packed.
MAX_MEMBERS, MAX_BYTES, MAX_MEDIA, MAX_RATIO = 10_000, 512 << 20, 256 << 20, 200.0


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative_path, extension, kind, size, modified) of the files under root that a handler reads; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = root.split("://", 1)[-1].rstrip("/")
    relative = F.regexp_replace("path", f"^.*?{re.escape(base)}/", "")
    files = files.withColumns({"relative_path": relative, "extension": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))})
    kind = F.lit(None).cast("string")
    for name, extensions in HANDLERS.items():
        kind = F.when(F.col("extension").isin(*extensions), name).otherwise(kind)
    found = files.withColumn("kind", kind).where("kind is not null")
    return found.select("path", "relative_path", "extension", "kind", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def import_plan(files: DataFrame) -> DataFrame:
    """A dry run: one row with the number of files, their bytes and the counts by extension, keys in order."""
    by = files.groupBy("extension").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return by.agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("extension", "n")))).alias("by_extension"))


def read_text(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, text, error) of Markdown and text files; bytes that are not UTF-8 are an error of their row alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown,txt}").load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), text.alias("text"))
    return rows.withColumn("error", F.when(F.col("text").isNull(), "not UTF-8"))


def archive_fault(data: bytes) -> str | None:
    """Why an archive is not opened; null if it may be."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
    except zipfile.BadZipFile:
        return "not an archive"
    total, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
    media = sum(i.file_size for i in infos if "/media/" in i.filename)
    for bad, why in ((len(infos) > MAX_MEMBERS, "too many members"), (total > MAX_BYTES, "too large"), (media > MAX_MEDIA, "too much media"), (total > MAX_RATIO * max(packed, 1), "suspicious ratio")):
        if bad:
            return why
    return None


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_markdown(data: bytes) -> str:
    """The text of a word-processing archive as Markdown: headings by their styles, list items, tables, paragraphs.

    Runs are joined as they are, tabs and line breaks become spaces. ValueError for what is no such archive or not a safe one.
    """
    if why := archive_fault(data):
        raise ValueError(why)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "word/document.xml" not in z.namelist():
            raise ValueError("no document part")
        try:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        except ElementTree.ParseError as error:
            raise ValueError(f"broken document part: {error}") from error

    def text(element) -> str:
        parts = (e.text or "" if e.tag == f"{_W}t" else " " if e.tag in (f"{_W}tab", f"{_W}br") else "" for e in element.iter())
        return " ".join("".join(parts).split())

    out: list[str] = []
    body = root.find(f"{_W}body")
    for e in body if body is not None else ():
        if e.tag == f"{_W}tbl":
            rows = [[text(c).replace("|", "\\|") for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            out.append("\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if lines else "")
        elif e.tag == f"{_W}p" and (own := text(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"(?:heading|标题)\s*([1-6])|title", (style.get(f"{_W}val") or "") if style is not None else "", re.I)
            item = e.find(f"{_W}pPr/{_W}numPr") is not None
            out.append(f"{'#' * int(level[1] or 1)} {own}" if level else f"- {own}" if item else own)
    return "\n\n".join(x for x in out if x)


#: What makes text of a file's bytes, by its extension; others may be given, also in place of these.
CONVERTERS: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys(("md", "markdown", "txt"), lambda data: data.decode("utf-8-sig")),
    "docx": docx_markdown,
}


def read_documents(spark: SparkSession, root: str, converters: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, relative_path, extension, sha256, text, error) of the documents under root, each by its extension's converter.

    Whatever a converter raises is its file's error and no other's; a kind without a converter is an error too. A file is
    converted by one task, one after another; a file without a byte is not listed by Spark and has no row. There is no
    converter of PDF text among CONVERTERS: give one for "pdf".
    """
    known = CONVERTERS | (converters or {})
    found = discover(spark, root).where("kind = 'document'").select("path", "relative_path", "extension")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    # Paths of one listing meet themselves: small keys; the contents are read where they are converted.
    kinds = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = content.where(kinds.isin(*HANDLERS["document"])).select("path", kinds.alias("extension"), F.sha2("content", 256).alias("sha256"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for kind, data in zip(batch.column("extension").to_pylist(), batch.column("content"), strict=True):
                try:
                    if kind not in known:
                        raise LookupError(f"no converter for .{kind}")
                    texts.append(known[kind](data.as_py() or b""))
                    errors.append(None)
                except Exception as error:  # a file's failure is its own
                    texts.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:300])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "sha256")), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "sha256", "text", "error"])

    return found.join(rows.mapInArrow(run, "path string, sha256 string, text string, error string"), "path")


def embedded_images(files: DataFrame, least_bytes: int = 1) -> DataFrame:
    """(path, member, sha256, occurrences) of the images in files(path, content) that are archives; equal ones count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, members, data = [], [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is None or archive_fault(content):
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i in z.infolist():
                        if "/media/" in i.filename and i.file_size >= least_bytes:
                            paths.append(path)
                            members.append(i.filename)
                            data.append(z.read(i))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(members, pa.string()), pa.array(data, pa.binary())], ["path", "member", "data"])

    rows = files.select("path", "content").mapInArrow(run, "path string, member string, data binary")
    rows = rows.withColumn("sha256", F.sha2("data", 256))
    return rows.groupBy("path", "sha256").agg(F.min("member").alias("member"), F.array_sort(F.collect_list("member")).alias("occurrences"))


#: The largest file that is staged.
MAX_STAGED = 2 << 30


def stage(spark: SparkSession, root: str, relative: str, data: bytes, most: int = MAX_STAGED) -> str:
    """Puts a file under root by its relative path and returns where; a file that is there is replaced at once or not at all.

    The path may not be absolute, empty or climb; backslashes count as slashes. ValueError for it, and for more than `most` bytes.
    """
    clean = relative.strip().replace("\\", "/")
    parts = [p for p in clean.split("/") if p not in ("", ".")]
    if clean.startswith("/") or not parts or ".." in parts or ":" in parts[0]:
        raise ValueError(f"unsafe path: {relative!r}")
    if len(data) > most:
        raise ValueError(f"{len(data)} bytes exceed {most}")
    jvm = spark.sparkContext._jvm
    final = jvm.org.apache.hadoop.fs.Path("/".join([root.rstrip("/"), *parts]))
    own = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}.tmp")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(final.getParent())
    out = fs.create(own, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    modes = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    modes[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    try:
        context.rename(own, final, modes)
    finally:
        fs.delete(own, False)
    return final.toString()


EVALUATION = (
    "request struct<workspace_id: string, query_type: string, query_text: string>, relevant_asset_ids array<string>, _corrupt_record string"
)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of a JSON-lines file; blank lines are skipped, broken ones are in _corrupt_record."""
    return spark.read.schema(EVALUATION).json(path)


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """(line, request, relevant_asset_ids, error) of a JSON-lines file of labelled cases; blank lines are skipped.

    A line that is no JSON object, or has no request, has an error that names it. Each file is read as one row, as only
    then its lines have numbers: files of labelled cases are made by hand.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "raw"))
    lines = lines.where(F.trim(F.regexp_replace("raw", "\\s", "")) != "")
    schema = EVALUATION.replace(", _corrupt_record string", "")
    # Spark makes a struct of nulls of what it cannot parse, so objects are told by their form first.
    whole = F.get_json_object("raw", "$").startswith("{")
    rows = lines.select((F.col("at") + 1).alias("line"), F.from_json("raw", schema).alias("c"), F.coalesce(whole, F.lit(False)).alias("whole"))
    why = F.when(~F.col("whole"), "no JSON object").when(F.col("c.request").isNull(), "no request")
    return rows.select("line", "c.*", F.when(why.isNotNull(), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), why)).alias("error"))


def write_snapshot(results: DataFrame, execution_id: str, path: str) -> None:
    """Writes a run's ranked results to a folder of its own under path; writing a run again, as a retry does, replaces it."""
    results.drop("execution_id").write.mode("overwrite").parquet(f"{path.rstrip('/')}/execution_id={execution_id}")
