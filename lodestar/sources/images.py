"""Images in documents and image files: occurrences by document part, what an image's bytes tell, and which ones count.

A file is read by one task, row by row: a batch never holds more than one file's images beside the file. Only what is
found leaves the task: hashes, sizes and, where asked for, the bytes of images that count.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pdf
from .files import archive_fault

#: The largest image, the least sides and area of one that counts, lightness from which one is blank.
MAX_BYTES, MIN_WIDTH, MIN_HEIGHT, MIN_AREA, BLANK, SHRUNK = 64 << 20, 32, 32, 4096, 250, 96
#: Media types by format.
MIME = {"PNG": "image/png", "JPEG": "image/jpeg", "GIF": "image/gif", "BMP": "image/bmp", "WEBP": "image/webp"}
#: Names of the tags that are told, in the first directory and in the one of its details.
TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist",
    0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized",
    0x920A: "FocalLength", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA434: "LensModel",
}
_DETAILS = 0x8769
_DATES = ("DateTimeOriginal", "DateTimeDigitized", "DateTime")
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


class Fault(ValueError):
    """What is wrong with an image or a document."""


# Heads of image files


def head(data: bytes) -> tuple[str, int, int, str]:
    """(format, width, height, colour mode) by the first bytes of a PNG, JPEG, GIF, BMP or WebP."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            w, h, depth, kind = struct.unpack(">IIBB", data[16:26])
            return "PNG", w, h, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[kind] if depth > 1 or kind else "1"
        if data[:2] == b"\xff\xd8":
            for kind, at, size in segments(data):
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and size >= 6:
                    h, w, parts = struct.unpack(">HHB", data[at + 1 : at + 6])
                    return "JPEG", w, h, {1: "L", 3: "RGB", 4: "CMYK"}[parts]
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return "GIF", *struct.unpack("<HH", data[6:10]), "P"
        if data[:2] == b"BM":
            w, h, _, bits = struct.unpack("<iiHH", data[18:30])
            return "BMP", abs(w), abs(h), "P" if bits <= 8 else "RGB"
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                return "WEBP", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, "RGBA" if data[20] & 16 else "RGB"
            if kind == b"VP8L" and data[20] == 0x2F:
                bits = int.from_bytes(data[21:25], "little")
                return "WEBP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "RGBA" if bits >> 28 & 1 else "RGB"
            if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
                w, h = struct.unpack("<HH", data[26:30])
                return "WEBP", w & 0x3FFF, h & 0x3FFF, "RGB"
    except (struct.error, KeyError, IndexError):
        pass
    raise Fault("invalid_image")


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(kind, begin, size) of a JPEG's segments up to its picture."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0x01 or 0xD0 <= kind <= 0xD9:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            return
        yield kind, at + 4, size - 2
        if kind == 0xDA:
            return
        at += 2 + size


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(name, content) of a PNG's chunks."""
    at = 8
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + size > len(data):
            raise Fault("invalid_image")
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


# Facts of cameras


def _value(data: bytes, order: str, kind: int, count: int, at: int):
    size = _SIZES[kind] * count
    raw = data[at : at + size]
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
    if kind in (1, 7):
        return raw.hex() if count > 1 else str(raw[0])
    if kind in (5, 10):
        pairs = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
        return ", ".join(f"{a}/{b}" for a, b in zip(pairs[::2], pairs[1::2], strict=True))
    return ", ".join(map(str, struct.unpack(f"{order}{count}{ {3: 'H', 4: 'I', 9: 'i'}[kind]}", raw)))


def tiff_facts(data: bytes) -> dict[str, str]:
    """The known tags of a TIFF head of either byte order: of its first directory, then of the one with details.

    Every offset is held against the data's end, and each directory is read once; what points outside is a Fault.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise Fault("no TIFF head")
    todo, seen, out = [struct.unpack(f"{order}I", data[4:8])[0]], set(), {}
    while todo:
        at = todo.pop(0)
        if at in seen:
            continue
        seen.add(at)
        if at + 2 > len(data):
            raise Fault("a directory outside the data")
        count = struct.unpack(f"{order}H", data[at : at + 2])[0]
        if at + 2 + 12 * count > len(data):
            raise Fault("entries outside the data")
        for i in range(count):
            entry = at + 2 + 12 * i
            tag, kind, n = struct.unpack(f"{order}HHI", data[entry : entry + 8])
            if kind not in _SIZES or n == 0:
                continue
            place = entry + 8 if _SIZES[kind] * n <= 4 else struct.unpack(f"{order}I", data[entry + 8 : entry + 12])[0]
            if place + _SIZES[kind] * n > len(data):
                raise Fault("a value outside the data")
            if tag == _DETAILS and kind == 4:
                todo.append(struct.unpack(f"{order}I", data[place : place + 4])[0])
            elif tag in TAGS:
                out.setdefault(TAGS[tag], _value(data, order, kind, n, place))
    return out


def camera_facts(data: bytes) -> dict[str, str]:
    """tiff_facts() of a JPEG or PNG, none without them."""
    if data[:2] == b"\xff\xd8":
        found = (data[at + 6 : at + size] for kind, at, size in segments(data) if kind == 0xE1 and data[at : at + 6] == b"Exif\0\0")
    else:
        found = (c for name, c in chunks(data) if name == b"eXIf") if data[:4] == b"\x89PNG" else iter(())
    own = next(found, None)
    return tiff_facts(own) if own is not None else {}


# Pictures of PNG files, line by line


def _unfilter(kind: int, line: np.ndarray, before: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        rows = np.zeros(-(-len(line) // step) * step, np.uint8)
        rows[: len(line)] = line
        return np.cumsum(rows.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
    if kind == 2:
        return line + before
    out, up = line.tolist(), before.tolist()
    for i in range(len(out)):
        left, above = out[i - step] if i >= step else 0, up[i]
        if kind == 3:
            out[i] = (out[i] + (left + above) // 2) & 255
        elif kind == 4:
            corner = up[i - step] if i >= step else 0
            a, b, c = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
            out[i] = (out[i] + (left if a <= b and a <= c else above if b <= c else corner)) & 255
        else:
            raise Fault("invalid_image")
    return np.array(out, np.uint8)


def png_lines(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(lightness, opacity or none) of a PNG's lines, 8 bits a pixel, unpacked as they are asked for.

    An interlaced one has the lines of its passes, in which every pixel comes once. Opacity is of the modes that have it.
    """
    w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", data[16:29])
    parts = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if parts is None or depth not in (1, 2, 4, 8, 16) or not w or not h:
        raise Fault("invalid_image")
    palette = next((np.frombuffer(c[: len(c) // 3 * 3], np.uint8).reshape(-1, 3) for n, c in chunks(data) if n == b"PLTE"), None)
    packed = (c for n, c in chunks(data) if n == b"IDAT")
    inflate, held = zlib.decompressobj(), bytearray()

    def take(n: int) -> bytes:
        while len(held) < n:
            source = inflate.unconsumed_tail or next(packed, None)
            more = inflate.flush() if source is None else inflate.decompress(source, 1 << 16)
            if source is None and not more:
                raise Fault("invalid_image")
            held.extend(more)
        out = bytes(held[:n])
        del held[:n]
        return out

    weights = np.array([19595, 38470, 7471], np.int64)
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if laced else [(0, 0, 1, 1)]
    for x0, y0, dx, dy in passes:
        width, height = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if width <= 0 or height <= 0:
            continue
        size, step = -(-width * parts * depth // 8), max(1, parts * depth // 8)
        before = np.zeros(size, np.uint8)
        for _ in range(height):
            try:
                raw = take(1 + size)
            except zlib.error as error:
                raise Fault("invalid_image") from error
            before = _unfilter(raw[0], np.frombuffer(raw, np.uint8, offset=1), before, step)
            if depth == 16:
                line = before[::2]
            elif depth == 8:
                line = before
            else:
                bits = np.unpackbits(before).reshape(-1, depth)[: width * parts]
                line = bits @ (1 << np.arange(depth - 1, -1, -1))
                line = line if kind == 3 else line * (255 // ((1 << depth) - 1))
            line = line.reshape(width, parts).astype(np.int64)
            if kind == 3:
                if palette is None or line.max() >= len(palette):
                    raise Fault("invalid_image")
                line = palette[line[:, 0]].astype(np.int64)
            light = (line[:, :3] @ weights + 0x8000) >> 16 if kind in (2, 3, 6) else line[:, 0]
            yield light, line[:, -1] if kind in (4, 6) else None


def dull(data: bytes) -> str | None:
    """fully_transparent or nearly_blank, if a PNG is: it is unpacked until that is settled.

    Blank is one all of whose squares, of a picture shrunk to SHRUNK pixels a side at most, have a mean lightness of BLANK.
    """
    w, h = struct.unpack(">II", data[16:24])
    across = -(-max(w, h) // SHRUNK)
    clear = blank = True
    sums, rows = np.zeros(0), 0
    for light, opacity in png_lines(data):
        clear = clear and opacity is not None and not opacity.any()
        if blank:
            own = np.add.reduceat(light, np.arange(0, len(light), across)) / np.diff(np.append(np.arange(0, len(light), across), len(light)))
            sums, rows = (own, 1) if len(own) != len(sums) or rows == across else (sums + own, rows + 1)
            # Lines still to come can lift a square's mean to white at most.
            blank = bool(((sums + 255 * (across - rows)) / across >= BLANK).all()) if len(own) else True
        if not clear and not blank:
            return None
    return "fully_transparent" if clear else "nearly_blank" if blank else None


def inspect(data: bytes, min_width: int = MIN_WIDTH, min_height: int = MIN_HEIGHT, min_area: int = MIN_AREA) -> tuple[str, int, int]:
    """(format, width, height) of an image that counts, else a Fault: too_large, invalid_image, too_small, fully_transparent or
    nearly_blank. The last two are of PNG files; pictures of other formats are not unpacked."""
    if len(data) > MAX_BYTES:
        raise Fault("too_large")
    kind, w, h, _ = head(data)
    if w < min_width or h < min_height or w * h < min_area:
        raise Fault("too_small")
    if kind == "PNG" and (why := dull(data)):
        raise Fault(why)
    return kind, w, h


# Documents


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def _elements(z: zipfile.ZipFile, name: str) -> list[ElementTree.Element]:
    """The elements of a part that may name an image or a relation, in the document's order; none of a broken part."""
    out = []
    try:
        with z.open(name) as f:
            for _, element in ElementTree.iterparse(f):
                if _local(element.tag) in ("blip", "imagedata", "Relationship"):
                    out.append(element)
                else:
                    element.clear()
    except ElementTree.ParseError:
        return []
    return out


def archive_images(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(where, bytes) of every image that an office archive shows, in the order of its parts and of each part's elements.

    Parts are word/*.xml, each with its own relations: headers, footers, notes and comments are such parts too. Both kinds
    of reference count, drawn (blip) and older ones (imagedata). Linked images, unknown relations and broken parts show none.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names, order = set(z.namelist()), 0
        for part in sorted(n for n in names if n.startswith("word/") and n.endswith(".xml") and "/_rels/" not in n):
            relations = {}
            if (rels := f"{posixpath.dirname(part)}/_rels/{posixpath.basename(part)}.rels") in names:
                for e in _elements(z, rels):
                    own, target = _attribute(e, "Id"), _attribute(e, "Target")
                    if own and target and (_attribute(e, "TargetMode") or "").lower() != "external":
                        target = unquote(target).replace("\\", "/")
                        relations[own] = posixpath.normpath(target).lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), target))
            for e in _elements(z, part):
                kind = _local(e.tag)
                own = _attribute(e, "embed" if kind == "blip" else "id") if kind != "Relationship" else None
                if own and relations.get(own) in names:
                    # One image is unpacked at a time; a larger one than counts is not.
                    info = z.getinfo(relations[own])
                    where = {"format": "docx", "nth": order, "part": part, "relation": own, "member": relations[own]}
                    yield where, z.read(info) if info.file_size <= MAX_BYTES else b"\0" * (MAX_BYTES + 1)
                    order += 1


_OCCURRENCE = "path string, format string, nth int, part string, relation string, member string, page int, sha256 string, size long, mime string, width int, height int, fault string"
_ARROW = pa.schema([
    (c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in _OCCURRENCE.split(", ")
])


def document_images(files: DataFrame) -> DataFrame:
    """A row for each image that the archives and PDF files among files(path, content) show, whether it counts or why not (fault).

    A file that is neither, or not a safe archive, is a row with its fault alone; a null content and an encrypted file too.
    """

    def of(path: str, content: bytes | None) -> Iterator[dict]:
        if content is not None and b"%PDF-" in content[:1024]:
            found = pdf.images(content)
        elif content is None or (why := archive_fault(content)):
            yield {"path": path, "fault": "no content" if content is None else why}
            return
        else:
            found = ((where, data, None) for where, data in archive_images(content))
        for where, data, why in found:
            row = where | {"path": path, "fault": why}
            if data is not None:
                row |= {"sha256": hashlib.sha256(data).hexdigest() if len(data) <= MAX_BYTES else None, "size": len(data)}
                try:
                    kind, w, h = inspect(data)
                    row |= {"mime": MIME[kind], "width": w, "height": h}
                except Fault as fault:
                    row["fault"] = str(fault)
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select("path", "content").mapInArrow(run, _OCCURRENCE)


def distinct_images(occurrences: DataFrame) -> DataFrame:
    """Each document's images that count, equal bytes once: path, sha256, mime, width, height, and all occurrences in order."""
    place = F.struct(F.coalesce("page", F.lit(0)).alias("page"), "nth", "format", "part", "relation", "member")
    fine = occurrences.where("fault is null").groupBy("path", "sha256")
    return fine.agg(F.min("mime").alias("mime"), F.min("width").alias("width"), F.min("height").alias("height"), F.array_sort(F.collect_list(place)).alias("occurrences"))


_FACTS = "path string, format string, mime string, width int, height int, aspect_ratio double, color_mode string, size long, exif map<string, string>, captured_at string, software string, fault string"


def image_facts(files: DataFrame) -> DataFrame:
    """What the image files(path, content) tell of themselves: format, sizes, the camera's tags and the first date that is not empty.

    A file that is no image, or whose tags point outside it, has the fault in its row; of the latter the rest is told.
    """
    kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.float64(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())] + [pa.string()] * 3
    schema = pa.schema(list(zip(re.findall(r"(\w+) (?:string|int|double|long|map)", _FACTS), kinds, strict=True)))

    def of(path: str, data: bytes | None) -> dict:
        row: dict = {"path": path, "size": None if data is None else len(data)}
        try:
            kind, w, h, mode = head(data or b"")
            row |= {"format": kind, "mime": MIME[kind], "width": w, "height": h, "aspect_ratio": w / h if h else None, "color_mode": mode}
            exif = camera_facts(data)
            row |= {"exif": list(exif.items()), "captured_at": next((exif[k] for k in _DATES if exif.get(k)), None), "software": exif.get("Software") or None}
        except Fault as fault:
            row["fault"] = str(fault)
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, _FACTS)
