"""Images of documents and camera facts of hand-made files."""

import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

from lodestar.sources import images


def png(pixels, kind=2, depth=8, filters=(0,), laced=0, extra=b""):
    """A PNG of pixels (h, w, parts) with filters by turns."""
    pixels = np.asarray(pixels, np.uint8)
    h, w, parts = pixels.shape

    def pack(rows):
        raw, before = b"", np.zeros(rows.shape[1] * parts, int)
        for y, row in enumerate(rows.reshape(len(rows), -1).astype(int)):
            f = filters[y % len(filters)]
            left = np.concatenate([np.zeros(parts, int), row])[: len(row)]
            corner = np.concatenate([np.zeros(parts, int), before])[: len(row)]
            guess = {0: 0, 1: left, 2: before, 3: (left + before) // 2}.get(f)
            if f == 4:
                p = left + before - corner
                a, b, c = abs(p - left), abs(p - before), abs(p - corner)
                guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, before, corner))
            raw += bytes([f]) + ((row - guess) % 256).astype(np.uint8).tobytes()
            before = row
        return raw

    parts_of = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if laced else [(0, 0, 1, 1)]
    raw = b"".join(pack(pixels[y::dy, x::dx]) for x, y, dx, dy in parts_of if pixels[y::dy, x::dx].size)
    packed = zlib.compress(raw)
    chunk = lambda name, c: struct.pack(">I", len(c)) + name + c + struct.pack(">I", zlib.crc32(name + c))
    ihdr = struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, laced)
    body = chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", b"") + chunk(b"IDAT", packed[20:])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr) + extra + body + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
@pytest.mark.parametrize("laced", [0, 1])
def test_lines_of_pictures(filters, laced):
    x = np.random.default_rng(1).integers(0, 256, (13, 21, 3))
    light = np.concatenate([v for v, _ in images.png_lines(png(x, filters=filters, laced=laced))])
    want = (x @ np.array([19595, 38470, 7471]) + 0x8000) >> 16
    assert sorted(light.tolist()) == sorted(want.ravel().tolist())
    if not laced:
        assert light.tolist() == want.ravel().tolist()


def test_which_images_count():
    noise = np.random.default_rng(2).integers(0, 200, (80, 80, 3))
    assert images.inspect(png(noise)) == ("PNG", 80, 80)
    white = np.full((300, 200, 3), 255)
    spot = white.copy()
    spot[150, 100] = 0  # one dark point of 16 in its square
    big = white.copy()
    big[40:60, 40:60] = 0
    clear = np.concatenate([noise, np.zeros((80, 80, 1))], axis=2)
    seen = clear.copy()
    seen[79, 79, 3] = 1
    grey = np.full((100, 100, 1), 252)
    cases = [
        (png(white), "nearly_blank"), (png(spot), None), (png(big), None), (png(clear, kind=6), "fully_transparent"), (png(seen, kind=6), None), (png(grey, kind=0), "nearly_blank"),
        (png(grey - 100, kind=0), None), (png(noise[:31]), "too_small"), (png(noise[:40, :40]), "too_small"), (b"nothing", "invalid_image"), (png(noise)[:300], "invalid_image"), (b"", "invalid_image"),
    ]
    for data, fault in cases:
        try:
            images.inspect(data)
            found = None
        except images.Fault as e:
            found = str(e)
        assert found == fault


def docx(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def rels(**targets):
    rows = "".join(f'<Relationship Id="{i}" Target="{t}"{" TargetMode=" + chr(34) + "External" + chr(34) if t.startswith("http") else ""}/>' for i, t in targets.items())
    return f'<Relationships xmlns="p">{rows}</Relationships>'


def body(*refs):
    rows = "".join(f'<a:blip r:embed="{i}"/>' if kind == "blip" else f'<v:imagedata r:id="{i}"/>' for kind, i in refs)
    return f'<w:doc xmlns:w="w" xmlns:a="a" xmlns:r="r" xmlns:v="v"><w:p>text{rows}</w:p></w:doc>'


def test_occurrences_by_document_order(spark):
    one, two = (png(np.random.default_rng(i).integers(0, 200, (70, 70, 3))) for i in (1, 2))
    archive = docx({
        "word/document.xml": body(("blip", "r2"), ("imagedata", "r1"), ("blip", "r2"), ("blip", "gone"), ("blip", "web"), ("blip", "r4")),
        "word/_rels/document.xml.rels": rels(r1="media/a.png", r2="/word/media/b%20b.png", web="http://x/y.png", r4="media/small.png", r5="media/none.png"),
        "word/header1.xml": body(("imagedata", "h1")), "word/_rels/header1.xml.rels": rels(h1="..\\word\\media\\copy.png"),
        "word/broken.xml": "<w:doc", "word/footer.xml": body(("blip", "x")), "word/_rels/footer.xml.rels": "<broken",
        "word/media/a.png": one, "word/media/b b.png": two, "word/media/copy.png": one, "word/media/small.png": png(np.zeros((5, 5, 3))), "word/media/unused.png": two,
    })
    files = spark.createDataFrame([("d.docx", archive), ("no.docx", b"x"), ("null.docx", None), ("empty.docx", docx({"word/document.xml": body()}))], "path string, content binary")
    found = images.document_images(files)
    rows = sorted((r.path, r.nth, r.part, r.relation, r.member, r.width, r.fault) for r in found.where("path = 'd.docx'").collect())
    assert rows == [
        ("d.docx", 0, "word/document.xml", "r2", "word/media/b b.png", 70, None), ("d.docx", 1, "word/document.xml", "r1", "word/media/a.png", 70, None),
        ("d.docx", 2, "word/document.xml", "r2", "word/media/b b.png", 70, None), ("d.docx", 3, "word/document.xml", "r4", "word/media/small.png", None, "too_small"),
        ("d.docx", 4, "word/header1.xml", "h1", "word/media/copy.png", 70, None),
    ]
    assert {(r.path, r.fault) for r in found.where("path <> 'd.docx'").collect()} == {("no.docx", "not an archive"), ("null.docx", "no content")}
    once = images.distinct_images(found).collect()
    assert sorted([o.nth for o in r.occurrences] for r in once) == [[0, 2], [1, 4]] and {r.mime for r in once} == {"image/png"}


def tiff(order, entries, details=()):
    """A TIFF head with ASCII (str), SHORT (int) and RATIONAL (tuple) entries."""
    e = "<" if order == b"II" else ">"
    data = bytearray(order + struct.pack(f"{e}HI", 42, 8))

    def directory(rows, at, link=None):
        rows = sorted([*rows, *([(0x8769, link)] if link else [])], key=lambda r: r[0])
        head, tail, after = struct.pack(f"{e}H", len(rows)), b"", at + 2 + 12 * len(rows) + 4
        for tag, v in rows:
            kind, n, raw = (2, len(v) + 1, v.encode() + b"\0") if isinstance(v, str) else (5, 1, struct.pack(f"{e}II", *v)) if isinstance(v, tuple) else (4, 1, struct.pack(f"{e}I", v)) if tag == 0x8769 else (3, 1, struct.pack(f"{e}HH", v, 0))
            if len(raw) > 4:
                place, tail = struct.pack(f"{e}I", after + len(tail)), tail + raw
            else:
                place = raw.ljust(4, b"\0")
            head += struct.pack(f"{e}HHI", tag, kind, n) + place
        return head + struct.pack(f"{e}I", 0) + tail

    first = directory(entries, 8, 1 if details else None)
    if details:
        first = directory(entries, 8, 8 + len(first))
        first += directory(details, 8 + len(first))
    return bytes(data) + first


def jpeg(exif=None):
    app = b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif if exif is not None else b""
    return b"\xff\xd8\xff\xe0\0\x10JFIF\0" + b"\0" * 9 + app + b"\xff\xc0\0\x11\x08" + struct.pack(">HH", 480, 640) + b"\x03" + b"\0" * 9 + b"\xff\xda\0\x02data"


def test_camera_facts(spark):
    details = [(0x9003, ""), (0x9004, "2020:01:02 03:04:05"), (0x829A, (1, 125))]
    whole = tiff(b"MM", [(0x0110, "Cam"), (0x0112, 6), (0x0131, "Soft 1.0"), (0x0132, "2021:01:01 00:00:00")], details)
    little = tiff(b"II", [(0x0132, "2019:05:05 05:05:05")])
    loop = bytearray(tiff(b"II", [(0x0110, "Loop")], [(0x9003, "2000:01:01 00:00:00")]))
    cases = {
        "whole.jpg": jpeg(whole), "little.jpg": jpeg(little), "plain.jpg": jpeg(), "cut.jpg": jpeg(whole[:60]), "head.jpg": jpeg(b"XX"), "far.jpg": jpeg(b"MM\0\x2a\xff\xff\xff\xff"), "loop.jpg": jpeg(bytes(loop)),
        "p.png": png(np.zeros((9, 7, 3)), extra=struct.pack(">I", len(little)) + b"eXIf" + little + b"\0\0\0\0"), "g.gif": b"GIF89a" + struct.pack("<HH", 3, 4) + b"\0" * 9, "no.jpg": b"\xff\xd8\xff",
    }
    files = spark.createDataFrame([*cases.items(), ("null", None)], "path string, content binary")
    got = {r.path: r for r in images.image_facts(files).collect()}
    r = got["whole.jpg"]
    assert (r.format, r.width, r.height, r.color_mode, r.captured_at, r.software, r.fault) == ("JPEG", 640, 480, "RGB", "2020:01:02 03:04:05", "Soft 1.0", None)
    assert r.exif["Orientation"] == "6" and r.exif["ExposureTime"] == "1/125" and r.exif["Model"] == "Cam" and abs(r.aspect_ratio - 4 / 3) < 1e-9
    assert got["little.jpg"].captured_at == got["p.png"].captured_at == "2019:05:05 05:05:05" and got["p.png"].width == 7
    assert got["plain.jpg"].exif == {} and got["plain.jpg"].fault is None and got["g.gif"].height == 4
    assert got["loop.jpg"].captured_at == "2000:01:01 00:00:00"
    assert got["cut.jpg"].width == 640 and "outside" in got["cut.jpg"].fault and got["head.jpg"].fault == "no TIFF head" and "outside" in got["far.jpg"].fault
    assert got["no.jpg"].fault == got["null"].fault == "invalid_image"


def pdf_file(objects, packed=(), trailer=b"xref\n0 1\n9999999999 00000 n\ntrailer <</Root 1 0 R>>\nstartxref\n77777\n%%EOF"):
    """A PDF of objects {number: bytes} with a table of wrong offsets; `packed` numbers go into an object stream."""
    out = b"%PDF-1.5\n"
    for n, body in objects.items():
        if n not in packed:
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    if packed:
        bodies = [objects[n] for n in packed]
        heads = b" ".join(b"%d %d" % (n, sum(len(b) + 1 for b in bodies[:i])) for i, n in enumerate(packed))
        data = zlib.compress(heads + b" " + b" ".join(bodies))
        out += b"90 0 obj <</Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream endobj\n" % (len(packed), len(heads) + 1, len(data), data)
    return out + trailer


def stream(head, data, length=None):
    return b"<<" + head + b" /Length %d>>\nstream\n" % (len(data) if length is None else length) + data + b"\nendstream"


@pytest.mark.parametrize("packed", [(), (1, 2, 3, 4, 8)])
def test_images_of_pdf_files(spark, packed):
    from lodestar.sources import pdf

    r = np.random.default_rng(3)
    rgb, grey, ink = r.integers(0, 200, (70, 80, 3), np.uint8), r.integers(0, 200, (90, 90, 1), np.uint8), r.integers(0, 99, (64, 64, 4), np.uint8)
    up = rgb.reshape(70, -1).astype(int)
    up = b"".join(b"\2" + ((row - before) % 256).astype(np.uint8).tobytes() for row, before in zip(up, np.vstack([np.zeros_like(up[:1]), up[:-1]]), strict=True))
    photo = jpeg()
    size = b"/Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace "
    objects = {
        1: b"<</Type /Catalog /Pages 2 0 R>>",
        2: b"<</Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources <</XObject <</A 10 0 R /F 12 0 R>>>>>>",
        3: b"<</Type /Page /Parent 2 0 R /Contents 14 0 R>>",
        4: b"<</Type /Page /Parent 2 0 R /Resources 8 0 R % a comment\n>>",
        8: b"<</XObject <</P 11 0 R /A 10 0 R /Bad 15 0 R /K 16 0 R>>>>",
        10: stream(size % (80, 70) + b"/DeviceRGB /Filter /FlateDecode /DecodeParms <</Predictor 12 /Colors 3 /Columns 80>>", zlib.compress(up), 5),
        11: stream(size % (640, 480) + b"/DeviceRGB /Filter [/ASCIIHexDecode /DCTDecode]", photo.hex().encode() + b">"),
        12: stream(b"/Subtype /Form /Resources <</XObject <</G 13 0 R /F 12 0 R>>>>", b""),
        13: stream(size % (90, 90) + b"[/ICCBased 17 0 R] /Filter /RunLengthDecode", b"".join(b"\x7f" + grey.tobytes()[i : i + 128] for i in range(0, 8064, 128)) + b"\x23" + grey.tobytes()[8064:] + b"\x80"),
        14: stream(b"/Filter /FlateDecode", zlib.compress(b"q\nBI /W 64 /H 70 /BPC 8 /CS /G ID " + bytes(range(1, 65)) * 70 + b" EI\nQ")),
        15: stream(size % (50, 50) + b"/DeviceRGB /Filter /FlateDecode", b"not packed"),
        16: stream(size % (64, 64) + b"/DeviceCMYK", ink.tobytes()),
        17: stream(b"/N 1", b"profile"),
    }
    data = pdf_file(objects, packed)
    found = {(w["page"], w["nth"]): (w["member"], body, fault) for w, body, fault in pdf.images(data)}
    assert [(k, v[0]) for k, v in sorted(found.items())] == [
        ((1, 0), "object 10"), ((1, 1), "object 13"), ((1, 2), "inline 0"), ((2, 0), "object 11"), ((2, 1), "object 10"), ((2, 2), "object 15"), ((2, 3), "object 16"),
    ]
    light = lambda body: np.concatenate([v for v, _ in images.png_lines(body)])
    assert light(found[(1, 0)][1]).tolist() == ((rgb.astype(int) @ [19595, 38470, 7471] + 0x8000) >> 16).ravel().tolist()
    assert light(found[(1, 1)][1]).tolist() == grey.ravel().tolist() and light(found[(1, 2)][1])[:64].tolist() == list(range(1, 65))
    assert found[(2, 0)][1] == photo and found[(2, 2)][1] is None and found[(2, 2)][2].startswith("extraction_failed")
    assert images.inspect(found[(2, 3)][1]) == ("PNG", 64, 64)
    files = spark.createDataFrame([("a.pdf", data), ("none.pdf", b"%PDF-1.4\n"), ("locked.pdf", data + b"/Encrypt 5 0 R")], "path string, content binary")
    rows = images.document_images(files)
    assert {(r.path, r.fault) for r in rows.where("path <> 'a.pdf'").collect()} == {("locked.pdf", "encrypted")}
    once = images.distinct_images(rows).collect()
    assert sorted([(o.page, o.nth) for o in r.occurrences] for r in once) == [[(1, 0), (2, 1)], [(1, 1)], [(1, 2)], [(2, 0)], [(2, 3)]]


def test_torn_pdf_files_end():
    import time

    from lodestar.sources import pdf

    whole = pdf_file({1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [2 0 R 3 0 R]>>", 3: b"<</Type /Page /Parent 3 0 R /Contents [3 0 R]>>"})
    start = time.perf_counter()
    for cut in range(0, len(whole), 7):
        list(pdf.images(whole[:cut]))
    for odd in (b"[" * 5000, b"<<" * 5000, b"(" * 5000, b"1 0 obj " * 3000, b"1 0 obj 1 0 R endobj", b"2 0 obj <</Type /Page /Resources 2 0 R>> endobj"):
        list(pdf.images(b"%PDF-1.4\n1 0 obj\n" + odd))
    assert time.perf_counter() - start < 10


def test_documents_by_their_converters(spark, tmp_path):
    from lodestar.sources import files

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="", num="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{num}</w:pPr><w:r><w:t>{t}</w:t><w:tab/><w:t>end</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = f"<w:tbl><w:tr>{cell('a|b')}{cell('c')}</w:tr><w:tr>{cell('d')}</w:tr></w:tbl>"
    body = f"<w:document {w}><w:body>{p('Top', 'Heading1')}{p('text')}{p('one', num='<w:numPr/>')}<w:p/>{table}{p('Sub', 'heading 2')}</w:body></w:document>"
    (tmp_path / "in").mkdir()
    for name, data in {
        "a.docx": docx({"word/document.xml": body}), "in/b.md": "\ufeff# hé".encode(), "c.txt": b"\xff\xfe", "d.docx": b"nope", "e.docx": docx({"other": "x"}), "f.docx": docx({"word/document.xml": "<w"}),
        "g.pdf": b"%PDF", "h.png": png(np.zeros((2, 2, 3))), "i.MD": b"x",
    }.items():
        (tmp_path / name).write_bytes(data)
    got = {r.relative_path: (r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.docx", "in/b.md", "c.txt", "d.docx", "e.docx", "f.docx", "g.pdf", "i.MD"}
    assert got["a.docx"] == ("# Top end\n\ntext end\n\n- one end\n\n| a\\|b | c |\n| --- | --- |\n| d |  |\n\n## Sub end", None)
    assert got["in/b.md"] == ("# hé", None) and got["i.MD"] == ("x", None)
    assert all(got[n][0] is None for n in ("c.txt", "d.docx", "e.docx", "f.docx", "g.pdf"))
    assert "not an archive" in got["d.docx"][1] and "no document part" in got["e.docx"][1] and "broken" in got["f.docx"][1] and "no converter for .pdf" in got["g.pdf"][1]
    own = files.read_documents(spark, str(tmp_path), {"pdf": lambda data: f"{len(data)} bytes"})
    assert {r.text for r in own.where("extension = 'pdf'").collect()} == {"4 bytes"}
