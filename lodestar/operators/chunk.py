"""Deterministic chunking of plain text and Markdown into token-bounded blocks.

The scanners are small pure functions over one document; chunk_documents applies them in Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice, pairwise, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

from . import markdown

Counter = Callable[[str], int]
MAX_TEXT = 400
CHILD_MIN, CHILD_TARGET, CHILD_MAX, MERGE_MAX, PARENT_MAX = 250, 400, 500, 600, 2000
_TEXT_SENTENCE = re.compile(r"[^。！？；;.!?]*(?:[。！？；;]+|[.!?]+(?:\s+|$)|[.!?]+|$)")
_MARKDOWN_SENTENCE = re.compile(r"[。！？!?；;]+(?:\s+|$)|[.!?]+\s+")
_MARKDOWN_ITEM = re.compile(r"^ {0,3}(?:[-+*]|\d+[.)])\s+", re.M)
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_ITEM = re.compile(r"^ {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]+")


class TokenCounter:
    """Counts the tokens of texts by a tokenizer's file, for the chunkers' `count`; each worker loads it when it first counts.

    Counts are kept by the hash of a text, the last `cache` of them.
    """

    def __init__(self, path: str, cache: int = 20_000):
        self.path, self.cache = path, cache
        self._held: dict[bytes, int] = {}
        self._own = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "cache": self.cache, "_held": {}, "_own": None}

    def count_many(self, texts: list[str]) -> list[int]:
        keys = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
        found = {k: self._held[k] for k in keys if k in self._held}
        if new := {k: t for k, t in zip(keys, texts, strict=True) if k not in found}:
            if self._own is None:
                from tokenizers import Tokenizer

                self._own = Tokenizer.from_file(self.path)
            encoded = self._own.encode_batch(list(new.values()), add_special_tokens=False)
            found |= {k: len(e.ids) for k, e in zip(new, encoded, strict=True)}
            self._held |= {k: found[k] for k in new}
            for k in list(islice(self._held, max(0, len(self._held) - self.cache))):
                del self._held[k]
        return [found[k] for k in keys]

    def __call__(self, text: str) -> int:
        return self.count_many([text])[0]


@dataclass
class Node:
    """A block of the source by character offsets; heading nodes have a level and a title."""

    kind: str
    start: int
    end: int
    level: int = 0
    title: str = ""
    path: tuple[str, ...] = ()


@dataclass
class Chunk:
    text: str
    start: int
    end: int
    path: tuple[str, ...] = ()
    oversized: str | None = None
    kinds: list[str] = field(default_factory=list)


def _lines(text: str) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        out.append((at, at + len(line.rstrip("\r\n")), line.rstrip("\r\n")))
        at += len(line)
    return out


def text_nodes(text: str) -> list[Node]:
    """Paragraphs between blank lines, fences, indented code, tables (two lines or more with | or tabs), lists."""
    out: list[Node] = []
    group: list[tuple[int, int, str]] = []

    def close():
        if group:
            raw = [line for _, _, line in group]
            if len(raw) >= 2 and all("|" in x or "\t" in x for x in raw):
                kind = "table"
            elif all(x.startswith(("    ", "\t")) for x in raw):
                kind = "code"
            else:
                kind = "list" if _ITEM.match(raw[0]) else "paragraph"
            out.append(Node(kind, group[0][0], group[-1][1]))
            group.clear()

    fence, begin = "", 0
    for a, b, line in _lines(text):
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence):
                out.append(Node("fence", begin, b))
                fence = ""
        elif m:
            close()
            fence, begin = m[1], a
        elif line.strip():
            group.append((a, b, line))
        else:
            close()
    close()
    if fence:
        out.append(Node("fence", begin, len(text.rstrip())))
    return out


def _spans(text: str, node: Node, pattern: re.Pattern) -> list[tuple[int, int]]:
    out = []
    for m in pattern.finditer(text, node.start, node.end):
        a, b = m.span()
        b = min(b, node.end)
        part = text[a:b]
        if part.strip():
            out.append((a + len(part) - len(part.lstrip()), a + len(part.rstrip())))
    return out


def _item_spans(text: str, node: Node) -> list[tuple[int, int]]:
    starts = [node.start + a for a, _, line in _lines(text[node.start : node.end]) if _ITEM.match(line)]
    starts = [node.start, *starts[1:]] if starts else [node.start]
    ends = [*starts[1:], node.end]
    return [(a, a + len(text[a:b].rstrip())) for a, b in zip(starts, ends, strict=True)]


def _atoms(text: str, node: Node, count: Counter, most: int, pattern: re.Pattern) -> list[tuple[int, int, str | None]]:
    """What packing may not split: (start, end, reason if it is too large as it is)."""
    if count(text[node.start : node.end]) <= most:
        return [(node.start, node.end, None)]
    if node.kind in ("fence", "code"):
        return [(node.start, node.end, "indivisible_code_fence")]
    if node.kind == "table":
        return [(node.start, node.end, "indivisible_table")]
    spans = _item_spans(text, node) if node.kind == "list" else _spans(text, node, pattern)
    return [(a, b, "indivisible_sentence" if count(text[a:b]) > most else None) for a, b in spans]


def pack_atoms(text: str, atoms, count: Counter, most: int) -> list[Chunk]:
    """Atoms joined greedily up to `most`; one that is too large stands alone. Sizes are counted on the joined text."""
    out: list[Chunk] = []
    begin = end = None
    for a, b, reason in atoms:
        if reason:
            if begin is not None:
                out.append(Chunk(text[begin:end], begin, end))
            out.append(Chunk(text[a:b], a, b, oversized=reason))
            begin = None
            continue
        if begin is not None and count(text[begin:b]) > most:
            out.append(Chunk(text[begin:end], begin, end))
            begin = None
        begin, end = (a if begin is None else begin), b
    if begin is not None:
        out.append(Chunk(text[begin:end], begin, end))
    return out


def chunk_text(text: str, count: Counter = len, most: int = MAX_TEXT) -> list[Chunk]:
    """Blocks of plain text of at most `most` tokens, in order."""
    atoms = [x for node in text_nodes(text) for x in _atoms(text, node, count, most, _TEXT_SENTENCE)]
    return pack_atoms(text, atoms, count, most)


def markdown_nodes(text: str) -> list[Node]:
    """Top-level blocks in order, line ends included; blocks of HTML and link definitions are none."""
    return [Node(b.kind, start, end, b.level, markdown.plain(b.title)) for b, start, end in markdown.blocks(text) if b.kind != "html"]


def _markdown_atoms(text: str, node: Node, count: Counter, most: int) -> list[tuple[int, int]]:
    """The node, or, if it is too large, a paragraph's sentences or a list's items, with the space after them."""
    if count(text[node.start : node.end]) <= most:
        return [(node.start, node.end)]
    starts = [node.start]
    if node.kind == "paragraph":
        starts += [m.end() for m in _MARKDOWN_SENTENCE.finditer(text, node.start, node.end)]
    elif node.kind == "list":
        starts += [m.start() for m in _MARKDOWN_ITEM.finditer(text, node.start, node.end)]
    starts = sorted({a for a in starts if a < node.end})
    return list(pairwise([*starts, node.end]))


def _with_paths(nodes: list[Node]) -> list[Node]:
    """Nodes with the headings they stand under; a heading of level n replaces all from the nth on."""
    path: tuple[str, ...] = ()
    for node in nodes:
        if node.kind == "heading":
            path = (*path[: node.level - 1], node.title)
        node.path = path
    return nodes


def _shared(paths: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The headings that all paths begin with."""
    return tuple(level[0] for level in takewhile(lambda level: len(set(level)) == 1, zip(*paths, strict=False)))


def _parts(nodes: list[Node], level: int) -> list[list[Node]]:
    """The nodes cut before each heading of this level."""
    cuts = [0, *(i for i, n in enumerate(nodes) if i and n.kind == "heading" and n.level == level), len(nodes)]
    return [nodes[i:j] for i, j in pairwise(cuts)]


#: Why a block of Markdown exceeds the maximum (fixed values).
_REASONS = {"fence": "indivisible_code_fence", "code": "indivisible_code_fence", "table": "indivisible_table", "list": "indivisible_list_item"}


def pack_section(text: str, nodes: list[Node], count: Counter, least: int, target: int, most: int) -> list[Chunk]:
    """The blocks of one section packed up to `most`: a chunk ends where its size is as near to the target as it would be
    with the next atom, and before an atom with which a rest under `least` fits. Sizes are sums over atoms."""
    atoms = []
    for node in nodes:
        reason = _REASONS.get(node.kind, "indivisible_content_node")
        atoms += [(a, b, reason if count(text[a:b]) > most else None, node.path) for a, b in _markdown_atoms(text, node, count, most)]
    sizes = [count(text[a:b]) for a, b, _, _ in atoms]
    rest = sum(sizes)
    out: list[Chunk] = []
    group: list[tuple] = []
    held = 0

    def close():
        if group:
            reason = group[0][2] if len(group) == 1 else None
            out.append(Chunk(text[group[0][0] : group[-1][1]], group[0][0], group[-1][1], _shared([g[3] for g in group]), reason))
            group.clear()

    for atom, size in zip(atoms, sizes, strict=True):
        rest -= size
        whole = held + size
        tail = 0 < rest < least and size + rest <= most
        if group and (whole > most or tail or (whole > target and abs(whole - target) >= abs(held - target))):
            close()
            held = 0
        group.append(atom)
        held += size
        if size > most:
            close()
            held = 0
    close()
    return out


def chunk_markdown(text: str, count: Counter = len, least: int = CHILD_MIN, target: int = CHILD_TARGET, most: int = CHILD_MAX, merged: int = MERGE_MAX) -> list[Chunk]:
    """Blocks with their heading paths: what exceeds `most` is cut at headings of level 1, its parts at level 2 and so on
    to 6, and then packed; short blocks are joined under one parent. Parts without content have no block."""
    out: list[Chunk] = []
    todo = [(_with_paths(markdown_nodes(text)), 1)]
    while todo:
        nodes, level = todo.pop()
        body = [n for n in nodes if n.kind not in ("heading", "rule")]
        if not body:
            continue
        start, end = nodes[0].start, nodes[-1].end
        if count(text[start:end]) <= most:
            out.append(Chunk(text[start:end], start, end, _shared([n.path for n in body])))
        elif level > 6:
            out.extend(pack_section(text, body, count, least, target, most))
        else:
            todo.extend((part, level + 1) for part in reversed(_parts(nodes, level)))
    return join_short(text, out, count, least, merged)


def _next_suffice(chunks: list[Chunk], at: int, sizes: list[int], least: int, most: int) -> bool:
    """Whether the chunks from `at` on under one parent reach `least` without exceeding `most`."""
    total = 0
    for c, size in zip(islice(chunks, at, None), islice(sizes, at, None), strict=True):
        if c.oversized or c.path[:-1] != chunks[at].path[:-1]:
            return False
        total += size
        if total >= least:
            return total <= most
    return False


def join_short(text: str, chunks: list[Chunk], count: Counter, least: int, most: int) -> list[Chunk]:
    """Chunks under `least` joined to the one before of the same parent heading while the whole stays within `most`. One
    that follows a chunk long enough stays where it and those after it reach `least` by themselves."""
    sizes = [count(c.text) for c in chunks]
    out: list[Chunk] = []
    held = 0
    for i, (c, size) in enumerate(zip(chunks, sizes, strict=True)):
        last = out[-1] if out else None
        near = last is not None and last.path[:-1] == c.path[:-1] and not last.oversized and not c.oversized
        if near and (held < least or (size < least and not _next_suffice(chunks, i, sizes, least, most))):
            whole = count(text[last.start : c.end])
            if whole <= most:
                out[-1] = Chunk(text[last.start : c.end], last.start, c.end, _shared([last.path, c.path]))
                held = whole
                continue
        out.append(c)
        held = size
    return out


def hierarchy(text: str, count: Counter = len, parent_most: int = PARENT_MAX) -> list[dict]:
    """Parents of at most `parent_most` tokens and their children, with offsets in the document and 'A > B' headings."""
    rows: list[dict] = []
    parents: list[list[Chunk]] = []
    for c in chunk_markdown(text, count):
        top = c.path[:1]
        if parents and parents[-1][0].path[:1] == top and count(text[parents[-1][0].start : c.end]) <= parent_most:
            parents[-1].append(c)
        else:
            parents.append([c])
    for p, own in enumerate(parents):
        rows.append({"role": "parent", "parent": p, "child": -1, "start": own[0].start, "end": own[-1].end, "headings": " > ".join(own[0].path[:1])})
        for k, c in enumerate(own):
            rows.append({"role": "child", "parent": p, "child": k, "start": c.start, "end": c.end, "headings": " > ".join(c.path)})
    return rows


_IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*<?([^)>\s]+)>?(?:\s+[\"'][^)]*)?\s*\)")


def image_contexts(text: str) -> list[dict]:
    """Each image reference: path, caption, the heading it stands under and the paragraph before it. URLs are left out."""
    out, heading, before = [], "", ""
    for node in markdown_nodes(text):
        if node.kind == "heading":
            heading, before = node.title, ""
            continue
        body = text[node.start : node.end]
        if node.kind == "fence":
            continue
        for m in _IMAGE.finditer(body):
            if "://" not in m[2] and not m[2].startswith("data:"):
                own = _IMAGE.sub("", body[: m.start()]).strip()
                out.append({"path": m[2], "caption": m[1].strip(), "heading": heading, "preceding": own or before})
        if plain := _IMAGE.sub("", body).strip():
            before = plain
    return out


def block_table(docs: DataFrame) -> DataFrame:
    """The top-level blocks of docs(doc_id, text): doc_id, kind, first and last (offsets), level, headings they stand under.

    A null text, or one without a block, has no row; a text is read whole in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                nodes = _with_paths(markdown_nodes(text.as_py() or ""))
                rows = [{"doc_id": doc, "kind": n.kind, "first": n.start, "last": n.end, "level": n.level, "headings": list(n.path)} for n in nodes]
                yield pa.RecordBatch.from_pylist(rows, _BLOCKS)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, first long, last long, level int, headings array<string>")


_BLOCKS = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("level", pa.int32()), ("headings", pa.list_(pa.string()))])


def image_references(docs: DataFrame) -> DataFrame:
    """image_contexts of each of docs(doc_id, text); null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r | {"doc_id": doc} for doc, t in zip(*batch.to_pydict().values(), strict=True) for r in image_contexts(t or "")]
            yield pa.RecordBatch.from_pylist(rows, IMAGE_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, path string, caption string, heading string, preceding string")


IMAGE_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.string()) for n in ("path", "caption", "heading", "preceding"))])
#: Characters of chunks that a task holds before it hands them on.
MOST_HELD = 1_000_000
CHUNK_SCHEMA = "doc_id long, role string, parent int, child int, start int, end int, headings string, text string"


def chunk_documents(docs: DataFrame, count: Counter = len) -> DataFrame:
    """The hierarchy of each of docs(doc_id, text); null and empty texts have no chunks. Rows leave a task whenever their
    texts reach MOST_HELD characters, however many rows a batch has."""
    names = ("doc_id", "role", "parent", "child", "start", "end", "headings", "text")
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())

    def table(out: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            held = 0
            # Column by value: no list of a batch's texts beside the batch.
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                body = text.as_py() or ""
                for row in hierarchy(body, count):
                    own = body[row["start"] : row["end"]]
                    for name, value in (row | {"doc_id": doc.as_py(), "text": own}).items():
                        out[name].append(value)
                    held += len(own)
                    if held > MOST_HELD:
                        yield table(out)
                        out, held = {n: [] for n in names}, 0
            yield table(out)

    return docs.select("doc_id", "text").mapInArrow(run, CHUNK_SCHEMA)
