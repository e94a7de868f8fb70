"""Block bounds of Markdown, in lines (first, one past the last), and the chunks made of them."""

import pytest

from lodestar.operators import chunk, markdown

CASES = [
    # Lists: nested, with several paragraphs, code and fences in items; blank lines after a list belong to it.
    ("- a\n  - b\n    - c\n- d\n", [("list", 0, 4)]),
    ("- a\n\n  second\n\n- b\n\nafter\n", [("list", 0, 6), ("paragraph", 6, 7)]),
    ("1. a\n\n   ```\n   - no item\n\n   text\n   ```\n2. b\n", [("list", 0, 8)]),
    ("- a\n\n      code\n\n- b\n", [("list", 0, 5)]),
    ("- a\nlazy\n- b\n", [("list", 0, 3)]),
    ("- a\n\nnot lazy\n", [("list", 0, 2), ("paragraph", 2, 3)]),
    ("- a\n* b\n1. c\n2) d\n", [("list", 0, 1), ("list", 1, 2), ("list", 2, 3), ("list", 3, 4)]),
    ("-\n\nfoo\n", [("list", 0, 2), ("paragraph", 2, 3)]),
    ("-\n  foo\n", [("list", 0, 2)]),
    ("text\n1. one\n", [("paragraph", 0, 1), ("list", 1, 2)]),
    ("text\n2. two\n", [("paragraph", 0, 2)]),
    ("text\n-\n", [("heading", 0, 2)]),
    ("text\n*\n", [("paragraph", 0, 2)]),
    ("- # Head\n- > quote\n- ***\n", [("list", 0, 3)]),
    ("\t- code\n", [("code", 0, 1)]),
    ("-\tx\n\n\ty\n", [("list", 0, 3)]),
    # Quotes: lazy lines, fences that lazy lines do not reach, lists within.
    ("> a\nb\n\nc\n", [("quote", 0, 2), ("paragraph", 3, 4)]),
    ("> ```\n> x\n> ```\ny\n", [("quote", 0, 3), ("paragraph", 3, 4)]),
    ("> ```\nx\n", [("quote", 0, 1), ("paragraph", 1, 2)]),
    ("> - a\n> - b\nlazy\n\n> c\n", [("quote", 0, 3), ("quote", 4, 5)]),
    ("> a\n# h\n", [("quote", 0, 1), ("heading", 1, 2)]),
    ("> a\n>\n> b\n", [("quote", 0, 3)]),
    ("> a\n---\n", [("quote", 0, 1), ("rule", 1, 2)]),
    ("- > a\n  > b\n\n  c\n", [("list", 0, 4)]),
    # Fences, code, rules, headings.
    ("```py\n# no\n```\n", [("fence", 0, 3)]),
    ("````\n```\n````\n", [("fence", 0, 3)]),
    ("```\nopen\n\n", [("fence", 0, 3)]),
    ("a\n```\nb\n```\nc\n", [("paragraph", 0, 1), ("fence", 1, 4), ("paragraph", 4, 5)]),
    ("``` a`b\ntext\n", [("paragraph", 0, 2)]),
    ("    a\n\n    b\n\nc\n", [("code", 0, 3), ("paragraph", 4, 5)]),
    ("a\n    b\n", [("paragraph", 0, 2)]),
    ("* * *\n***\n+++\n", [("rule", 0, 1), ("rule", 1, 2), ("paragraph", 2, 3)]),
    ("a\nb\n===\n", [("heading", 0, 3)]),
    ("#no\n####### no\n# yes ##\n", [("paragraph", 0, 2), ("heading", 2, 3)]),
    # HTML is no paragraph; link definitions are no block.
    ("<div>\n*a*\n\nb\n", [("html", 0, 2), ("paragraph", 3, 4)]),
    ("<!-- a\n\nb -->\nc\n", [("html", 0, 3), ("paragraph", 3, 4)]),
    ("a\n<b>\n", [("paragraph", 0, 2)]),
    ("<b>\na\n", [("html", 0, 2)]),
    ("[a]: /x 'T'\n[b]:\n  /y\ntext\n", [("paragraph", 3, 4)]),
    ("[a]: /x\n", []),
    ("text\n[a]: /x\n", [("paragraph", 0, 2)]),
    ("[a]: /x\nHead\n---\n", [("heading", 1, 3)]),
    # Tables: as many columns as the delimiter, rows to a blank line or another block.
    ("| a | b |\n| - | - |\n| 1 |\nx\n> q\n", [("table", 0, 4), ("quote", 4, 5)]),
    ("| a | b |\n| - |\n", [("paragraph", 0, 2)]),
    ("p\n| a |\n|:-:|\n", [("paragraph", 0, 1), ("table", 1, 3)]),
    ("a \\| b | c\n--- | ---\n", [("table", 0, 2)]),
    ("- | a |\n  | - |\n  | 1 |\n", [("list", 0, 3)]),
    ("", []),
    ("\n \n", []),
    ("a\r\nb\r\n\r\n# c", [("paragraph", 0, 2), ("heading", 3, 4)]),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_bounds(text, expected):
    found = markdown.blocks(text)
    assert [(b.kind, b.start, b.end + 1) for b, _, _ in found] == expected
    lines = text.splitlines(keepends=True)
    for b, start, end in found:
        assert text[start:end] == "".join(lines[b.start : b.end + 1])


def test_titles():
    titles = {n.title for n in chunk.markdown_nodes("# A **b** `c` [d](e) ![f](g) \\* &amp; h\n\nS *t*\nu\n===\n")}
    assert titles == {"A b  d  * & h", "S tu"}


def test_chunks_keep_line_ends():
    code = "x" * 1300
    (only,) = chunk.chunk_markdown(f"# Code\n\n```python\n{code}\n```\n")
    assert only.text == f"```python\n{code}\n```\n" and only.oversized == "indivisible_code_fence"
    items = [f"- {letter * 150}\n" for letter in "甲乙丙丁"]
    assert [c.text for c in chunk.chunk_markdown("# List\n\n" + "".join(items))] == ["".join(items[:2]), "".join(items[2:])]
    sentences = [f"{letter * 180}。\n" for letter in "甲乙丙丁"]
    assert [c.text for c in chunk.chunk_markdown("# 正文\n\n" + "".join(sentences))] == ["".join(sentences[:2]), "".join(sentences[2:])]
    table = "| 行 | 内容 |\n| --- | --- |\n" + "".join(f"| 第{i}行 | {'内容' * 40} |\n" for i in range(12))
    (only,) = chunk.chunk_markdown("# 表格\n\n" + table)
    assert only.text == table and only.oversized == "indivisible_table"


def test_merging_under_one_parent():
    found = chunk.chunk_markdown(f"# Root\n\n{'长' * 1180}\n\n## A\n\na\n\n## B\n\nb\n")
    assert [c.path for c in found] == [("Root",), ("Root",)] and "## A" in found[1].text and "## B" in found[1].text
    (only,) = chunk.chunk_markdown(f"# Root\n\n## A\n\n{'甲' * 370}\n\n## B\n\n{'乙' * 170}\n")
    assert 500 < len(only.text) <= 600
    found = chunk.chunk_markdown(f"# 第一章\n\n{'甲' * 700}\n\n## 第二节\n\n{'乙' * 700}\n")
    assert [c.path for c in found] == [("第一章",), ("第一章", "第二节")]


def test_odd_texts_take_little_time():
    import time

    start = time.perf_counter()
    for text in ("> " * 400 + "x\n", "- " * 400 + "x\n", "[" * 3000, "[a]: " + "(" * 3000, "*" * 3000 + "a", "<a " + "b=c " * 1000, "| a " * 2000 + "\n" + "|-" * 2000, "x\n" * 5000):
        chunk.markdown_nodes(text * 2)
        markdown.plain(text)
    assert time.perf_counter() - start < 5


def test_chunks_leave_a_task_in_bounded_batches(spark, monkeypatch):
    """a batch's chunks were held whole."""
    monkeypatch.setattr(chunk, "MOST_HELD", 2000)
    held = []

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            import pyarrow as pa

            held.extend(run([pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": [None, *("# A\n\n" + "b" * 900 for _ in range(49))]})]))

    chunk.chunk_documents(Docs())
    assert sum(b.num_rows for b in held) == 98 and max(b.num_rows for b in held) <= 4
