"""The registered queries' contracts on small tables, and what the operators must bear."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, WORDS, brute_classes, brute_hits, odd_docs, prose, table, whole_text_ids, within_one  # noqa: F401

from lodestar.llm import common, decontam, htmlcut, langid, linedup, packing, probminhash, tokenfile, tokens, toxicity, urlcascade, vptree


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with copies, near copies, shared lines, test passages, and odd rows."""
    folder = tmp_path_factory.mktemp("small")
    r = random.Random(11)
    item = prose(14, 900)
    texts = [prose(60 + i % 7, i) for i in range(60)]
    texts[10] = texts[3]
    near = texts[4].split()
    near[7] = "another"
    texts[11] = " ".join(near)
    texts[12] = texts[5] + "\nA line that several texts have in common here.\nshort"
    texts[13] = prose(50, 77) + "\nA line that several texts have in common here.\nshort"
    texts[14] = prose(30, 78) + " " + item + " " + prose(30, 79)
    texts[15:18] = [None, "", "!!! 123"]
    texts[18] = " ".join([prose(700, 80)] + [prose(700, 81 + i) for i in range(9)])
    rows = [(i, t, ["xx", "yy"][i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).coalesce(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [float(r.gauss(0, 1)) for _ in range(6)]) for i in range(90)] + [(200, None), (220, [0.0] * 6)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    page = "<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T</h1><p>A paragraph of the text, with some words.</article>"
    spark.createDataFrame([(1, "http://a.example.org/es/1", page), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder), texts


def docs_of(spark, small):
    return spark.read.parquet(f"{small[0]}/documents.parquet")


def test_numbers_do_not_depend_on_splits(spark, tmp_path):
    """Row numbers, and so results, are the same however the files are split when a result is read."""
    path = str(tmp_path / "many.parquet")
    texts = [prose(30, i % 400) + f"\n{prose(12, i % 150)}" for i in range(3000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 20_000).parquet(path)
    docs = spark.read.parquet(path)
    bench = spark.createDataFrame([(1, texts[7])], "item_id long, text string")
    built = {
        "numbers": common.numbered(docs).select("_row", "doc_id"),
        "lines": linedup.dedup(docs, **linedup.EVERY_LINE).select("doc_id", "removed"),
        "near": probminhash.dedup(docs).select("doc_id"),
        "bench": decontam.decontaminate(docs, bench).select("doc_id", "text"),
    }
    seen = {}
    for least in ("1", "3", "9"):
        spark.conf.set("spark.sql.files.minPartitionNum", least)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m" if least == "1" else "20k")
        for name, df in built.items():
            mark = df.agg(F.count(F.lit(1)), F.expr(f"bit_xor(xxhash64({', '.join(df.columns)}))")).first()
            assert seen.setdefault(name, mark) == mark, name
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # A table that isn't files is numbered once; a generator's rows have numbers of their own.
    twice = docs.limit(50).select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    assert common.numbered(twice).select("_row").distinct().count() == 100


def test_op1_op3_op4_contracts(spark, small):
    texts = small[1]
    got = {r.doc_id: r for r in langid.op1(spark, small[0]).collect()}
    assert len(got) == 60
    for i, t in enumerate(texts):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (got[i].lang_pred == "und") == (not t or not any(c.isalpha() for c in t)) and 0 <= got[i].score <= 1
    ids = {i: np.array(whole_text_ids(t), "<u4") for i, t in enumerate(texts)}
    at = 0
    back = sorted(tokenfile.op4(spark, small[0]).collect(), key=lambda r: r.doc_id)
    for r in back:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        at += r.n_tokens
    assert len(back) == 60
    pieces = packing.op3(spark, small[0]).collect()
    fill, total = {}, sum(map(len, ids.values()))
    for r in pieces:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length == min(4096, len(ids[r.doc_id]) - r.start) and r.start == 4096 * r.piece
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in pieces) == total and len(fill) <= -(-total // 4096) + 1
    for own in fill.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_op2_op6_op7_op8_op9_contracts(spark, small):
    folder, texts = small
    urls = {r.page_id: r for r in urlcascade.op2(spark, folder).collect()}
    assert (urls[1].host, urls[1].path, urls[1].rule, urls[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (urls[2].host, urls[2].path, urls[2].rule) == ("", "", None)
    x = np.array([list(r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()[:90]], float)
    found = {}
    for r in vptree.op6(spark, folder).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == list(range(0, 90, 20))
    for q, rows in found.items():
        s = x @ x[q]
        want = [j for j in np.lexsort((np.arange(90), -s)).tolist() if j != q][:20]
        assert len(set(want) & {v for _, v, _ in rows}) >= 18 and [k for k, _, _ in sorted(rows)] == list(range(1, 21))
        assert all(c == pytest.approx(s[v]) for _, v, c in rows)
    tox = {r.doc_id: r for r in toxicity.op7(spark, folder).collect()}
    for i in range(60):
        assert tox[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= tox[i].score <= 1 and tox[i].predicted == int(tox[i].score >= 0.7)
    pages = {r.page_id: r for r in htmlcut.op8(spark, folder).collect()}
    assert (pages[1].text, pages[1].n_chars) == ("T A paragraph of the text, with some words.", 43) and (pages[2].text, pages[2].n_chars) == ("", 0)
    bench = [(1, prose(14, 900)), (2, None), (3, "")]
    for r in decontam.op9(spark, folder).collect():
        n, hit, items = brute_hits(texts[r.doc_id], bench)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), hit > 0)


def test_pipeline_equals_brute_force(spark, small):
    """All stages of run(), one after another, against plain loops over the same texts."""
    import corpus_pipeline

    texts = small[1]
    docs = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    seen, kept = [], {}
    for i, t in docs.items():
        lines, gone = t.split("\n"), 0
        out = []
        for line in lines:
            w = line.lower().split()
            if any(w == o or (min(len(w), len(o)) >= 4 and within_one(w, o)) for o in seen):
                gone += 1
            else:
                out.append(line)
            if w:
                seen.append(w)
        if not gone or "\n".join(out).strip():
            kept[i] = "\n".join(out)
    ids = list(kept)
    classes = brute_classes([kept[i] for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if classes[k] == k}
    bench = [(1, prose(14, 900))]
    want = {}
    for i, t in kept.items():
        assert brute_hits(t, bench)[1] == (14 if i == 14 else 0)
        want[i] = len(whole_text_ids(t.replace(prose(14, 900) + " ", "")))
    got = {}
    for r in corpus_pipeline.run(spark, small[0]).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and 10 not in got and 11 not in got


def test_stages_carry_columns_of_any_name(spark, tmp_path, small):
    import corpus_pipeline

    rows = [(i, prose(30, i) + f"\nshared line of five words\n{i}", "xx", "s", 1, "own", "mine", [1], 7, "z") for i in range(12)]
    docs = table(spark, tmp_path, rows, DOCS + ", score string, lang_pred string, removed array<int>, _row int, n_lines string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small[0])
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert out.where("score = 'own' and lang_pred = 'mine' and removed = array(1) and _row = 7 and n_lines = 'z'").count() == 12, name
        assert stage(spark, docs.limit(0), small[0]).count() == 0, name


def test_latin_texts_and_others_have_the_library_s_ids():
    r = random.Random(5)
    signs = [*"aB zÀÉß'srtlvemd  \n\t.,&%1²½<>|é", "'s", "'ll", "'re", "<|endoftext|>", "ı", "İ", "Σ", "ﬁ", "\x85", "\xa0", "\x1c", "　"]
    encoder = tokens.Encoder(tokens.TOKENIZER, 50)
    for _ in range(3000):
        s = "".join(r.choice(signs) for _ in range(r.randrange(1, 25)))
        assert encoder.encode(s).tolist() == encoder.tokenizer.encode(s, add_special_tokens=False).ids
    long = prose(3000, 1) + "x" * 5000 + " " + prose(100, 2)
    assert next(encoder.documents([long], 700)) == np.array(whole_text_ids(long), "<u4").tobytes()


@pytest.mark.parametrize("cells", [1_000_000, 40_000, 0])
def test_alphabets_and_long_texts_parse_as_brute_force(cells, monkeypatch):
    """Languages of 400 letters, texts of many blocks and passes, repeats whose phrases never fall in step."""
    r = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(400)]
    samples = {"zh": "".join(r.choices(han, weights=range(400, 0, -1), k=1500)), "en": " ".join(prose(1, i) for i in range(150))}
    model = langid.LanguageModel.train(samples, cells)
    texts = ["".join(r.choices(han[300:], k=50)), "".join(r.choices(han, k=900)), "aaaa" * 90, "The " + prose(80, 2), "…ü", None, " ", han[0]]
    for block, most in ((1024, 2_000_000), (64, 200), (7, 31)):
        monkeypatch.setattr(langid, "BLOCK", block)
        found, n = model.parse(texts, model.classes(), most)
        for k, lang in enumerate(model.langs):
            sample = langid.normalise(samples[lang])
            for i, t in enumerate(texts):
                norm = langid.normalise(t or "")
                norm = " " + norm if t and not t[0].isalpha() else norm
                at = count = 0
                while at < len(norm):
                    end = at + 1
                    while end <= len(norm) and norm[at:end] in sample:
                        end += 1
                    at, count = max(end - 1, at + 1), count + 1
                if norm.strip():
                    assert (found[k, i], n[i]) == (count, len(norm))
    langs = model.predict(texts, model.classes())[0]
    assert langs[0] == langs[1] == langs[7] == "zh" and langs[3] == "en" and langs[5] == langs[6] == "und"


@pytest.mark.parametrize("norm", [20.0, 1e3, 1e8])
def test_one_long_vector_hides_no_neighbour(norm):
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[5] *= norm
    for points, asked in ((x, np.arange(0, 4000, 100)), (x * np.exp(r.normal(size=4000) * 1.5)[:, None], np.arange(0, 4000, 100))):
        for factor, least in ((1.0, 1.0), (vptree.FACTOR, 0.95)):
            best = vptree.Best(len(asked), 20)
            for rows, tree in vptree.forest(points):
                tree.search(points[asked], best, factor, rows)
            s = points[asked] @ points.T
            want = [np.lexsort((np.arange(4000), -s[i]))[:20] for i in range(len(asked))]
            assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(want, best.numbers, strict=True)]) >= least


def test_ties_go_to_the_smaller_ids(spark):
    r = np.random.default_rng(2)
    rows = [(i, [1.0, *r.integers(-9, 9, 5).astype(float).tolist()]) for i in range(1, 300)] + [(0, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.search(df.where("vec_id = 0"), df, factor=1.0, shard=64).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21))
    with pytest.raises(ValueError, match="components"):
        vptree.search(df, df.union(spark.createDataFrame([(900, [1.0])], df.schema)))


def test_html_scan_is_linear_and_strict():
    assert htmlcut.extract("<p class=it's>Hello there, my good friend.</p>") == "Hello there, my good friend."
    assert htmlcut.extract('<p title="a>Hello there, my good friend.') == "Hello there, my good friend."
    assert htmlcut.extract('<p title="hidden gem">Hello there, my good friend.</p>') == "Hello there, my good friend."
    inside = '<article><section class="form-of-government"><p>They rule by law.</p></section><p class="social-history">Some history here.</p></article>'
    assert htmlcut.extract(inside) == "They rule by law. Some history here."
    assert htmlcut.extract('<article><p>One sentence here.</p><div class="ad-box">Buy this.</div></article>') == "One sentence here."
    for piece in ("<p a=\"x'", "<div>a", "<svg>", "<b>x</i>", "</p>", "<p x=' y", "<li>a<tr>", "a<", "<a href='"):
        took = []
        for n in (4000, 16_000):
            began = time.process_time()
            htmlcut.extract(piece * n)
            took.append(time.process_time() - began)
        assert took[1] < 3 + 10 * took[0], piece


def test_fitted_costs_do_without_names_and_the_cut_decides():
    page = "<div><ul><li><a href=x>{0}</a></li><li><a href=y>More {0}</a></li></ul></div><{1}><h2>Title {0}</h2><p>This paragraph tells of {0}, at some length, in words.</p><p>And then it goes on about {0} for a while.</p></{1}>"
    weights = htmlcut.fit([page.format(f"thing {i}", "article") for i in range(40)])
    text = "Title t This paragraph tells of t, at some length, in words. And then it goes on about t for a while."
    assert weights != htmlcut.TEXT_WEIGHTS and htmlcut.extract(page.format("t", "div"), weights) == text
    assert htmlcut.fit([]) == htmlcut.TEXT_WEIGHTS
    # A line of links amid paragraphs is content by its neighbours alone.
    found = htmlcut.blocks("<div><p>One long sentence of a text that goes on and on.</p><p><a href=x>See here</a> too</p><p>Another long sentence of the same text.</p></div>")
    alone = [htmlcut.log_odds(b) > 0 for b in found]
    assert alone == [True, False, True] and htmlcut.label(found) == [True, True, True]


def test_many_sizes_and_a_shared_passage(spark, tmp_path):
    """Items of all sizes, a passage that all items share, and a benchmark beyond the broadcast bound."""
    passage = prose(40, 500)
    bench = [(i, passage + f" tail{i}") for i in range(25)] + [(100 + n, " ".join(f"z{n}x{k}" for k in range(n))) for n in range(1, 10)]
    texts = [f"{prose(9, i)} {passage} {prose(5, i)}" for i in range(4)] + [" ".join(f"z{n}x{k}" for k in range(n)) + " end" for n in range(1, 10)] + ["É " + passage.upper()]
    docs = table(spark, tmp_path, list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    for most in (2_000_000, 3):
        for r in decontam.hits(docs, items, most_in_plan=most).collect():
            spans = {p for s in r.spans for p in range(s.pos, s.pos + s.size)}
            assert (r.n_words, len(spans), list(r["items"])) == brute_hits(texts[r.doc_id], bench)
            assert len(r.spans) <= 1


@pytest.mark.parametrize("block", [5, 500])
def test_large_components_meet_the_rest(spark, tmp_path, block):
    """A bucket of one large component and texts outside it, some of which link to it by no center."""
    r = random.Random(1)
    base = prose(100, 42).split()
    texts = []
    for k in range(40):
        w = list(base)
        for j in range(k % 12):
            w[(7 * j + k) % 100] = f"c{k}x{j}"
        texts.append(" ".join(w))
    r.shuffle(texts)
    df = probminhash.numbered(table(spark, tmp_path, list(enumerate(texts)), "doc_id long, text string"))
    got = {x.doc_id: x.class_id for x in probminhash.classes(df.select("doc_id", "_row", "text"), block).collect()}
    want = brute_classes(texts)
    groups = lambda d: {frozenset(k for k in d if d[k] == c) for c in d.values()}
    assert groups(got) == groups(dict(enumerate(want)))


def test_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/x?" + "q" * 20_000), (1, "http://a.com/x")], "page_id long, url string")
    got = urlcascade.judge(df, [("allow", "a.com/"), ("block", "a.com/"), ("allow", "com/")]).collect()
    assert {(r.rule, r.verdict) for r in got} == {("a.com/", "block")} and len(got) == 2
    with pytest.raises(ValueError, match="path"):
        urlcascade.judge(df, [("allow", "com")])
