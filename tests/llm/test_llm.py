"""The training-data operators against brute force and on edge cases."""

import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import (
    common,
    components,
    decontam,
    htmlcut,
    langid,
    linedup,
    packing,
    probminhash,
    tokenfile,
    tokens,
    toxicity,
    urlcascade,
    vptree,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def table(spark, tmp_path, rows, schema):
    """A written table, as row numbers must be stable."""
    path = str(tmp_path / f"t{random.random()}")
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture()
def odd_docs(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join([prose(500, 1)] * 8)
    rows = [(1, None), (2, ""), (3, prose(40, 3)), (3, prose(40, 3)), (4, prose(40, 3)), (None, prose(30, 4)), (5, long), (6, "!!! 123"), (7, " \n\n ")]
    rows = [(i, t, "x", "y", 1.5, 7, "z", "q") for i, t in rows]
    return table(spark, tmp_path, rows, "doc_id long, text string, score string, removed string, n_words double, _row int, items string, lang string")


# Language identification


def test_automaton_has_exactly_the_substrings():
    text = "abcabxabcd"
    states = langid.suffix_automaton(text)

    def has(s):
        at = 0
        for c in s:
            if c not in states[at]:
                return False
            at = states[at][c]
        return True

    r = random.Random(0)
    for _ in range(500):
        s = "".join(r.choice("abcdx") for _ in range(r.randrange(1, 6)))
        assert has(s) == (s in text)


def test_phrases_equal_brute_force():
    samples = {"a": "the cat sat on the mat and the dog", "b": "der hund sitzt auf der matte und so"}
    model = langid.LanguageModel.train(samples)
    text = "The dog,  sat und der x mat! ß"
    norm = langid.normalise(text)
    found, n = model.parse([text, None, "..."], model.classes())
    assert n.tolist() == [len(norm), 0, 0]
    for k, lang in enumerate(model.langs):
        i = count = 0
        while i < len(norm):
            j = i + 1
            while j <= len(norm) and norm[i:j] in langid.normalise(samples[lang]):
                j += 1
            i = max(j - 1, i + 1)
            count += 1
        assert found[k, 0] == count


def test_langid_edges(spark, odd_docs):
    model = langid.LanguageModel.train({"a": "the cat sat " * 5, "b": "der hund lief " * 5})
    rows = langid.identify(odd_docs, model).orderBy("doc_id").collect()
    assert len(rows) == odd_docs.count()
    assert all((r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text)) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(odd_docs.limit(0), model).count() == 0
    assert langid.train(spark.createDataFrame([], DOCS)).langs == []


# URL cascade


def test_cascade_is_exact_on_its_universe(spark):
    keys = [f"k{i}" for i in range(4000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string").select(*urlcascade.hashes(F.col("key")))
    cascade = urlcascade.build(universe, keys[:700])
    a, b = urlcascade._pairs(universe.collect())
    assert cascade.listed(a, b).tolist() == [True] * 700 + [False] * 3300 and len(cascade.levels) > 1


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/1?x", "http://example.org/en/12#a", "https://x.com/fr/", "http://x.com/de/q", "ftp://net", "http://notexample.org/es/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlcascade.judge(df, urlcascade.RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block")
    assert got[7] == ("net", "", None, "allow") and got[8][2:] == ("org/", "allow")
    assert urlcascade.judge(df.limit(0), urlcascade.RULES).count() == 0
    assert {r.verdict for r in urlcascade.judge(df, []).collect()} == {"allow"}


# Tokens, packing, files


def whole_text_ids(text):
    return tokens.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_cached_ids_are_the_library_s():
    texts = [prose(300, 5), "a.b, c.. d.", "it's x'.S. A.", "İstanbul ΣΑΣ é. É, ß", "x<|endoftext|>, y", "a　b\x1cc\td\r\ne", "a" * 3000, "", None, "Á é ª µ"]
    for cache in (20, 100_000):
        got = list(tokens.Encoder(tokens.TOKENIZER, cache).documents(texts, 50))
        assert got == [array("I", whole_text_ids(t)).tobytes() for t in texts]


def test_sum_of_squares_places_as_brute_force():
    r = random.Random(2)
    lengths = np.array([r.randrange(1, 21) for _ in range(150)])
    sequence, offset = packing.sum_of_squares(lengths, 20)
    fill = Counter()
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        gaps = Counter(20 - f for f in fill.values() if f < 20)
        options = []
        for gap in sorted(g for g in gaps if g >= s) + [None]:
            after = gaps.copy()
            if gap is not None:
                after[gap] -= 1
            rest = (gap if gap is not None else 20) - s
            if rest:
                after[rest] += 1
            options.append((sum(n * n for n in after.values()), gap is None, gap))
        assert offset[i] == fill[sequence[i]]
        own = None if fill[sequence[i]] == 0 else 20 - fill[sequence[i]]
        assert min(options)[0] == next(o[0] for o in options if o[2] == own)
        fill[sequence[i]] += s
    assert max(fill.values()) <= 20


def test_packing_edges(spark, odd_docs):
    rows = packing.pack(packing.pieces(odd_docs, 64), 64, share=20).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at and n > 0
            at += n
        assert at <= 64
    texts = [r.text for r in odd_docs.collect()]
    assert sum(r.length for r in rows) == sum(len(whole_text_ids(t)) for t in texts)
    assert packing.pack(packing.pieces(odd_docs.limit(0))).count() == 0


def test_blocks_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 63, 1024, 5000):
        ids = r.integers(0, 300, n).astype(np.uint32)
        ids[r.random(n) < 0.03] = r.integers(2**31, 2**32)
        payload, starts = tokenfile.encode_blocks(ids)
        assert (tokenfile.decode_blocks(payload, starts, n) == ids).all()
    flat = np.full(100, 7, np.uint32)
    assert (tokenfile.decode_blocks(*tokenfile.encode_blocks(flat), 100) == flat).all()
    shard = tokenfile.Shard(tokenfile.encode_shard([5, None], [ids[:3000].tobytes(), ids[3000:].tobytes()]))
    assert shard.doc_ids == [5, None] and (shard.ids(1) == ids[3000:]).all() and (shard.ids(0) == ids[:3000]).all()
    with pytest.raises(ValueError, match="not a shard"):
        tokenfile.Shard(b"x" * 100)


def test_token_file_edges(spark, odd_docs, tmp_path):
    folder = f"file://{tmp_path}/tok"
    manifest = tokenfile.write(odd_docs, folder, shard_ids=100)
    got = sorted(tokenfile.read_back(manifest, folder, 4).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 4, 5, 6, 7]
    want = sorted(zlib.crc32(array("I", whole_text_ids(r.text)).tobytes()) for r in odd_docs.collect())
    assert sorted(r.ids_crc32 for r in got) == want
    empty = f"file://{tmp_path}/none"
    assert tokenfile.read_back(tokenfile.write(odd_docs.limit(0), empty), empty, 0).count() == 0


# Near-duplicates


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(texts):
    sets = [shingles(t) if t else set() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] and texts[i] == texts[j]
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [1500, 7])
def test_classes_equal_brute_force(spark, tmp_path, block):
    """A group of copies that drift apart, so that its classes are chains; small blocks take the split path."""
    r = random.Random(9)
    texts, base = [], prose(120, 7).split()
    for i in range(60):
        own = list(base) if i % 3 else list((texts[r.randrange(i)] if i else " ".join(base)).split())
        for _ in range(r.randrange(0, 9)):
            own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [texts[0], texts[5], prose(60, 100), prose(60, 101), "short one", "Short, one!", None, "", "", "?!", "?!"]
    df = probminhash.numbered(table(spark, tmp_path, list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    got = {r.doc_id: r.class_id for r in probminhash.classes(df, block).collect()}
    want = brute_classes([re.sub(r"\W+", " ", t.lower()).strip() or t if t else t for t in texts])
    groups = lambda d: {frozenset(k for k in d if d[k] == c) for c in d.values()}
    assert groups(got) == groups(dict(enumerate(want)))


def test_signature_estimates_probability_jaccard():
    r = np.random.default_rng(3)
    g = r.integers(1, 2**63, 300).astype(np.uint64)
    w = r.uniform(0.5, 4, 300)
    a, b = np.arange(0, 250), np.arange(50, 300)
    registers = probminhash.signatures(np.repeat([0, 1], 250), np.append(g[a], g[b]), np.append(w[a], w[b]), 2, 2000)
    x, y = np.zeros(300), np.zeros(300)
    x[a], y[b] = w[a] / w[a].sum(), w[b] / w[b].sum()
    exact = sum(1 / sum(np.maximum(x / x[d], y / y[d])) for d in range(50, 250))
    assert abs((registers[0] == registers[1]).mean() - exact) < 0.05


def test_repeated_passages_are_no_other_text(spark, tmp_path):
    """Pairs of similarity 0.8 of which one repeats a passage within a line 400 times."""
    texts = []
    for i in range(12):
        p, tail = [f"p{i}x{k}" for k in range(20)], [f"t{i}x{k}" for k in range(60)]
        for side, times in (("a", 400), ("b", 1)):
            texts.append(" ".join(p * times + p[:4] + tail + [f"{side}{i}x{k}" for k in range(10)]))
    a, b = shingles(texts[0]), shingles(texts[1])
    assert len(a & b) / len(a | b) >= 0.8
    df = probminhash.numbered(table(spark, tmp_path, list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    got = {r.doc_id: r.class_id for r in probminhash.classes(df).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(12)) and len(set(got.values())) == 12


def test_near_dedup_edges(spark, odd_docs):
    kept = probminhash.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    # One of the three equal texts goes on; null, empty and wordless rows stay.
    assert kept.count() == odd_docs.count() - 2
    assert kept.where("_row <> 7").count() == 0
    assert probminhash.dedup(odd_docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 100), (7, 7), (100, 103)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 103: 100}


# Nearest neighbours


def test_vp_tree_recall_and_ties(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 8)).astype(np.float32)
    x[100:300] = x[100]  # a vector that many share
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.where("vec_id % 20 = 0")
    y = x.astype(float)
    for factor, least in ((1.0, 1.0), (0.9, 0.9)):
        got = {}
        for row in vptree.search(q, df, factor=factor, shard=250, block=20).collect():
            got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
        hits = 0
        for i in range(0, 900, 20):
            s = (y * y[i]).sum(axis=1)
            want = [j for j in np.lexsort((np.arange(900), -s)).tolist() if j != i][:20]
            found = [v for _, v, _ in sorted(got[i])]
            hits += len(set(want) & set(found))
            if factor == 1.0:
                assert found == want and [c for _, _, c in sorted(got[i])] == pytest.approx(s[want].tolist(), rel=1e-12)
        assert hits / (45 * 20) >= least
    assert vptree.search(q.limit(0), df).count() == 0 and vptree.search(q, df.limit(0)).count() == 0
    few = vptree.search(q.where("vec_id = 0"), df.where("vec_id < 5")).collect()
    assert [r.rank for r in few] == [1, 2, 3, 4]


# Toxicity


def test_noisy_or_learns_and_locates(spark, odd_docs):
    r = random.Random(4)
    texts, y = [], []
    for i in range(240):
        sentences = [prose(8, 1000 + 10 * i + k).capitalize() + "." for k in range(5)]
        if i % 4 == 0:
            sentences[r.randrange(5)] = f"You {r.choice(['vilewordish', 'vilewordal', 'vileworden'])} " + prose(4, i) + "!"
        texts.append(" ".join(sentences))
        y.append(int(i % 4 == 0))
    model = toxicity.calibrated(toxicity.fit(texts[:200], np.array(y[:200])), texts[:200], np.array(y[:200]))
    p = model.score([*texts[200:], "Some vilewordful thing.", "", None], model.cache())
    assert [int(v >= 0.7) for v in p] == [*y[200:], 1, 0, 0]
    df = spark.createDataFrame([(1, "All is fine here. You vilewordal mu! Good day.", "x")], "doc_id long, text string, score string")
    row = toxicity.score(df, model).first()
    assert row.predicted == 1 and [row.text[s.start : s.end] for s in row.sentences] == ["You vilewordal mu!"]
    brute = 1 - np.prod([1 - q for _, _, q in model.sentences(texts[0], model.cache())])
    odds = brute / (1 - brute) * np.exp(model.offset)
    assert model.score(texts[:1], model.cache())[0] == pytest.approx(odds / (1 + odds), rel=1e-6)
    assert toxicity.score(odd_docs, model).count() == odd_docs.count()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(odd_docs, toxicity.train(odd_docs, none)).where("predicted = 1").count() == 0


# HTML


def test_main_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div id='cookie-notice'>We use cookies, "
        "accept them please, they are good for you.</div><nav><a href=x>Home</a></nav><main><h1>Title &amp; more</h1><p>First   para with <a href=y>a "
        "link</a> in it.<p>Second &lt;para&gt; here<ul><li>one<li>two</ul><div class='advert'>Buy this great thing today.</div><form><label>Name</label>"
        "<input></form></main><aside><p>Related stuff that is long enough to look like content in itself.</p></aside><section id='comments'><p>Nice "
        "article, I like it very much.</p></section><script>var a='<p>x</p>';</script><footer>&copy; 2020</footer></body></html>"
    )
    assert htmlcut.extract(page) == "Title & more First para with a link in it. Second <para> here one two"
    assert htmlcut.extract(None) == htmlcut.extract("") == htmlcut.extract("<p>") == ""
    assert htmlcut.extract("<article><p><b>A.<br><p>B.</article>") == "A. B."
    rows = [(1, None, "x"), (2, page, "y"), (3, "<article><p>é 😀</p></article>", "z"), (3, "<article><p>é 😀</p></article>", "z")]
    got = htmlcut.main_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (2, 69), (3, 3), (3, 3)]


def test_minimum_cut_is_minimal():
    r = random.Random(3)
    for _ in range(30):
        n = 7
        ends = [(r.random() * 3, r.random() * 3) for _ in range(n)]
        sides = [(i, j, r.random()) for i in range(n) for j in range(i) if r.random() < 0.4]
        flow = htmlcut.Flow(n)
        for i, (a, b) in enumerate(ends):
            flow.join(n, i, a)
            flow.join(i, n + 1, b)
        for i, j, w in sides:
            flow.join(i, j, w, w)
        cost = lambda s: sum(b if x else a for x, (a, b) in zip(s, ends, strict=True)) + sum(w for i, j, w in sides if s[i] != s[j])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(flow.source_side(n, n + 1)[:n]) == pytest.approx(best)


# Decontamination


def brute_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        v = split(t)
        n = min(10, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [200_000, 0])
def test_hits_equal_brute_force(spark, odd_docs, most):
    bench = [(1, prose(30, 50)), (2, "Ünder Two words"), (3, ""), (4, None), (5, "alpha1"), (6, prose(10, 51)), (7, prose(30, 50))]
    texts = [prose(20, 60) + " " + " ".join(prose(30, 50).upper().split()[4:18]) + " x", "say ünder-two WORDS, now", "beta alpha1", None, "", prose(10, 51), prose(9, 51)]
    docs = spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts)], "doc_id long, text string, pos int")
    got = decontam.hits(docs, spark.createDataFrame(bench, "item_id long, text string"), most_in_plan=most).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        cover = {p for s in r.spans for p in range(s.pos, s.pos + s.size)}
        assert (r.n_words, len(cover), list(r["items"])) == brute_hits(t, bench) and r.pos == 2 * r.doc_id
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.hits(odd_docs, none).where("size(spans) > 0").count() == 0
    assert decontam.hits(odd_docs.limit(0), none).count() == 0


def test_spans_are_removed(spark, odd_docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    text = "Keep  this. One, two three four FIVE six seven eight nine ten! And that."
    docs = spark.createDataFrame([(1, text), (2, "clean\ttext"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: "Keep  this. And that.", 2: "clean\ttext", 3: None}
    assert {r.doc_id for r in decontam.decontaminate(docs, bench, remove="documents").collect()} == {2, 3}
    same = decontam.decontaminate(odd_docs, bench)
    assert same.columns == odd_docs.columns and same.exceptAll(odd_docs).count() == 0 and same.count() == odd_docs.count()


# Line dedup


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) - len(b) == 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def test_lines_equal_brute_force(spark, tmp_path):
    r = random.Random(6)
    base = [prose(n, 200 + n).split() for n in (3, 4, 9, 10, 11, 12, 25)]
    docs = []
    for i in range(80):
        own = []
        for _ in range(3):
            w = list(r.choice(base))
            for _ in range(r.randrange(3)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [f"v{r.randrange(6)}"], [w[k], "u"], [w[k].upper()]])
            own.append("  ".join(w) if r.random() < 0.2 else " ".join(w))
        docs.append((i, "\n".join(own)))
    docs += [(90, None), (91, ""), (92, "\n\n"), (93, "a b c d"), (94, "a b c d")]
    seen, want = [], {}
    for i, t in docs:
        want[i] = []
        for k, line in enumerate((t or "").split("\n")):
            w = re.sub(r"\s+", " ", line.lower()).strip().split(" ")
            if len(w) >= 4:
                if any(w == o or (min(len(w), len(o)) >= 10 and within_one(w, o)) for o in seen):
                    want[i].append(k)
                seen.append(w)
    df = table(spark, tmp_path, docs, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in linedup.dedup(df).collect()}
    assert {i: list(r.removed) for i, r in got.items()} == want
    assert got[90].text is None and got[90].n_lines == 0 and got[91].text == "" and got[94].text == ""


def test_op10_exempts_no_short_line(spark, tmp_path):
    r = random.Random(8)
    base = [prose(n, 300 + n).split() for n in range(1, 11)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(4):
            w = list(r.choice(base))
            if r.random() < 0.5:
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [f"v{r.randrange(30)}"], [w[k], f"u{r.randrange(30)}"], [w[k].upper()]])
            own.append(" ".join(w))
        docs.append((i, "\n".join([*own, "", " \t "])))
    docs += [(90, None), (91, ""), (92, "All rights reserved."), (93, "all  rights reserved."), (94, "Ietzte."), (95, "Ietzte.")]
    seen, want = [], {}
    for i, t in docs:
        want[i] = []
        for k, line in enumerate((t or "").split("\n")):
            w = line.lower().split()
            if any(w == o or (min(len(w), len(o)) >= 4 and within_one(w, o)) for o in seen):
                want[i].append(k)
            if w:
                seen.append(w)
    table(spark, tmp_path, docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: list(r.removed) for r in linedup.op10(spark, str(tmp_path)).collect()}
    assert got == want and got[93] == got[95] == [0]


def test_line_dedup_edges(spark, odd_docs):
    got = linedup.dedup(odd_docs)
    assert got.count() == odd_docs.count() and got.where("_row <> 7").count() == 0
    assert linedup.dedup(odd_docs.limit(0)).count() == 0


# Pipeline and registration


def test_pipeline_runs_and_keeps_columns(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        n = docs.count()
        docs = corpus_pipeline.common.cut(stage(spark, docs, sf_dir), name)
        if name != "pack":
            assert docs.columns == columns and 0 < docs.count() <= n
    assert "sequence_id" in docs.columns and docs.count() > 0


def test_every_operator_is_registered():
    from lodestar.llm.queries import oracle_sql, queries

    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


def test_release_deletes_cut_tables(spark):
    from pathlib import Path

    from lodestar.llm import common

    common.release(spark)
    table = common.cut(spark.range(5).toDF("n"), "five")
    path = Path(table.inputFiles()[0].removeprefix("file://"))
    assert table.count() == 5 and path.exists()
    common.release(spark)
    assert not path.exists()


def test_batches_of_texts_are_small_unless_the_session_says_otherwise(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = spark.range(0, 2500, 1, 1)
    before = spark.conf.get(key, "0")
    try:
        spark.conf.unset(key)
        assert [r.n for r in common.map_texts(rows, sizes, "n long").collect()] == [1000, 1000, 500]
        spark.conf.set(key, "10000")
        assert [r.n for r in common.map_texts(rows, sizes, "n long").collect()] == [2500]
    finally:
        spark.conf.unset(key) if before == "0" else spark.conf.set(key, before)


def test_language_of_a_text_within_a_struct(spark):
    model = langid.LanguageModel.train({"a": "aba abba " * 20, "b": "cdc cddc " * 20})
    docs = spark.createDataFrame([(1, "abba aba"), (2, "cddc cdc"), (3, None), (4, "12")], "doc_id long, text string")
    plain = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    inside = langid.identify(docs.selectExpr("struct(doc_id, text) as _all"), model, within="_all")
    assert {r["_all"].doc_id: r.lang_pred for r in inside.collect()} == plain == {1: "a", 2: "b", 3: "und", 4: "und"}
