"""Lexical search, hard negatives and fingerprints against brute force and on odd input."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import lexical, pivots, simhash
from tests.llm.test_llm import WORDS, odd_docs, prose, table  # noqa: F401

# Ranked lexical search


def best_partition(x, longest, cost):
    least = [0] + [None] * len(x)
    for j in range(1, len(x) + 1):
        least[j] = min(least[i] + cost + (j - i) * max(x[i:j]) - sum(x[i:j]) for i in range(max(0, j - longest), j))
    return least[-1]


def test_blocks_have_the_least_cost(monkeypatch):
    monkeypatch.setattr(lexical, "TOGETHER", 3)
    r = random.Random(1)
    lists = [[r.choice([1, 2, 9, 10]) for _ in range(n)] for n in (1, 0, 17, 5, 40, 2, 1, 30)]
    lengths = np.array([len(x) for x in lists])
    counts, ends, most = lexical.blocks(lengths, np.array(sum(lists, [])), longest=6, cost=7)
    at = 0
    for x, n in zip(lists, counts.tolist(), strict=True):
        own, tops = ends[at : at + n].tolist(), most[at : at + n].tolist()
        at += n
        begins = [0, *[e + 1 for e in own[:-1]]] if own else []
        assert (own[-1:] or [-1]) == [len(x) - 1] and tops == [max(x[b : e + 1]) for b, e in zip(begins, own, strict=True)]
        assert all(e - b < 6 for b, e in zip(begins, own, strict=True))
        assert sum(7 + (e + 1 - b) * max(x[b : e + 1]) - sum(x[b : e + 1]) for b, e in zip(begins, own, strict=True)) == best_partition(x, 6, 7)


def terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(lexical.TERM, text)


def ranked(docs, queries, k):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if i is not None and t is not None]
    n, total = sum(1 for d in docs if d[2]), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    asked = {}
    for i, t in queries:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for item, own in asked.items():
        found = []
        for i, tf, size in docs:
            m = 50 + (50 * size * n) // total if size else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in own if tf[t])
            if s > 0:
                found.append((-s, i))
        out |= {(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("shard, block", [(8192, 1000), (7, 2)])
def test_ranks_equal_brute_force(spark, tmp_path, shard, block):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([1, 5, 30, 90])))) for i in range(120)]
    docs += [(500, docs[3][1]), (501, docs[3][1]), (501, "É ÉA éa"), (600, None), (601, ""), (602, "..."), (None, "alpha"), (603, "Alpha-BETA_gamma 007")]
    queries = [(1, "alpha beta beta"), (2, "the omega of psi"), (3, None), (4, "zzz"), (2, "xi"), (None, "alpha"), (5, "ÉA éa Alpha"), (6, " ".join(WORDS)), (7, "?!")]
    frame = table(spark, tmp_path, [(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    asked = spark.createDataFrame([(i, t, "x") for i, t in queries], "item_id int, text string, rank string")
    n, total = lexical.totals(frame.where("doc_id is not null"))
    postings = lexical.index(frame, n, total, shard_docs=shard)
    found = lexical.search(postings, asked, n, k=9, block=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(ranked(docs, [q for q in queries if q[0]], 9))


def test_lexical_edges(spark, odd_docs):  # noqa: F811
    none = spark.createDataFrame([], "item_id string, text string")
    assert lexical.rank(odd_docs, none).count() == 0
    asked = spark.createDataFrame([("a", WORDS[0] + "1 " + WORDS[1] + "2"), ("b", "123")], none.schema)
    assert lexical.rank(odd_docs.limit(0), asked).count() == 0
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert {tuple(r) for r in lexical.rank(odd_docs, asked).collect()} == ranked(docs, [tuple(r) for r in asked.collect()], 50)


# Hard negatives


def negatives(rows, asks, low=50, high=95):
    out = []
    for a, (i, label, x) in enumerate(rows):
        if not asks(i):
            continue
        scored = sorted((-sum(int(p) * int(q) for p, q in zip(x, y, strict=True)), j, b, other) for b, (j, other, y) in enumerate(rows) if b != a)
        for s, j, _, _ in [p for p in scored if p[3] == label][:5]:
            fine = [(t, n) for t, n, _, other in scored if other != label and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, k, n, -s, -t) for k, (t, n) in enumerate(fine[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard, block, spread", [(16_384, 64, 3.0), (40, 5, 3.0), (40, 5, 1e6)])
def test_negatives_equal_brute_force(spark, tmp_path, shard, block, spread):
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(300, 6)) * 3)
    x[:40] *= np.round(spread)
    rows = [(int(i % 270), int(r.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]
    rows[7] = (7, 1, [0.0] * 6)
    rows[260] = (260, 99, [3.0] * 6)  # no other row of its label
    frame = table(spark, tmp_path, [(*row, "x") for row in rows], "vec_id long, label int, embedding array<double>, rank string").coalesce(1)
    found = pivots.mine(frame, F.pmod("vec_id", F.lit(10)) == 0, shard=shard, block=block)
    assert sorted(map(tuple, found.collect())) == negatives(rows, lambda i: i % 10 == 0)


def test_brackets_hold_every_score():
    r = np.random.default_rng(6)
    x = np.floor(r.normal(size=(500, 16)) * 256)
    x[3] *= 1000
    held = pivots.table(x)
    lower, upper = pivots.brackets(x[:50], held)
    score = x[:50] @ x.T
    assert (lower <= score).all() and (score <= upper).all()
    # Some bracket is narrow: a pivot's own distances are exact.
    assert (upper - lower).min() < 0.01 * np.abs(score).max()


def test_negative_edges(spark, tmp_path):
    schema = "vec_id long, label int, embedding array<float>, other int"
    bad = [(1, None, [1.0, 2.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [float("nan"), 1.0]), (5, 1, [float("inf"), 1.0]), (None, 1, [1.0, 1.0])]
    fine = [(10, 1, [0.5, 0.5]), (11, 1, [0.5, 0.25]), (12, 2, [0.25, 0.3]), (12, 2, [0.25, 0.3]), (13, 2, [-1.0, -1.0])]
    frame = pivots.quantise(table(spark, tmp_path, [(*row, 0) for row in bad + fine], schema))
    asks = F.col("vec_id") == 10
    # 128 and 128 by 128 and 64, by 64 and 76: 24,576 and 17,920; both copies of row 12 count.
    assert sorted(map(tuple, pivots.mine(frame, asks).collect())) == [(10, 11, 1, 12, 24576, 17920), (10, 11, 2, 12, 24576, 17920)]
    assert pivots.mine(frame.limit(0), asks).count() == 0
    assert pivots.mine(frame, F.lit(False)).count() == 0
    assert pivots.mine(frame.where("label = 2"), F.col("vec_id") == 12).count() == 0
    with pytest.raises(ValueError, match="components"):
        pivots.mine(frame.union(frame.withColumn("embedding", F.array(F.lit(1.0)))), asks)


# Fingerprints


def print_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_every_pair_of_bits_is_left_out_by_some_table():
    tables = simhash.masks()
    assert len(tables) == 7 and all(35 <= m.bit_count() <= 38 for m in tables)
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in tables) for a, b in itertools.product(range(64), repeat=2))
    wide = simhash.masks(4)
    assert len(wide) == 31 and all(any(not any(m >> b & 1 for b in bits) for m in wide) for bits in itertools.combinations(range(0, 64, 3), 4))


@pytest.mark.parametrize("piece", [1 << 20, 9])
def test_fingerprints_equal_brute_force(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    texts = ["", " \t\n", "One", "one two", "Ä b\x0bC d", prose(200, 1), "x" * 50 + "\x0c" + prose(9, 2), "a b c d e", "\x1fa b c"]
    for text in texts:
        assert simhash.fingerprint(text.encode()) == print_of(text)
    assert simhash.fingerprint(None) == 0


def components_of(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [2, 4])
def test_links_connect_what_pairs_connect(spark, tmp_path, radius):
    r = random.Random(8)
    prints = [r.getrandbits(64) for _ in range(60)]
    for p in prints[:25]:
        for flips in (1, 2, 2, 3, 4, 5):
            prints.append(p ^ sum(1 << b for b in r.sample(range(64), flips)))
    # A chain, and many that agree in most keys.
    prints += [prints[0] ^ ((1 << i) - 1) for i in range(0, 64, 2)] + [0, 1 << 63, 3] + [0xFFFF << 40 ^ i for i in range(0, 512, 5)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(table(spark, tmp_path, [(p,) for p in signed], "fp long"), radius).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in found)
    own = components_of(prints, radius)
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in found:
        root[find(a)] = find(b)
    got = [find(p) for p in signed]
    pairs = range(len(prints))
    assert all((got[i] == got[j]) == (own[i] == own[j]) for i in pairs for j in pairs[:i])


def test_classes_of_texts(spark, tmp_path, odd_docs):  # noqa: F811
    r = random.Random(9)
    rows = []
    for i in range(60):
        words = prose(150, i % 20).split()
        if i >= 20 and i % 3:
            words[r.randrange(150)] = "changed"
        rows.append((100 - i, " ".join(words)))
    rows += [(200, "one"), (201, "ONE"), (202, None), (203, "")]
    found = simhash.classes(table(spark, tmp_path, [(*x, 0) for x in rows], "doc_id long, text string, fp int")).collect()
    prints = [print_of(t) for _, t in rows]
    own = components_of(prints, 2)
    low = {c: min(rows[i][0] for i in range(len(rows)) if own[i] == c) for c in set(own)}
    assert {tuple(x) for x in found} == {(i, f"{p:016x}", low[c]) for (i, _), p, c in zip(rows, prints, own, strict=True)}
    odd = simhash.classes(odd_docs)
    assert odd.count() == odd_docs.count() and odd.where("fingerprint = '0000000000000000'").count() == 3
    assert {x.component_id for x in odd.where("doc_id = 3 or doc_id = 4").collect()} == {3}
    assert simhash.classes(odd_docs.limit(0)).count() == 0
