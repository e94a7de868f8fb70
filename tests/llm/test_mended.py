"""Repeated ids in searches, languages of long texts only, hosts of many labels."""

import time

from pyspark.sql import functions as F

from lodestar.llm import langid, urlcascade, vptree


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(5, [1.0, 0.0]), (9, [1.0, 0.0]), (5, [0.5, 0.1]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (7, [0.0, 2.0]), (7, [0.0, 2.0]), (3, [-1.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (2, 100):
        for query in range(len(rows)):
            asked = table.where("vec_id = 0" if rows[query][0] == 0 else f"vec_id = {rows[query][0]}")
            same = [i for i, r in enumerate(rows) if r[0] == rows[query][0]]
            want = []
            for q in same:
                scored = sorted((-sum(a * b for a, b in zip(rows[q][1], v, strict=True)), i) for n, (i, v) in enumerate(rows) if n != q)
                want += [(rows[q][0], k, i, -s) for k, (s, i) in enumerate(scored[:4], 1)]
            got = [tuple(r) for r in vptree.search(asked, table, k=4, factor=1.0, shard=shard).collect()]
            assert sorted(got) == sorted((a, b, c, d) for a, b, c, d in want)
        if shard == 2:
            break_ = vptree.search(table.where("vec_id = 3"), table, k=50, factor=1.0, shard=shard)
            assert break_.count() == len(rows) - 1


def test_a_language_of_long_texts_only_is_learned(spark):
    latin, greek = "the cat sat on the mat and ", "η γάτα κάθισε στο χαλί και "
    rows = [(i, (greek * 2000 if i % 2 else latin) + str(i), "el" if i % 2 else "en") for i in range(30)]
    sample = langid.sample_by_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(sample) == {"en", "el"} and max(map(len, sample.values())) <= 2 * 40_000 and "γάτα" in sample["el"]


def test_hosts_of_many_labels(spark):
    rules = [("block", "a.example.org/x/"), ("allow", "org/"), ("block", "le.org/")]
    urls = [
        ("http://" + "b." * 100_000 + "a.example.org/x/1", "a.example.org/x/"), ("http://" + "b" * 300_000 + ".org/", "org/"), ("http://a.example.org/x/", "a.example.org/x/"),
        ("http://ba.example.org/x/", "org/"), ("http://.a.example.org/x/", "a.example.org/x/"), ("http://xxxle.org/", "org/"), ("http://le.org/", "le.org/"), ("http://org/", "org/"),
        ("http://org./", None), ("http://" + "." * 50_000 + "/", None),
    ]
    pages = spark.createDataFrame([(u,) for u, _ in urls], "url string")
    urlcascade.judge(pages, rules).collect()
    start = time.perf_counter()
    got = {r.url: r.rule for r in urlcascade.judge(pages, rules).select("url", "rule").collect()}
    assert got == dict(urls) and time.perf_counter() - start < 10
    assert urlcascade.judge(pages.where(F.lit(False)), rules).count() == 0
