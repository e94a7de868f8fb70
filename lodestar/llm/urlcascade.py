"""URL filtering with a Bloom filter cascade over host-and-path rules.

The listed keys are the rules' keys, host + path prefix. The corpus's key universe is every key that a rule could have
for some URL: a suffix of the host at label borders, with a prefix of the path as long as some rule's. Level 0 encodes the
listed keys. Level 1 encodes the keys of the universe that level 0 takes for listed but are not; level 2 the listed keys
that level 1 takes for false positives of level 0, and so on until a level errs on no key. The first level that does
not hold a key tells: listed, if its number is odd. So membership is exact on the whole universe without a join; only
keys that the cascade tells are listed look up their verdict.

The first level's false-positive rate follows from the two sizes, such that the false positives, which are all that
reaches the driver, are in expectation fewer than the listed keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, with_fields

#: The contract's rules: (verdict, rule).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: The verdict on a URL that no rule fits: its keys are in no list.
UNLISTED = "allow"
#: Most rules: bounds the cascade, which every worker holds, and the false positives that reach the driver.
MOST_RULES = 10_000_000


def host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or without '://'."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(raw, upper, lower)


def path(url: Column) -> Column:
    """After the host up to '?', '#' or the end; empty for null or without '://'."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass
class Bloom:
    """A Bloom filter over pairs of 64-bit hashes; `level` shifts the probes so that levels err independently."""

    bits: np.ndarray
    probes: int
    level: int

    @staticmethod
    def of(a: np.ndarray, b: np.ndarray, rate: float, level: int) -> Bloom:
        n = max(1, len(a))
        size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        bloom = Bloom(np.zeros(-(-size // 8), np.uint8), max(1, round(-math.log2(rate))), level)
        for at in bloom._at(a, b):
            np.bitwise_or.at(bloom.bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        return bloom

    def _at(self, a: np.ndarray, b: np.ndarray):
        odd = b | np.uint64(1)
        for k in range(self.probes):
            h = a + np.uint64(k + 64 * self.level) * odd
            yield (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(8 * len(self.bits))

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for at in self._at(a, b):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key of the universe is listed."""
        out = np.zeros(len(a), bool)
        open_ = np.arange(len(a))
        for k, level in enumerate(self.levels):
            held = level.holds(a[open_], b[open_])
            out[open_[~held]] = k % 2 == 1
            open_ = open_[held]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _pairs(rows) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([r[i] for r in rows], np.int64).astype(np.uint64) for i in (0, 1))


def build(universe: DataFrame, rules: list[str]) -> Cascade:
    """The cascade of the listed keys over universe(a long, b long), the hashes of all keys of the corpus.

    One pass of the universe finds what level 0 gets wrong; the further levels only concern those keys and the listed.
    """
    spark = universe.sparkSession
    keys = spark.createDataFrame([(r,) for r in rules], "key string").distinct()
    listed = _pairs(keys.select(*hashes(F.col("key"))).collect())
    if not len(listed[0]):
        return Cascade()
    n = universe.select(F.approx_count_distinct(F.col("a"))).first()[0]
    rate = min(0.5, max(1e-12, len(listed[0]) * math.sqrt(0.5) / max(1, n)))
    first = Bloom.of(*listed, rate, 0)
    shared = spark.sparkContext.broadcast(first)

    def wrong(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.uint64) for i in (0, 1))
            held = shared.value.holds(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x[held].astype(np.int64)) for x in (a, b)], ["a", "b"])

    # What level 0 holds: the listed keys that the corpus has, which the driver knows, and the false positives.
    held = universe.mapInArrow(wrong, "a long, b long").distinct()
    false = _pairs(held.join(keys.select(*hashes(F.col("key"))), ["a", "b"], "left_anti").collect())
    shared.destroy()
    cascade, inside, outside = Cascade([first]), listed, false
    while len(outside[0]):
        level = Bloom.of(*outside, 0.5, len(cascade.levels))
        cascade.levels.append(level)
        held = level.holds(*inside)
        inside, outside = outside, tuple(x[held] for x in inside)
    return cascade


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit("second")).alias("b")


def _keys(host_: str, path_: str, lengths: list[int], longest: int) -> Column:
    """All keys that a rule could have for a URL: suffixes of the host, no longer than a rule's host, by prefixes of the path.

    Only the host's end is split, so that a host of any number of labels costs no more than the longest rule's.
    """
    labels = F.split(F.right(F.col(host_), F.lit(longest + 1)), r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    # One longer than the rules' may begin within a label.
    suffixes = F.filter(suffixes, lambda s: F.length(s) <= longest)
    fit = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(path_))
    all_ = F.flatten(F.transform(suffixes, lambda s: F.transform(fit, lambda n: F.concat(s, F.substring(F.col(path_), F.lit(1), n)))))
    return F.when(F.col(host_) == "", F.array().cast("array<string>")).otherwise(all_)


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """pages with host, path, rule (the longest that fits, or null) and verdict ('allow' or 'block').

    A rule host/path fits the host and its subdomains if the URL's path begins with the rule's. Null URLs and those
    without '://' have empty host and path, no rule, and the verdict on what is not listed: allow. Of two verdicts on one
    rule, block holds. Columns by those four names are replaced, columns named _keys, _a or _b dropped; repeated rows get
    equal answers, an empty table gives an empty one. A URL of any length is read whole.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if faulty := next((rule for _, rule in rules if "/" not in rule), None):
        raise ValueError(f"a rule is a host and a path that begins with /: {faulty!r}")
    verdicts = dict.fromkeys((rule for _, rule in rules), "allow") | {rule: "block" for verdict, rule in rules if verdict == "block"}
    lengths, longest = sorted({len(r) - r.index("/") for r in verdicts}), max((r.index("/") for r in verdicts), default=0)
    pages = pages.drop("host", "path", "rule", "verdict")
    rows = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    universe = rows.select(F.explode(F.array_distinct(_keys("host", "path", lengths, longest))).alias("key")).select(*hashes(F.col("key")))
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast((build(universe, list(verdicts)), verdicts))  # bounded by MOST_RULES

    rows = rows.withColumn("_keys", _keys("host", "path", lengths, longest))
    rows = rows.withColumns(
        {"_a": F.transform("_keys", lambda k: F.xxhash64(k)), "_b": F.transform("_keys", lambda k: F.xxhash64(k, F.lit("second")))}
    )
    kept = [c for c in rows.columns if c not in ("_keys", "_a", "_b")]

    def run(batches):
        cascade, of = shared.value
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            keys = batch.column(at["_keys"])
            a, b = (batch.column(at[n]).flatten().to_numpy(zero_copy_only=False).astype(np.uint64) for n in ("_a", "_b"))
            owner = np.repeat(np.arange(batch.num_rows), keys.value_lengths().to_numpy(zero_copy_only=False))
            flat = keys.flatten()
            rule: list[str | None] = [None] * batch.num_rows
            for k in np.flatnonzero(cascade.listed(a, b)).tolist():
                own, key = owner[k], flat[k].as_py()
                if rule[own] is None or (len(key), key) > (len(rule[own]), rule[own]):
                    rule[own] = key
            verdict = [UNLISTED if r is None else of[r] for r in rule]
            columns = [batch.column(at[n]) for n in kept] + [pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "rule", "verdict"])

    return rows.mapInArrow(run, with_fields(rows.select(*kept).schema, "rule string, verdict string"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
with rules(verdict, rule) as (values ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'),
    ('allow', 'com/fr/'), ('block', 'com/de/')),
cut as (
    select row_number() over () as rid, page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
    from pages
), split_rules as (
    select verdict, rule, split_part(rule, '/', 1) as rh, substr(rule, strpos(rule, '/')) as rp from rules
), fit as (
    select c.rid, r.rule, r.verdict, row_number() over (partition by c.rid order by length(r.rule) desc, r.rule desc) as k
    from cut c join split_rules r on (c.host = r.rh or ends_with(c.host, '.' || r.rh)) and starts_with(c.path, r.rp)
)
select c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from cut c left join fit f on f.rid = c.rid and f.k = 1
"""
