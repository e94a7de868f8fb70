"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is the logistic of a bias plus the weights of its words; a word's weight is the sum of
its own and those of its beginnings, all hashed. A document is toxic if any of its sentences is: 1 - product(1 - p), noisy-or.
Training maximises the likelihood of document labels through the noisy-or, by Adagrad over a bounded sample of labelled
documents; the fitted sentence probabilities then locate the offending sentences.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, read, with_fields

THRESHOLD = 0.7
#: A sentence of this probability or more is listed as offending.
SENTENCE_THRESHOLD = 0.5
#: Hash buckets of features.
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7, 8)
#: The training sample's bounds: toxic and clean documents, and characters of a document.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 3000, 6000, 20_000
#: Of the sample, every CALIBRATE-th document sets the offset of the log odds instead of the weights.
CALIBRATE = 6
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")


def word_features(word: str) -> list[int]:
    """Buckets of the word itself and of its beginnings, by which the forms of a stem share weight."""
    cuts = [word[:n] for n in PREFIXES if n < len(word)]
    return [zlib.crc32(b"=" + word.encode()) % BUCKETS, *(zlib.crc32(b"^" + c.encode()) % BUCKETS for c in cuts)]


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    offset: float = 0.0  # added to a document's log odds

    def word_weight(self, word: str) -> float:
        return float(self.weights[word_features(word)].sum())

    def cache(self, size: int = 300_000) -> Memo:
        """Word -> weight; the ends of sentences are nan."""
        memo = Memo(self.word_weight, size)
        for end in _ENDS:
            memo[end] = memo.old[end] = float("nan")
        return memo

    def score(self, texts: list[str | None], cache: Memo) -> np.ndarray:
        """Each whole text's probability; 0 for a text without a word."""
        flat: list[float] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                before = len(flat)
                flat.extend([cache[t] for t in _TOKEN.findall(text.lower())])
                flat.append(float("nan"))
                sizes[i] = len(flat) - before
        z, owner, size = _sums(np.array(flat), np.repeat(np.arange(len(texts)), sizes))
        log_clean = -np.bincount(owner[size > 0], weights=np.logaddexp(0, z[size > 0] + self.bias), minlength=len(texts))
        odds = np.maximum(-np.expm1(log_clean), 1e-300) / np.exp(np.maximum(log_clean, -600)) * np.exp(self.offset)
        return np.where(log_clean < 0, odds / (1 + odds), 0.0)

    def sentences(self, text: str, cache: Memo) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence, by character offsets in the text."""
        out, start, last, z = [], None, 0, self.bias
        for m in _TOKEN.finditer(text):
            if m.group() in _ENDS:
                if start is not None:
                    out.append((start, m.end(), z))
                start, z = None, self.bias
                continue
            start = m.start() if start is None else start
            last = m.end()
            z += sum(cache[t] for t in _TOKEN.findall(m.group().lower()))
        if start is not None:
            out.append((start, last, z))
        return [(a, b, 1 / (1 + np.exp(-min(max(z, -500), 500)))) for a, b, z in out]


def _sums(flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of weights, document, words) of each sentence; nan ends a sentence, and every document ends with one."""
    ends = np.flatnonzero(np.isnan(flat))
    begin = np.append(0, ends[:-1] + 1) if len(ends) else ends
    total = np.append(0.0, np.cumsum(np.where(np.isnan(flat), 0.0, flat)))
    return total[ends] - total[begin], owner[ends], ends - begin


def fit(texts: list[str], labels: np.ndarray, rounds: int = 200, rate: float = 0.25, l2: float = 3e-4) -> ToxicityModel:
    """Noisy-or training over whole documents; without both labels the model scores 0.5 at most for any text."""
    vocab: dict[str, int] = {}
    words, sentence, doc = [], [], []
    n = 0
    for d, text in enumerate(texts):
        fresh = True
        for t in _TOKEN.findall(text.lower()):
            if t in _ENDS:
                fresh = True
                continue
            if fresh:
                doc.append(d)
                n += 1
                fresh = False
            words.append(vocab.setdefault(t, len(vocab)))
            sentence.append(n - 1)
    w, s, d = np.array(words, np.int64), np.array(sentence, np.int64), np.array(doc, np.int64)
    lists = [word_features(t) for t in vocab]
    owner = np.repeat(np.arange(len(lists)), np.array([len(x) for x in lists], np.int64))
    feature = np.array([f for x in lists for f in x], np.int64)
    weights, bias = np.zeros(BUCKETS), -5.0
    if not len(w) or labels.min() == labels.max():
        return ToxicityModel(weights.astype(np.float32), bias)
    square, square_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        of_word = np.bincount(owner, weights=weights[feature], minlength=len(lists))
        z = bias + np.bincount(s, weights=of_word[w], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        clean = np.exp(-np.bincount(d, weights=np.logaddexp(0, z), minlength=len(texts)))
        # d(-log likelihood)/dz is p for a sentence of a clean document, and -p (1 - P) / P for one of a toxic document.
        pull = np.where(labels[d] > 0, -(clean / np.maximum(1 - clean, 1e-9))[d], 1.0) * p / len(texts)
        grad_word = np.bincount(w, weights=pull[s], minlength=len(lists))
        grad = np.bincount(feature, weights=grad_word[owner], minlength=BUCKETS) + l2 * weights
        square += grad**2
        square_bias += pull.sum() ** 2
        weights -= rate * grad / np.sqrt(square)
        bias -= rate * pull.sum() / np.sqrt(square_bias)
    return ToxicityModel(weights.astype(np.float32), float(bias))


def calibrated(model: ToxicityModel, texts: list[str], labels: np.ndarray, threshold: float = THRESHOLD) -> ToxicityModel:
    """The model, with the offset at which calling scores of `threshold` toxic has the best F1 on these documents."""
    p = np.clip(model.score(texts, model.cache()), 1e-12, 1 - 1e-12)
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(len(p)) + 1 + max(labels.sum(), 1))
    if len(p) and labels.any() and not labels.all():
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        odds = np.log(p / (1 - p))[order]
        # Halfway between the last document called toxic and the first that is not.
        at = (odds[best[0]] + odds[min(best[-1] + 1, len(p) - 1)]) / 2
        model.offset = float(np.clip(np.log(threshold / (1 - threshold)) - at, -3, 3))
    return model


def held_out(doc_id: str = "doc_id"):
    """The contract's fold: crc32 of doc_id as text, mod 3, is 1 (false for a null doc_id)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, chars: int = SAMPLE_CHARS
) -> ToxicityModel:
    """A model of docs(doc_id, text) and labels(doc_id, toxic), without the held-out fold.

    About `toxic` and `clean` documents of at most `chars` characters, by a hash of doc_id, are fetched; of a doc_id given
    twice one text. A document with several labels is toxic if one says so.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (toxic if k else clean) / n))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6 < share[F.col("toxic")])
    # The sample's ids are bounded by both numbers, so they are broadcast and no text is shuffled.
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, chars)).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.any_value("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    parts = [[r for i, r in enumerate(rows) if (i % CALIBRATE == 0) == part] for part in (False, True)]
    (texts, y), (own, own_y) = (([r["text"] for r in p], np.array([int(r["toxic"]) for r in p])) for p in parts)
    return calibrated(fit(texts, y), own, own_y)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with score double, predicted int and sentences array<struct<start, end, score>>.

    Every whole text is scored; null texts and those without a word get 0. `sentences` lists the sentences of probability
    0.5 or more of documents predicted toxic, or the likeliest one if none is; others have none. Columns by those
    three names are replaced; repeated rows get equal answers.
    """
    docs = docs.drop("score", "predicted", "sentences")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches):
        model = shared.value
        cache = model.cache()
        for batch in batches:
            texts = batch.column(text)
            scores = np.zeros(batch.num_rows)
            group: list[int] = []
            n = 0
            for i in range(batch.num_rows + 1):
                if i < batch.num_rows:
                    group.append(i)
                    n += len(texts[i].as_py() or "")
                if group and (n >= 2_000_000 or i == batch.num_rows):
                    scores[group] = model.score([texts[k].as_py() for k in group], cache)
                    group, n = [], 0
            found = []
            for i in range(batch.num_rows):
                own = model.sentences(texts[i].as_py(), cache) if scores[i] >= threshold else []
                hit = [x for x in own if x[2] >= SENTENCE_THRESHOLD] or ([max(own, key=lambda x: x[2])] if own else [])
                found.append([{"start": a, "end": b, "score": float(p)} for a, b, p in hit])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            new = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "score", "predicted", "sentences"])

    more = "score double, predicted int, sentences array<struct<start: int, end: int, score: double>>"
    return docs.mapInArrow(run, with_fields(docs.schema, more))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", "predicted", "sentences")
