"""Language identification by cross-parsing entropy.

One suffix automaton per language is built over a bounded sample of labelled text. A text is parsed against each
automaton into the fewest greedy phrases that occur in the sample (each phrase is a longest match). The phrase count,
times log2 of the sample's length and over the text's length, estimates the cross entropy in bits per character; a letter
that the sample lacks costs STRANGE_BITS more. The language with the smallest estimate wins.

A greedy parse needs no suffix links: on a mismatch the next phrase begins with the mismatching character. Each
automaton is therefore completed into a table with one entry for each (state, character), which holds the next state
and whether a phrase began. A language has an alphabet of its own: its most frequent letters, as many as a budget of table
cells allows, are columns of the table; transitions by rarer ones are in a sorted list.

Workers step thousands of text blocks through a table in lockstep with numpy. Every block but a text's first is begun
afresh; then the parse of the block before is carried on into it until both are in one state, from where on they are the
same parse, and the count is put right. So the result is that of one parse of the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, read, with_fields

#: Characters that are parsed at once: a pass holds some twenty numbers for each of them.
PASS_CHARS = 500_000

UNDETERMINED = "und"
#: Characters of the blocks that are parsed in lockstep.
BLOCK = 1024
#: Cells of all languages' tables together, 4 bytes each, that a worker holds.
CELLS = 24_000_000
#: Classes of characters: none of a letter, a letter that the sample lacks, and letters from 2 on.
SPACE, STRANGE = 0, 1
#: Bits that a letter costs which the sample lacks, beside its phrase: a phrase tells a place in the sample, this the letter.
STRANGE_BITS = 16
#: Bits per character by which a language may trail before its share of the score falls by a factor e.
SOFTNESS = 0.25


def _letters() -> np.ndarray:
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _is_letter


_is_letter: np.ndarray | None = None


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton (DAWG) of `text`; state 0 is the root. At most 2·len states."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def normalise(text: str) -> str:
    """Lower case, with every run of other characters than letters as one space."""
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


@dataclass
class Automaton:
    """One language's completed automaton.

    A state is the place of its row; table[state + class] >> 1 is the next state, the lowest bit tells whether a phrase
    began at the character. Classes from `width` on are rare letters: rare_keys has state * len(rare) + class - width of
    their transitions, sorted, rare_next the entries; where a key is missing, a phrase begins, by rare_first.
    """

    width: int
    letters: str  # those of classes 2, 3, ...
    table: np.ndarray
    rare_keys: np.ndarray
    rare_next: np.ndarray
    rare_first: np.ndarray
    bits: float  # log2 of the sample's length

    @staticmethod
    def of(text: str, cells: int) -> Automaton:
        """The automaton of a normalised text, with `cells` table cells at most, though never fewer than two a state."""
        count: dict[str, int] = {}
        for c in set(text) - {" "}:
            count[c] = text.count(c)
        letters = sorted(count, key=lambda c: (-count[c], c))
        states = suffix_automaton(text)
        # A state for the beginning of a parse, where any character begins a phrase, comes before the root's.
        width = max(2, min(len(letters) + 2, cells // (len(states) + 1)))
        of = {c: i + 2 for i, c in enumerate(letters)} | {" ": SPACE}
        rare = len(letters) + 2 - width
        first = np.ones(width + rare, np.int64)
        for c, s in states[0].items():
            first[of[c]] = (s + 1) * width << 1 | 1
        table = np.empty((len(states) + 1, width), np.int32)
        table[:] = first[:width]
        keys, nexts = [], []
        for i, edges in enumerate(states[1:], 2):
            for c, s in edges.items():
                if (k := of[c]) < width:
                    table[i, k] = (s + 1) * width << 1
                else:
                    keys.append(i * width * rare + k - width)
                    nexts.append((s + 1) * width << 1)
        order = np.argsort(np.array(keys, np.int64))
        return Automaton(
            width, "".join(letters), table.ravel(), np.array(keys, np.int64)[order], np.array(nexts, np.int32)[order], first[width:].astype(np.int32), math.log2(max(2, len(text)))
        )

    def classes(self) -> np.ndarray:
        """Character code -> class."""
        out = np.where(_letters(), STRANGE, SPACE).astype(np.uint16 if len(self.letters) < 60_000 else np.uint32)
        out[np.array([ord(c) for c in self.letters], np.int64)] = np.arange(2, len(self.letters) + 2)
        return out

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The entries for characters of classes c."""
        if not len(self.rare_first):
            return self.table[state + c]
        c = c.astype(np.int64)
        v = self.table[state + np.minimum(c, self.width - 1)]
        at = np.flatnonzero(c >= self.width)
        if len(at):
            letter = c[at] - self.width
            v[at] = self.rare_first[letter]
            if len(self.rare_keys):
                key = state[at].astype(np.int64) * len(self.rare_first) + letter
                k = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
                known = self.rare_keys[k] == key
                v[at[known]] = self.rare_next[k[known]]
        return v

    def phrases(self, codes: np.ndarray, n: np.ndarray, carried: int) -> tuple[np.ndarray, int]:
        """Phrases of each part, and the last state; parts lie one after another in `codes`, with n codes each.

        The first part goes on from the state `carried` if that is not 0.
        """
        blocks = -(-n // BLOCK)
        part = np.repeat(np.arange(len(n)), blocks)
        nth = np.arange(len(part)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(n) - n)[part] + nth * BLOCK
        size = np.minimum(BLOCK, n[part] - nth * BLOCK)
        if not len(size):
            return np.zeros(len(n), np.int64), carried
        order = np.argsort(-size, kind="stable")
        final, count = self._run(codes, begin[order], size[order])
        back = np.argsort(order)
        final, count = final[back], count[back]
        fresh = final.copy()
        # What the parse of the block before makes of a block; a block whose last state changes by it passes that on.
        todo = np.flatnonzero(nth > 0)
        whence = final[todo - 1]
        if carried and len(n) and n[0]:
            todo, whence = np.append(0, todo), np.append(carried, whence)
        more = np.zeros(len(part), np.int64)
        while len(todo):
            more[todo], last = self._carry(codes, begin[todo], size[todo], whence)
            last = np.where(last < 0, fresh[todo], last)
            moved = last != final[todo]
            final[todo[moved]] = last[moved]
            after = todo[moved] + 1
            after = after[after < len(part)]
            todo = after[nth[after] > 0]
            whence = final[todo - 1]
        return np.bincount(part, weights=count + more, minlength=len(n)).astype(np.int64), int(final[-1])

    def _run(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last state, phrases) of each block, parsed afresh; longest blocks first."""
        state = np.zeros(len(begin), np.int32)
        count = np.zeros(len(begin), np.int32)
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for t, k in enumerate(active):
            v = self.step(state[:k], codes[begin[:k] + t])
            count[:k] += v & 1
            np.right_shift(v, 1, out=state[:k])
        return state, count

    def _carry(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, whence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases more than afresh, last state) of blocks that go on from the states `whence`; -1 if the states met."""
        more, last = np.zeros(len(begin), np.int64), np.full(len(begin), -1)
        a, b, at, t = whence.astype(np.int32), np.zeros(len(begin), np.int32), np.arange(len(begin)), 0
        while len(at):
            c = codes[begin[at] + t]
            va, vb = self.step(a, c), self.step(b, c)
            more[at] += (va & 1).astype(np.int64) - (vb & 1)
            a, b, t = va >> 1, vb >> 1, t + 1
            ended = size[at] == t
            last[at[ended]] = a[ended]
            go = (a != b) & ~ended
            a, b, at = a[go], b[go], at[go]
        return more, last


def _passes(texts: list[str | None], most: int) -> Iterator[tuple[list[int], list[str], bool]]:
    """(row numbers, lower-case texts, whether the first goes on with the text before) of about `most` characters.

    A longer text comes alone, in several pieces.
    """
    rows: list[int] = []
    parts: list[str] = []
    n = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        lower = text.lower()
        if parts and n + len(lower) > most:
            yield rows, parts, False
            rows, parts, n = [], [], 0
        if len(lower) > most:
            for at in range(0, len(lower), most):
                yield [i], [lower[at : at + most]], at > 0
            continue
        rows.append(i)
        parts.append(lower)
        n += len(lower)
    if parts:
        yield rows, parts, False


@dataclass
class LanguageModel:
    """The automata of all languages, by name."""

    langs: list[str]
    automata: list[Automaton]

    @staticmethod
    def train(samples: dict[str, str], cells: int = CELLS) -> LanguageModel:
        langs = sorted(samples)
        return LanguageModel(langs, [Automaton.of(normalise(samples[lang]), cells // max(1, len(langs))) for lang in langs])

    @property
    def bits(self) -> np.ndarray:
        return np.array([a.bits for a in self.automata])

    def classes(self) -> list[np.ndarray]:
        """Each language's classes of character codes."""
        return [a.classes() for a in self.automata]

    def parse(self, texts: list[str | None], classes: list[np.ndarray], most: int = PASS_CHARS) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by language and text, letters and spaces by text)."""
        return self.costs(texts, classes, most)[:2]

    def costs(self, texts: list[str | None], classes: list[np.ndarray], most: int = PASS_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by language and text, letters and spaces by text, letters that the sample lacks by language and text)."""
        strange = np.zeros((len(self.langs), len(texts)), np.int64)
        phrases = np.zeros((len(self.langs), len(texts)), np.int64)
        lengths = np.zeros(len(texts), np.int64)
        has = np.zeros(len(texts), bool)
        letter = _letters()
        carried, space = [0] * len(self.langs), False
        for rows, parts, more in _passes(texts, most):
            if not more:
                carried, space = [0] * len(self.langs), False
            codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            gap = ~letter[codes]
            # Of a run of other characters than letters one stands for a space.
            again = np.zeros(len(gap), bool)
            again[1:] = gap[1:] & gap[:-1] & (owner[1:] == owner[:-1])
            again[0] = gap[0] and space
            space = bool(gap[-1])
            codes, owner, gap = codes[~again], owner[~again], gap[~again]
            n = np.bincount(owner, minlength=len(parts))
            np.add.at(lengths, rows, n)
            np.logical_or.at(has, rows, np.bincount(owner[~gap], minlength=len(parts)) > 0)
            for k, (automaton, of) in enumerate(zip(self.automata, classes, strict=True)):
                own = of[codes]
                found, carried[k] = automaton.phrases(own, n, carried[k])
                np.add.at(phrases[k], rows, found)
                np.add.at(strange[k], rows, np.bincount(owner[own == STRANGE], minlength=len(parts)))
        return phrases, np.where(has, lengths, 0), strange

    def predict(self, texts: list[str | None], classes: list[np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, bits per character) of each text."""
        phrases, n, strange = self.costs(texts, classes)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits = (phrases * self.bits[:, None] + strange * STRANGE_BITS) / np.maximum(n, 1)
        best = bits.argmin(axis=0)
        low = bits.min(axis=0)
        score = 1 / np.exp((low - bits) / SOFTNESS).sum(axis=0)
        known = n > 0
        langs = [self.langs[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return langs, np.where(known, score, 0.0), np.where(known, low, 0.0)


def sample_by_language(
    labelled: DataFrame, chars: int = 40_000, total_chars: int = 800_000, docs: int = 400
) -> dict[str, str]:
    """At most `chars` characters of text for each language, from labelled(doc_id, text, lang).

    Bounds: about `docs` documents are fetched for each language, or fewer for a total of 20 * `docs`, chosen by a hash of
    doc_id; a document given twice is fetched once, and of none more than a language may have. All languages together get
    `total_chars` at most. A language of long texts only is learned from their beginnings.
    """
    fit = labelled.where("lang is not null and text is not null and doc_id is not null")
    fit = fit.where(F.length("text") >= 1)
    counts = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    budget = min(chars, max(1, total_chars // len(counts)))
    each = max(1, min(docs, 20 * docs // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    rows = fit.where(key < share[F.col("lang")]).select("lang", F.left("text", F.lit(budget)).alias("text"), F.xxhash64("doc_id").alias("h"), "doc_id")
    rows = rows.groupBy("lang", "h", "doc_id").agg(F.min("text").alias("text")).collect()
    out: dict[str, list[str]] = {}
    used: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"], r["text"])):
        if (n := used.get(r["lang"], 0)) < budget:
            out.setdefault(r["lang"], []).append(r["text"][: budget - n])
            used[r["lang"]] = n + len(r["text"])
    return {k: " ".join(v) for k, v in out.items()}


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", within: str | None = None) -> DataFrame:
    """docs with lang_pred string, score double (0 to 1) and bits_per_char double.

    Every whole text is parsed. Null texts and texts without a letter get 'und', score 0. Where languages tie, the
    alphabetically first wins. Repeated rows get equal answers; an empty table gives an empty table. Columns of `docs`
    by those three names are replaced. With `within`, the text is the field `text` of that struct column.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "bits_per_char")
    shared = spark.sparkContext.broadcast(model)  # bounded by sample_by_language's total_chars

    def run(batches):
        classes = shared.value.classes()
        for batch in batches:
            texts = batch.column(text) if within is None else pc.struct_field(batch.column(within), text)
            langs, score, bits = shared.value.predict(texts.to_pylist(), classes)
            new = [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "bits_per_char"])

    return map_texts(docs, run, with_fields(docs.schema, "lang_pred string, score double, bits_per_char double"))


def held_out(doc_id: str = "doc_id"):
    """The contract's fold: crc32 of doc_id as text, mod 4, is 2 (false for a null doc_id)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame) -> LanguageModel:
    """A model of the rows of docs(doc_id, text, lang) outside the held-out fold."""
    return LanguageModel.train(sample_by_language(docs.where(~held_out())))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    # The text itself is dropped after the prediction.
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_char")
