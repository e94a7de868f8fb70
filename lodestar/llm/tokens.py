"""Token ids of whole texts by the tokenizers library, with a cache of token groups.

The tokenizer drops white space and never joins what white space separates: it cuts a text into groups (a run of letters,
one digit, a run of other characters, an English contraction) and encodes each by its model alone. Texts of Latin-1
characters, whose normal form and lower case are plain in any library, are cut into groups here, by array operations over
bytes; each distinct group is encoded by the library's model once in a worker, and texts are put together from cached ids.
In all other texts blank-separated words take the place of groups, and the whole library encodes each. The tests hold
both against encoding whole texts.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from .common import Memo

#: The tokenizer file that the contracts name, and the id that ends a document.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
_END = array("I", [END_ID]).tobytes()
#: Texts with another character, or with what may be a special token, are left to the library.
_OTHER = re.compile("[^\t-\r -~¡-ÿ]|<\\|")
_BLANK = re.compile("[ \t-\r]")


def _byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints, else the next free one from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    free = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(free)) for b in range(256)]


_BYTES = _byte_letters()
_LOWER = bytes(ord(chr(b).lower()) if len(chr(b).lower()) == 1 and ord(chr(b).lower()) < 256 else b for b in range(256))
#: Kinds of characters: white space, letter, digit, other.
SPACE, LETTER, DIGIT, SIGN = range(4)
_KIND = np.array(
    [SPACE if chr(b).isspace() else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(b))[0], SIGN) for b in range(256)], np.uint8
)
#: Words and groups longer than this are not cached.
LONG_WORD = 64


def _contractions(c: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
    """Moves the starts of groups behind 's 't 'm 'd 're 've 'll, which are groups of their own after a single quote."""
    padded = np.append(c, np.zeros(3, np.uint8))
    quote = np.flatnonzero(start & (c == ord("'")))
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for at, size in ((quote[short], 2), (quote[long], 3)):
        start[at + 1] = False
        after = at + size
        after = after[after < len(c)]
        start[after[kind[after] == LETTER]] = True


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; caches have `cache` entries in each of two generations."""

    def __init__(self, path: str, cache: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Memo(size=cache)
        self.groups = Memo(size=cache)

    def _group(self, group: bytes) -> bytes:
        """The ids of one group of lower-case Latin-1 bytes."""
        mapped = group.decode() if group.isascii() else "".join([_BYTES[b] for b in group.decode("latin-1").encode()])
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _latin(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text of Latin-1 characters."""
        raw = "\n".join(texts).encode("latin-1").translate(_LOWER)
        c = np.frombuffer(raw, np.uint8)
        kind = _KIND[c]
        start = kind != SPACE
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        _contractions(c, kind, start)
        solid = kind != SPACE
        offsets = np.append(np.flatnonzero(start[solid]), np.count_nonzero(solid)).astype(np.int32)
        groups = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(c[solid])])
        coded = groups.dictionary_encode()
        known, found = self.groups, []
        for g in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            ids = known.get(g)
            if ids is None:
                ids = known.old.get(g) or self._group(g)
                if len(g) <= LONG_WORD:
                    known.put(g, ids)
            found.append(ids)
        pool = np.frombuffer(b"".join(found), np.uint32)
        size = np.array([len(ids) >> 2 for ids in found], np.int64)
        begin = np.cumsum(size) - size
        of = coded.indices.to_numpy(zero_copy_only=False)
        each = size[of]
        ends = np.cumsum(each)
        ids = pool[np.repeat(begin[of] - (ends - each), each) + np.arange(int(each.sum()))]
        # Where each text begins, in characters, in groups and in ids.
        chars = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        first = np.searchsorted(np.flatnonzero(start), chars)
        return np.split(ids, np.append(0, ends)[first][1:]) if texts else []

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that the cache lacks, which it then has too, but for very long ones."""
        unknown = self.words.unknown(words)
        encoded = self.tokenizer.encode_batch_fast(unknown, add_special_tokens=False) if unknown else ()
        found = {w: array("I", e.ids).tobytes() for w, e in zip(unknown, encoded, strict=True)}
        for w, ids in found.items():
            if len(w) <= LONG_WORD:
                self.words.put(w, ids)
        return found

    def _any(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, whatever its characters."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = self._learn(set(chain.from_iterable(split)))

        def get(word: str) -> bytes:
            # The cache may have turned over while it learned; the new words are at hand in any case.
            ids = self.words.get(word) or self.words.old.get(word) or new.get(word)
            return self._learn({word}).get(word, b"") if ids is None else ids

        return [np.frombuffer(b"".join(map(get, words)), np.uint32) for words in split]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text as uint32; none for null and empty ones."""
        out = [np.zeros(0, np.uint32)] * len(texts)
        latin, rest = [], []
        for i, t in enumerate(texts):
            if t:
                (rest if _OTHER.search(t) else latin).append(i)
        for rows, encode in ((latin, self._latin), (rest, self._any)):
            if rows:
                for i, ids in zip(rows, encode([texts[i] for i in rows]), strict=True):
                    out[i] = ids
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def documents(self, texts: Iterable[str | None], most: int = 1_000_000) -> Iterator[bytes]:
        """The ids of each text and the end id.

        Texts go in groups of about `most` characters. A longer text is cut after white space, which no group of
        characters goes across, so that memory is bounded by its ids alone.
        """
        group: list[str | None] = []
        n = 0
        for text in texts:
            if text and len(text) > most:
                yield from (ids.tobytes() + _END for ids in self.encode_all(group))
                group, n = [], 0
                yield b"".join([*(self.encode(part).tobytes() for part in _parts(text, most)), _END])
                continue
            group.append(text)
            n += len(text or "")
            if n >= most:
                yield from (ids.tobytes() + _END for ids in self.encode_all(group))
                group, n = [], 0
        yield from (ids.tobytes() + _END for ids in self.encode_all(group))


def _parts(text: str, most: int) -> Iterator[str]:
    """Parts of about `most` characters that end with white space, but for the last."""
    at = 0
    while at < len(text):
        m = _BLANK.search(text, at + most)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


_encoders: dict[str, Encoder] = {}


def encoder(path: str = TOKENIZER) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
