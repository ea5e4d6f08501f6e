"""Token ids of whole texts, by the tokenizers library, with a bounded cache of encoded words.

Both vocabularies used here cut a text into words before anything else and encode each word
alone, so a word's ids can be kept.  Texts in Latin-1 without unusual blanks, and without a
string that the tokenizer treats as special, are cut here; every other text goes to the
library as a whole.  Either way the ids are the library's.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.llm.common import small_batches

_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
# The word patterns that the two vocabulary files state, for Latin-1.
_BYTE_WORDS = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+"
)
_CASELESS_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")

#: Latin-1 bytes whose class as blank, letter or mark differs between libraries.
_UNUSUAL = bytes([*range(0, 9), *range(14, 32), *range(127, 161), 173])
#: Words whose ids are kept, about 200 bytes each; a full cache starts anew.
_MOST_WORDS = 1_000_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes lists of texts into unsigned 32-bit ids, in the byte order of the machine (little-endian)."""

    def __init__(self, path: str, caseless: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.largest_id = max(self._tokenizer.get_vocab().values())
        self._caseless = caseless
        self._words = _CASELESS_WORDS if caseless else _BYTE_WORDS
        self._line, self._last = None, None
        if caseless:
            self._last = np.zeros(self.largest_id + 1, dtype=bool)
            self._last[[i for word, i in self._tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
        else:
            self._line = self._tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _by_word(self, words: list[str]) -> list[bytes]:
        """Ids of each of many words, encoded as lines of one text and cut at the line ends.

        Words with a blank inside would not stay words there; they are encoded alone.
        """
        apart = [w for w in words if w[1:2].isspace() or w.isspace()]
        joined = [w for w in words if not (w[1:2].isspace() or w.isspace())]
        found = dict(zip(apart, self._library(apart)))
        if joined:
            ids = array("I", self._tokenizer.encode_batch_fast(["\n".join(joined)], add_special_tokens=False)[0].ids)
            data = ids.tobytes()
            at = np.frombuffer(data, dtype="<u4")
            # Either a line end is an id of its own, or a word's last id says that it is the last.
            if self._last is None:
                ends = np.append(np.flatnonzero(at == self._line), len(at))
                starts = np.concatenate([[0], ends[:-1] + 1])
            else:
                ends = np.flatnonzero(self._last[at]) + 1
                starts = np.concatenate([[0], ends[:-1]])
            if len(ends) == len(joined):
                found.update(zip(joined, map(data.__getitem__, map(slice, (4 * starts).tolist(), (4 * ends).tolist()))))
            else:
                found.update(zip(joined, self._library(joined)))
        return [found[w] for w in words]

    def _plain(self, text: str) -> bool:
        if any(s in text for s in self._special):
            return False
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return len(data.translate(None, _UNUSUAL)) == len(data)

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self._known
        cut: list[tuple[list[str], list[bytes | None]] | None] = []
        new: set[str] = set()
        for text in texts:
            if not self._plain(text):
                cut.append(None)
                continue
            words = self._words.findall(text.lower() if self._caseless else text)
            ids = list(map(known.get, words))
            if None in ids:
                new.update([w for w, i in zip(words, ids) if i is None])
            cut.append((words, ids))
        if len(known) + len(new) > _MOST_WORDS:
            known.clear()
        unknown = list(new)
        for start in range(0, len(unknown), 20_000):
            some = unknown[start:start + 20_000]
            known.update(zip(some, self._by_word(some)))
        whole = iter(self._library([t for t, c in zip(texts, cut) if c is None]))
        return [
            next(whole) if c is None
            else b"".join(c[1]) if None not in c[1]
            else b"".join([known[w] if i is None else i for w, i in zip(*c)])
            for c in cut
        ]


@lru_cache(maxsize=4)
def encoder(path: str, caseless: bool) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path, caseless)


def id_counts(path: str, caseless: bool = False) -> Callable[[Column], Column]:
    """Function from a text column (not null) to the number of its ids, with an end id each."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        found: list[int] = []
        for part in small_batches([pa.RecordBatch.from_arrays([texts], ["text"])], "text", 4 << 20):
            found += [len(ids) // 4 + 1 for ids in encoder(path, caseless).encode(part.column("text").to_pylist())]
        return pa.array(found, pa.int64())

    return count
