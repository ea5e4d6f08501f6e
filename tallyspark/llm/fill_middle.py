"""Fill-in-the-middle texts, cut at token boundaries that a learned rank index gives.

The offsets (in code points) of a text's token boundaries are a rising sequence: rank to
offset.  ``RankIndex`` fits it with line segments, each as long as all its offsets stay
within ``ERROR`` of the line, and keeps what the lines miss as one byte per boundary.  A
cut is predicted from its segment and made exact by its residual, so no boundary offset
itself is kept.  Tokens are runs of A-Z and a-z, and every other code point alone.

Which ranks are cut, and into which form a text goes, follows from hash words of its id.

* Null text is empty; an empty text has no token and stays plain.
* A text that holds one of the marks stays plain, so every output is read back exactly.
* A null id hashes as the empty string.  Repeated rows give equal rows.
* A text of any length is indexed in blocks of ``BLOCK`` code points: memory is the text
  itself and one byte per boundary.  A token that spans blocks counts once.
* An empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import small_batches, text_of

#: Most an offset may lie off its segment's line, before rounding; residuals then fit one signed byte.
ERROR = 120
#: Code points that are looked at in one go.
BLOCK = 1 << 20
#: First stretch of boundaries that is tried for a segment; it doubles while the line holds.
_FIRST = 512

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def boundaries(text: str, start: int, stop: int) -> np.ndarray:
    """Offsets in [start, stop) at which a token starts."""
    # One code point before the block tells whether a letter goes on with a run.
    before = max(0, start - 1)
    codes = np.frombuffer(text[before:stop].encode("utf-32-le", "surrogatepass"), dtype="<u4")
    folded = codes | 32
    letter = (folded >= 97) & (folded <= 122) & (codes < 128)
    opens = np.ones(len(codes), dtype=bool)
    opens[1:] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(opens[start - before:]) + start


def fit_segments(offsets: np.ndarray, error: float = ERROR) -> list[tuple[int, int, float]]:
    """Greedy segments (first rank, first offset, slope) that miss no offset by more than ``error``.

    From a segment's first boundary, every later one allows a range of slopes; the segment
    ends where no slope is left in all of them.
    """
    segments, n, at = [], len(offsets), 0
    while at < n:
        low, high, reach, width = -np.inf, np.inf, at, _FIRST
        while reach < n - 1:
            stop = min(n, reach + 1 + width)
            run = np.arange(reach + 1 - at, stop - at, dtype=np.float64)
            rise = (offsets[reach + 1:stop] - offsets[at]).astype(np.float64)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            fits = len(run) if highs[-1] >= lows[-1] else int(np.argmax(lows > highs))
            if fits:
                low, high, reach = lows[fits - 1], highs[fits - 1], reach + fits
            if fits < len(run):
                break
            width *= 2
        slope = 0.0 if reach == at else (low + high) / 2
        segments.append((at, int(offsets[at]), slope))
        at = reach + 1
    return segments


class RankIndex:
    """Offsets of all token boundaries of one text: ranks 0 to ``n``, the last being the text's end."""

    def __init__(self, text: str):
        self.ranks: list[int] = []
        self.bases: list[int] = []
        self.slopes: list[float] = []
        missed: list[np.ndarray] = []
        seen = 0
        for start in range(0, max(1, len(text)), BLOCK):
            stop = min(len(text), start + BLOCK)
            offsets = boundaries(text, start, stop)
            if stop == len(text):
                offsets = np.append(offsets, stop)
            for rank, base, slope in (pieces := fit_segments(offsets)):
                self.ranks.append(seen + rank)
                self.bases.append(base)
                self.slopes.append(slope)
            ends = [rank for rank, _, _ in pieces[1:]] + [len(offsets)]
            for (rank, base, slope), end in zip(pieces, ends):
                line = base + np.rint(slope * np.arange(end - rank, dtype=np.float64)).astype(np.int64)
                missed.append((offsets[rank:end] - line).astype(np.int8))
            seen += len(offsets)
        self.residuals = np.concatenate(missed)
        self.n = seen - 1

    def offset(self, rank: int) -> int:
        """Code points before the boundary: the prediction of its segment and the residual."""
        i = bisect_right(self.ranks, rank) - 1
        line = self.bases[i] + int(np.rint(self.slopes[i] * float(rank - self.ranks[i])))
        return line + int(self.residuals[rank])


def hash_words(doc_id: int | None, seed: int) -> list[int]:
    """The first four groups of eight hex digits of the sha256 of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def restore(form: str, output: str) -> str:
    """The text that an output was made of.  A mark can occur only once: texts with marks stay plain."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, rest = output[len(first):].split(second, 1)
    b, middle = rest.split(MIDDLE, 1)
    return a + middle + b if form == "psm" else b + middle + a


def _transform(seed: int, changed_percent: int, spm_percent: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                index = RankIndex(text)
                h1, h2, h3, h4 = hash_words(doc_id, seed)
                if not text or h3 % 100 >= changed_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((doc_id, index.n, "plain", None, None, None, text))
                    continue
                ranks = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
                a, b = (index.offset(r) for r in ranks)
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if h4 % 100 < spm_percent:
                    form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
                else:
                    form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
                rows.append((doc_id, index.n, form, a, b - a, len(index.ranks), output))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "n_segments", "output"],
            )

    return apply


_OUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, n_segments bigint, output string"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   changed_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """One row per document: number of tokens, form, cuts in code points, output text.

    ``n_segments`` counts the line segments of the text's index (null where the text stays
    plain, as do the cuts).  ``changed_percent`` of the documents are turned around, and
    ``spm_percent`` of those put the suffix first.  Texts are never shuffled.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return docs.mapInArrow(_transform(seed, changed_percent, spm_percent), _OUT)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "output"):
        texts = map(restore, batch.column("form").to_pylist(), batch.column("output").to_pylist())
        yield batch.append_column("restored", pa.array(texts, pa.string()))


def with_restored(made: DataFrame) -> DataFrame:
    """``made`` with the text that each output gives back, in a column ``restored``."""
    return made.mapInArrow(_restored, f"{_OUT}, restored string")
