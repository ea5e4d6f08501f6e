"""Language of a text, by a convolutional network over its bytes, trained here on labelled text.

Bytes become short vectors; filters of several widths slide over a window of ``WINDOW``
bytes; each filter keeps its largest answer; a softmax over those gives probabilities.
A text is cut into windows that overlap by the widest filter less one, so every run of
bytes is seen, and the windows' probabilities are averaged by their number of letters.

Training takes at most ``MOST_SAMPLES`` distinct texts in all (evenly by language, those
with the smallest hashes of their text), and two windows of each.  They are the only rows
that reach the driver.  Prediction reads nothing but the text.

* Null text, and text without a letter, is ``und`` with score 0.
* Rows without a language are not learned from, but predicted.  Repeated texts are learned
  once.  If no labelled text has a letter, everything is ``und``.
* Of equal probabilities the language first in order wins.
* Texts of any length are read whole, ``_CHUNK`` windows at a time.
* An empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import small_batches, text_of

#: Texts that training takes in all, and per language.
MOST_SAMPLES, MOST_PER_LANG = 6_000, 1_500
#: Languages that are learned: the most frequent ones.
MOST_LANGS = 200

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4, 5), 16, 8
_WIDEST = max(WIDTHS)
#: New bytes of a window; the rest belongs to the next window as well.
STEP = WINDOW - _WIDEST + 1
_CHUNK = 32
_KEY_BITS = 50
_EPOCHS, _BATCH, _RATE = 6, 64, 0.01
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class ByteNet:
    """Bytes, filters of several widths, largest answers, softmax."""

    def __init__(self, langs: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs, n = langs, len(WIDTHS) * FILTERS
        # A filter narrower than the widest has zeros in its last rows, and keeps them.
        self.mask = np.zeros((_WIDEST * DIM, n), dtype=np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[:width * DIM, i * FILTERS:(i + 1) * FILTERS] = 1
        spread = np.sqrt(1 / self.mask.sum(axis=0))
        self.weights = {
            "bytes": rng.normal(0, 1, (256, DIM)),
            "filters": rng.normal(0, 1, self.mask.shape) * spread * self.mask,
            "bias": np.zeros(n),
            "out": rng.normal(0, 0.2, (n, len(langs))),
            "out_bias": np.zeros(len(langs)),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def _answers(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte vectors under each place, and every filter's answer there."""
        n = len(windows)
        vectors = self.weights["bytes"][windows]
        row, place, item = vectors.strides
        runs = np.lib.stride_tricks.as_strided(vectors, (n, STEP, _WIDEST * DIM), (row, place, item))
        runs = np.ascontiguousarray(runs).reshape(n * STEP, -1)
        return runs, (runs @ self.weights["filters"]).reshape(n, STEP, -1)

    def _softmax(self, largest: np.ndarray) -> np.ndarray:
        scores = np.maximum(largest + self.weights["bias"], 0) @ self.weights["out"] + self.weights["out_bias"]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities, a row per window."""
        return self._softmax(self._answers(windows)[1].max(axis=1))

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy.  Only the place of a filter's largest answer passes anything back."""
        n, w = len(windows), self.weights
        runs, answers = self._answers(windows)
        places = answers.argmax(axis=1)
        largest = np.take_along_axis(answers, places[:, None], axis=1)[:, 0]
        pooled = np.maximum(largest + w["bias"], 0)
        wrong = self._softmax(largest)
        wrong[np.arange(n), labels] -= 1
        wrong /= n
        back = (wrong @ w["out"].T) * (pooled > 0)
        at = runs.reshape(n, STEP, -1)[np.arange(n)[:, None], places]
        to_bytes = (back[:, :, None] * w["filters"].T[None]).reshape(-1, DIM)
        seen = windows[np.arange(n)[:, None, None], places[:, :, None] + np.arange(_WIDEST)].reshape(-1)
        return {
            "bytes": np.stack([np.bincount(seen, to_bytes[:, d], 256) for d in range(DIM)], axis=1),
            "filters": np.einsum("nf,nfk->kf", back, at) * self.mask,
            "bias": back.sum(axis=0),
            "out": pooled.T @ wrong,
            "out_bias": wrong.sum(axis=0),
        }

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 1) -> None:
        """Adam over shuffled windows; each time a text is met, another stretch of it is shown.

        A third of the stretches are short, so that short texts are learned as well.
        """
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, steps = 0, _EPOCHS * -(-len(texts) // _BATCH)
        for _ in range(_EPOCHS):
            order = rng.permutation(len(texts))
            for start in range(0, len(order), _BATCH):
                some = order[start:start + _BATCH]
                windows = np.zeros((len(some), WINDOW), dtype=np.uint8)
                for row, i in enumerate(some):
                    size = int(rng.integers(16, WINDOW)) if rng.random() < 1 / 3 else WINDOW
                    at = int(rng.integers(0, max(1, len(texts[i]) - size + 1)))
                    piece = texts[i][at:at + size]
                    windows[row, :len(piece)] = np.frombuffer(piece, dtype=np.uint8)
                step += 1
                rate = _RATE * (1 - (step - 1) / steps) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                for name, slope in self.gradients(windows, labels[some]).items():
                    first[name] = (0.9 * first[name] + 0.1 * slope).astype(np.float32)
                    second[name] = (0.999 * second[name] + 0.001 * slope * slope).astype(np.float32)
                    self.weights[name] -= (rate * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)


def training_rows(docs: DataFrame, lang: Column, learn: Column, most_samples: int, most_per_lang: int) -> DataFrame:
    """Bounded sample of labelled texts: language, hash of the text, two stretches of it.

    Distinct texts are counted by sketches, which gives each language the share of hashes to
    keep; copies are merged before anything is ranked.
    """
    rows = (
        docs.filter(learn & lang.isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select(lang.cast("string").alias("lang"), F.col("text"), F.shiftrightunsigned(F.xxhash64("text"), 64 - _KEY_BITS).alias("key"))
    )
    sizes = (
        rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n"))
        .orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    )
    each = min(most_per_lang, most_samples // max(1, len(sizes)))
    below = F.lit(-1).cast("bigint")
    for size in sizes:
        # A little more than needed, as the count is an estimate and hashes are not evenly spread.
        share = min(1.0, (1.2 * each + 100) / max(1, size["n"]))
        below = F.when(F.col("lang") == size["lang"], F.lit(int(share * (1 << _KEY_BITS)))).otherwise(below)
    length = F.length("text")

    def stretch(seed: int) -> Column:
        start = F.pmod(F.xxhash64(F.lit(seed), "key"), F.greatest(F.lit(1), length - WINDOW)).cast("int")
        return F.substring("text", start + 1, F.lit(2 * WINDOW))

    kept = (
        rows.filter(F.col("key") <= below)
        .select("lang", "key", F.array(stretch(1), stretch(2)).alias("stretches"))
        .groupBy("lang", "key").agg(F.min("stretches").alias("stretches"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return kept.withColumn("_rank", rank).filter(F.col("_rank") <= each).drop("_rank")


def train(docs: DataFrame, lang: Column, learn: Column, most_samples: int = MOST_SAMPLES,
          most_per_lang: int = MOST_PER_LANG) -> ByteNet | None:
    """Network fitted on a bounded sample of ``docs`` (text); None if there is nothing to learn."""
    rows = training_rows(docs, lang, learn, most_samples, most_per_lang).collect()
    rows.sort(key=lambda r: (r["lang"], r["key"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    number = {name: i for i, name in enumerate(langs)}
    texts = [s.encode() for r in rows for s in r["stretches"]]
    labels = np.repeat([number[r["lang"]] for r in rows], 2)
    net = ByteNet(langs)
    net.fit(texts, labels)
    return net


def window_starts(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and text of every window, for texts that lie one after the other and end at ``ends``."""
    begins = np.concatenate([[0], ends[:-1]])
    counts = -(-(ends - begins) // STEP)
    text = np.repeat(np.arange(len(ends)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return begins[text] + place * STEP, text


def text_probabilities(net: ByteNet, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each text (zeros without letters), and its number of windows."""
    array = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    ends = offsets[1:] - offsets[0]
    whole = array.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8)[offsets[0]:offsets[-1]] if whole is not None else np.empty(0, np.uint8)
    starts, text = window_starts(ends)
    found = np.zeros((len(ends), len(net.langs)))
    letters = np.zeros(len(ends))
    for k in range(0, len(starts), _CHUNK):
        at = starts[k:k + _CHUNK, None] + np.arange(WINDOW)
        inside = at < ends[text[k:k + _CHUNK], None]
        windows = np.where(inside, data[np.minimum(at, len(data) - 1)], np.uint8(0))
        weight = _LETTER[windows[:, :STEP]].sum(axis=1).astype(np.float64)
        np.add.at(found, text[k:k + _CHUNK], net.predict(windows) * weight[:, None])
        np.add.at(letters, text[k:k + _CHUNK], weight)
    return found / np.maximum(letters, 1)[:, None], np.bincount(text, minlength=len(ends))


def _predictions(net: ByteNet):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.langs, UNKNOWN], dtype=object)
        for batch in small_batches(batches, "text", 4 << 20):
            found, windows = text_probabilities(net, batch.column("text"))
            known = batch.column("has_letter").to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(known, found.argmax(axis=1), len(net.langs))
            score = np.where(known, np.round(np.clip(found.max(axis=1), 0, 1), 4), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(windows.astype(np.int64))],
                names=["doc_id", "lang_pred", "score", "n_windows"],
            )

    return apply


def predict(net: ByteNet | None, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language, score and number of windows of every text; texts are not shuffled."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    if net is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("n_windows"))
    docs = docs.withColumn("has_letter", F.col("text").rlike(r"\p{L}"))
    return docs.mapInArrow(_predictions(net), "doc_id bigint, lang_pred string, score double, n_windows bigint")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       held_out: Column | None = None) -> DataFrame:
    """Trains on the rows of ``docs`` that are not held out, and predicts all of them."""
    held_out = F.lit(False) if held_out is None else held_out
    rows = docs.select(text_of(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out.alias("held_out"))
    net = train(rows, F.col("lang"), ~F.col("held_out"))
    return predict(net, docs, id_col, text_col)


def held_out(id_col: str | Column, parts: int = 4, part: int = 2) -> Column:
    """A quarter of the ids, by the crc32 of the decimal id (null: of the empty string)."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(parts)) == part
