"""Document fingerprints from closed syncmers.

A run of ``K`` code points is an anchor if the smallest hash among its inner runs of ``S``
code points is its first or its last one.  Whether a run is an anchor depends on that run
alone, so a passage has the same anchors in every text that holds it.  A fingerprint keeps
the anchors whose hash is below a power of two, each with its place: the largest power that
leaves at most ``KEEP``, but never less than one hash in two to the power of ``SPARSEST``.
So a fingerprint grows with its text, and a passage shared by two long texts is seen at the
same density as one shared by short ones.  Two fingerprints are compared at the stricter of
their powers: shared anchors count as far as they come in the same order in both texts.

Null text is empty.  An empty text has no anchors; a text without a closed syncmer has one
anchor, the whole text.  Rows are ordered by doc_id (null first), then text; repeated rows
follow each other.  Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import mix64, order_bounds, small_batches, text_of

S, K, KEEP = 8, 23, 64
#: Of long texts, one anchor in two to this power is kept: about one for every 64 code points.
SPARSEST = 3
_INNER = K - S + 1
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` (a power of two) neighbours."""
    step = 1
    while step < width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x


def anchors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and 32-bit hashes of every text's anchors, in order of place."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    found, hashes = np.empty(0, np.int64), np.empty(0, np.uint32)
    if len(codes) >= K:
        inner = mix64(codes + _A)
        step = 1
        while step < S:
            inner = inner[:-step] * _A + inner[step:] * _B
            inner ^= inner >> np.uint64(29)
            step *= 2
        inner = mix64(inner)
        least = _sliding_min(inner, _INNER)
        at_edge = (inner[: len(least)] == least) | (inner[_INNER - 1:] == least)
        found = np.flatnonzero(at_edge)
        text = np.searchsorted(ends, found, "right")
        found = found[found + K <= ends[text]]
        whole = mix64(inner[found] * _A + mix64(inner[found + S] + _B) + inner[found + K - S] * _B)
        hashes = (whole >> np.uint64(32)).astype(np.uint32)
    cuts = np.searchsorted(found, np.concatenate([[0], ends]))
    out = []
    for i, text in enumerate(texts):
        a, b = cuts[i], cuts[i + 1]
        if b > a:
            out.append((found[a:b] - (ends[i] - lengths[i]), hashes[a:b]))
        elif text:
            digest = hashlib.blake2b(text.encode(), digest_size=4).digest()
            out.append((np.zeros(1, np.int64), np.frombuffer(digest, dtype=">u4").astype(np.uint32)))
        else:
            out.append((np.empty(0, np.int64), np.empty(0, np.uint32)))
    return out


def sketch(places: np.ndarray, hashes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Level, hashes and places of the anchors kept: each hash once, at its first place."""
    kinds, first = np.unique(hashes, return_index=True)
    level = 0
    if len(kinds) > KEEP:
        level = min(SPARSEST, 33 - int(kinds[KEEP]).bit_length())
        first = first[: np.searchsorted(kinds, 1 << (32 - level))]
    first = np.sort(first)
    return level, hashes[first], places[first]


def as_text(level: int, hashes: np.ndarray, places: np.ndarray) -> str:
    """Two hex digits for the level, then eight for each hash and eight for each place."""
    pairs = np.empty((len(hashes), 2), dtype=">u4")
    pairs[:, 0], pairs[:, 1] = hashes, places
    return f"{level:02x}" + pairs.tobytes().hex()


def likeness(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> float:
    """Shared anchors in common order over all anchors of both, at the stricter level; 0 to 1."""
    if not len(a[1]) and not len(b[1]):
        return 1.0
    limit = 1 << (32 - max(a[0], b[0]))
    left = [h for h in a[1].tolist() if h < limit]
    right = [h for h in b[1].tolist() if h < limit]
    place = {h: i for i, h in enumerate(left)}
    chain: list[int] = []
    for h in right:
        if (i := place.get(h)) is not None:
            at = bisect_left(chain, i)
            chain[at:at + 1] = [i]
    both = len(left) + len(right) - len(chain)
    return len(chain) / both if both else 0.0


def edit_halfway(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each is held back until the one after it is known."""
    held: tuple | None = None
    for batch in small_batches(batches, "text", 1 << 20):
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("_slice", "doc_id", "text", "_ahead"))))
        rows = [held, *rows] if held else rows
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[3]]
        held = rows[-1]
        if not pairs:
            continue
        edited = [edit_halfway(a[2], b[2]) for a, b in pairs]
        texts = [a[2] for a, _ in pairs] + edited + [pairs[-1][1][2]]
        prints = [sketch(*x) for x in anchors(texts)]
        n = len(pairs)
        # Neighbouring pairs share a text, except across slices.
        following = [prints[i + 1] if i + 1 < n and pairs[i + 1][0] is pairs[i][1] else None for i in range(n)]
        following[-1] = prints[-1]
        loose = [i for i in range(n) if following[i] is None]
        for i, x in zip(loose, anchors([pairs[i][1][2] for i in loose])):
            following[i] = sketch(*x)
        yield pa.RecordBatch.from_arrays([
            pa.array([a[1] for a, _ in pairs], pa.int64()),
            pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([as_text(*p) for p in prints[:n]]),
            pa.array([as_text(*p) for p in prints[n:2 * n]]),
            pa.array([likeness(a, b) for a, b in zip(prints[:n], prints[n:2 * n])], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(prints[:n], following)], pa.float64()),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def with_neighbours(docs: DataFrame, bounds: list[int], first: int | None) -> DataFrame:
    """Rows by slice, each slice in order and followed by the first rows of the next one.

    The first row of all also follows the last slice.  One shuffle moves the texts.
    """
    key, last = F.col("doc_id"), len(bounds)
    marks = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    own = F.size(F.filter(marks, lambda b: b <= key)) if bounds else F.lit(0)
    is_first = key.isNull() if first is None else key == first
    opens = F.array_contains(marks, key) if bounds else F.lit(False)
    own = F.when(key.isNull(), 0).otherwise(own).cast("int")

    def to(number, ahead, wrap):
        return F.struct(number.cast("int").alias("_slice"), F.lit(ahead).alias("_ahead"), F.lit(wrap).alias("_wrap"))

    targets = F.array(
        to(own, False, False),
        F.when(opens, to(own - 1, True, False)),
        F.when(is_first, to(F.lit(last), True, True)),
    )
    return (
        docs.select("doc_id", "text", F.explode(F.filter(targets, lambda t: t.isNotNull())).alias("_to"))
        .select("doc_id", "text", "_to.*")
        .repartitionById(last + 1, F.col("_slice"))
        .sortWithinPartitions("_slice", "_wrap", F.col("doc_id").asc_nulls_first(), "text", "_ahead")
    )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          rows_per_slice: int = 4096) -> DataFrame:
    """Fingerprint of each text, of the text edited halfway, and how near they are.

    The edited text takes its last half from the next document in order; the last
    document's next is the first.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    bounds = order_bounds(docs, "doc_id", rows_per_slice)
    ends = docs.select(F.min("doc_id"), F.bool_or(F.col("doc_id").isNull())).first()
    first = None if ends[1] else ends[0]
    return with_neighbours(docs, bounds, first).mapInArrow(_compare, _OUT)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 1 << 20):
        found = anchors(batch.column("text").to_pylist())
        sizes = [len(p) for p, _ in found]
        ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays([
            ids,
            pa.array(np.concatenate([p for p, _ in found]), pa.int64()),
            pa.array(np.concatenate([h for _, h in found]).astype(np.int64)),
        ], names=["doc_id", "place", "anchor"])


def anchor_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All anchors of all texts: doc_id, place (code points before it), anchor (hash).

    Equal anchors of two texts mark places where a common passage lines up.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return docs.mapInArrow(_anchor_rows, "doc_id bigint, place bigint, anchor bigint")
