"""Sum-of-squares online packing of documents into token sequences.

Each task packs its own documents as they come.  A level array counts the partly filled
sequences at every fill level; a document's rest goes to the level that makes the sum of the
squared counts smallest (ties: the fullest).  Whole windows of long documents are sequences
of their own.  What is still open at the end of a task, or whenever ``MOST_OPEN`` sequences
are open, is closed: its pieces are laid end to end and cut into full sequences, and the last
rest into powers of two.  So no sequence needs padding, memory is bounded, no row moves
between tasks, and a task that runs again gives the same rows.

Null text is empty; every document has at least its end id.  Repeated rows are packed each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import small_batches, text_of
from tallyspark.llm.tokens import encoder

MOST_OPEN = 8192
_FAR = np.int64(1) << 60

#: document number in the batch stream, first id, ids
Piece = tuple[object, int, bytes, int]


class LevelPacker:
    """Places pieces of fewer than ``window`` ids; hands closed sequences to ``emit``."""

    def __init__(self, window: int, emit: Callable[[list[Piece]], None], most_open: int = MOST_OPEN):
        self.window, self.emit, self.most_open = window, emit, most_open
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def place(self, piece: Piece) -> None:
        size = len(piece[2]) // 4
        here = self.levels[: self.window - size + 1]
        cost = 2 * (self.levels[size:] - here) + 2
        cost[-1] = 1 - 2 * here[-1]
        cost[here == 0] = _FAR
        cost[0] = 2 * self.levels[size] + 1
        level = self.window - size - int(np.argmin(cost[::-1]))
        pieces: list[Piece] = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if level + size == self.window:
            self.emit(pieces)
            return
        self.open.setdefault(level + size, []).append(pieces)
        self.levels[level + size] += 1
        self.n_open += 1
        if self.n_open >= self.most_open:
            self.close()

    def close(self) -> None:
        rest = [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        left = sum(len(p[2]) for p in rest) // 4
        sizes = [self.window] * (left // self.window)
        left %= self.window
        sizes += [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
        queue = iter(rest)
        current: Piece | None = None
        for size in sizes:
            sequence: list[Piece] = []
            while size:
                current = current or next(queue)
                doc, start, ids, total = current
                taken = min(size, len(ids) // 4)
                sequence.append((doc, start, ids[: 4 * taken], total))
                size -= taken
                current = (doc, start + taken, ids[4 * taken:], total) if 4 * taken < len(ids) else None
            self.emit(sequence)
        self.open.clear()
        self.levels[:] = 0
        self.n_open = 0


_OUT = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def _packer(path: str, caseless: bool, end_id: int, window: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0
        rows: list[tuple] = []

        def emit(pieces: list[Piece]) -> None:
            nonlocal made
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, total, base + made, offset, ids))
                offset += len(ids) // 4
            made += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        packer = LevelPacker(window, emit)
        for batch in small_batches(batches, "text", 4 << 20):
            encoded = encoder(path, caseless).encode(batch.column("text").to_pylist())
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded):
                ids += end
                total = len(ids) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    emit([(doc, start, ids[4 * start: 4 * (start + window)], total)])
                if whole < total:
                    packer.place((doc, whole, ids[4 * whole:], total))
            if rows:
                yield batch_of()
        packer.close()
        if rows:
            yield batch_of()

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, *, caseless: bool = False, end_id: int = 0,
                   window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document and place there, its sequence and place there, its ids.

    ``ids`` holds little-endian unsigned 32-bit ids.  Sequence numbers are unique, not dense.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return docs.mapInArrow(_packer(tokenizer_path, caseless, end_id, window), _OUT)
