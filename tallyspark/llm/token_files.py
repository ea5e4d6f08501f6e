"""Token files: ids ranked by frequency, in byte-aligned variable-length coding.

The most frequent id of the corpus has rank 0.  A rank takes one to four bytes; the lengths
of four ranks stand in one control byte, two bits each, and control bytes are kept apart
from data bytes.  Decoding looks each control byte up in a table of lengths.  Files are
Parquet folders, one per slice of the document order; a row is a block of whole documents
with its control and data bytes and the count of ids before it.  ``ranks`` holds the ranking.

Documents are ordered by doc_id (null first), then by ids.  Null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import order_bounds, slice_numbers, small_batches, text_of
from tallyspark.llm.tokens import encoder
from tallyspark.session import new_folder

IDS_PER_BLOCK = 1 << 16
#: Length of each of the four values that a control byte describes.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    values = values.astype("<u2" if width < 3 else "<u4")
    lengths = np.ones(len(values), dtype=np.uint8)
    for i in range(1, width):
        lengths += values >= 1 << (8 * i)
    columns = values.dtype.itemsize
    data = values.view(np.uint8).reshape(-1, columns)[np.arange(columns, dtype=np.uint8) < lengths[:, None]]
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again: lengths by table lookup, then one gather per byte of the longest."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    value = padded[starts].astype(np.uint32)
    width = int(lengths.max(initial=1))
    for i in range(1, width):
        value |= padded[starts + i].astype(np.uint32) << np.uint32(8 * i)
    return value & _MASKS[lengths] if width > 1 else value


def _binary(data: bytes | memoryview, sizes: np.ndarray) -> pa.Array:
    """Binary column of consecutive pieces of ``data`` with the given sizes in bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    large = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return large.cast(pa.binary())


def _values(column: pa.Array, kind: str) -> np.ndarray:
    """All values of a binary column without nulls, end to end."""
    large = column.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset:large.offset + len(large) + 1]
    return np.frombuffer(large.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]].view(kind)


def _tokenize(path: str, caseless: bool, end_id: int, bounds: list[int], kind: str):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            encoded = [e + end for e in encoder(path, caseless).encode(batch.column("text").to_pylist())]
            sizes = np.array([len(e) for e in encoded], dtype=np.int64) // 4
            ids = np.frombuffer(b"".join(encoded), dtype="<u4").astype(kind)
            yield pa.RecordBatch.from_arrays([
                pa.array(slice_numbers(batch.column("doc_id"), bounds)),
                batch.column("doc_id"),
                pa.array(sizes),
                _binary(ids.tobytes(), sizes * ids.itemsize),
            ], names=["slice", "doc_id", "n_tokens", "ids"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the count of ids before each document in its slice; rows come in order."""
    current, total = None, 0
    for batch in batches:
        slices = batch.column("slice").to_numpy()
        sizes = batch.column("n_tokens").to_numpy()
        before = np.cumsum(sizes) - sizes
        for number in np.unique(slices):
            own = slices == number
            if number != current:
                current, total = number, 0
            before[own] += total - before[own][0]
            total = int(before[own][-1] + sizes[own][-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=[*batch.schema.names, "before"])


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            counts = np.bincount(_values(batch.column("ids"), kind), minlength=len(seen))
            counts[: len(seen)] += seen
            seen = counts
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seen[ids])], names=["id", "n"])

    return run


_BLOCK = ("slice int, before bigint, n_ids bigint, doc_ids array<bigint>, n_tokens array<bigint>, "
          "control binary, data binary")


def _blocks(rank_of: np.ndarray, offsets: dict[int, int], kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_tokens").to_numpy()
            slices = batch.column("slice").to_numpy()
            before = batch.column("before").to_numpy()
            piece = np.cumsum(sizes) // IDS_PER_BLOCK
            cuts = np.flatnonzero((np.diff(piece) > 0) | (np.diff(slices) != 0) | (np.diff(before) != sizes[:-1])) + 1
            rows = []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                control, data = encode_values(rank_of[_values(part.column("ids"), kind)])
                number = int(slices[a])
                rows.append((number, offsets[number] + int(before[a]), int(sizes[a:b].sum()),
                             part.column("doc_id").to_pylist(), sizes[a:b].tolist(), control, data))
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["slice", "before", "n_ids", "doc_ids", "n_tokens", "control", "data"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, caseless: bool = False, end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text", rows_per_slice: int = 4096) -> None:
    """Tokenizes every text once and writes ``path``/blocks and ``path``/ranks.

    The driver gets one total per slice and one count per id of the vocabulary.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    bounds = order_bounds(docs, "doc_id", rows_per_slice)
    largest = max(encoder(tokenizer_path, caseless).largest_id, end_id)
    kind = "<u2" if largest < 1 << 16 else "<u4"
    row = "slice int, doc_id bigint, n_tokens bigint, ids binary"
    ordered = (
        docs.mapInArrow(_tokenize(tokenizer_path, caseless, end_id, bounds, kind), row)
        .repartitionById(len(bounds) + 1, F.col("slice"))
        .sortWithinPartitions("slice", F.col("doc_id").asc_nulls_first(), "ids")
        .mapInArrow(_running, f"{row}, before bigint")
    )
    ordered.write.option("compression", "zstd").parquet(f"{path}/unranked")
    tokens = spark.read.parquet(f"{path}/unranked")
    counts = tokens.select("ids").mapInArrow(_count(kind), "id bigint, n bigint")
    ranked = counts.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    rank_of = np.zeros(max((r["id"] for r in ranked), default=0) + 1, dtype=np.uint32)
    for rank, r in enumerate(ranked):
        rank_of[r["id"]] = rank
    totals = {r["slice"]: r["n"] for r in tokens.groupBy("slice").agg(F.sum("n_tokens").alias("n")).collect()}
    offsets, total = {}, 0
    for number in sorted(totals):
        offsets[number] = total
        total += totals[number]
    table = [(rank, r["id"], r["n"]) for rank, r in enumerate(ranked)]
    spark.createDataFrame(table, "rank bigint, id bigint, n bigint").coalesce(1).write.parquet(f"{path}/ranks")
    (
        tokens.mapInArrow(_blocks(rank_of, offsets, kind), _BLOCK)
        .sortWithinPartitions("slice", "before")
        .write.partitionBy("slice").option("compression", "none").parquet(f"{path}/blocks")
    )


def _unpack(id_of: np.ndarray, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                before, n, docs, sizes, control, data = (
                    batch.column(c)[row].as_py() for c in ("before", "n_ids", "doc_ids", "n_tokens", "control", "data"))
                ids = id_of[decode_values(control, data, n)].tobytes()
                sizes = np.array(sizes, dtype=np.int64)
                ends = np.cumsum(sizes)
                if digest:
                    view = memoryview(ids)
                    last = pa.array([crc32(view[4 * (e - s):4 * e]) for e, s in zip(ends.tolist(), sizes.tolist())], pa.int64())
                else:
                    last = _binary(ids, 4 * sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(before + ends - sizes), pa.array(sizes), last],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit).

    With ``digest``, ids_crc32 of the ids stands in their place.
    """
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()
    id_of = np.array([r["id"] for r in ranks], dtype="<u4")
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    last = "ids_crc32 bigint" if digest else "ids binary"
    return blocks.mapInArrow(_unpack(id_of, digest), f"doc_id bigint, start bigint, n_tokens bigint, {last}")


def token_files(docs: DataFrame, tokenizer_path: str, digest: bool = False, **options) -> DataFrame:
    """Writes token files below the shared folder and reads them back."""
    path = new_folder(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, **options)
    return read_token_files(docs.sparkSession, path, digest)
