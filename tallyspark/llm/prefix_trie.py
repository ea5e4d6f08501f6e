"""Trie of conversation prefixes, from sorted conversations and their common-prefix lengths.

A prefix is named by the exclusive or of its turns' hashes, each mixed with its depth: two
words of 64 bits.  Equal conversations are merged into one with a count.  The distinct ones
are cut into bands of ``BAND`` turns, so no row grows with a conversation, and sorted by
band and names.  Neighbours share a number of leading names; over these lengths a sparse
table of minima is built for each block of sorted rows, and every candidate prefix searches
its left and its right extent on its own, by halving steps.  The extent gives its members:
their count by running sums, the smallest by a second sparse table.

A block sees only its own rows.  Prefixes whose extent touches a block's edge, or a band's,
are few; their pieces are added up by name afterwards.  Sums over subtrees follow from
running sums along the distinct conversations, which are split over slices as well.

* A null role or text is empty; turns of equal rank are in order of role, then text.
* Rows without conv_id belong to no conversation and are left out.
* Repeated rows are turns like any other.  A text of any length is hashed where it is read;
  after that only hashes and lengths move.
* One conversation, or copies of one, may hold any share of the rows.  The ids of equal
  conversations are joined in pieces of up to 4096, and one task hashes the pieces in order:
  the digest is defined as a chain.  It holds one piece at a time.
* An empty table has no conversation and so no node.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import text_of
from tallyspark.session import discarding, stage

#: Turns of a band, and rows of a block.
BAND, BLOCK_ROWS = 64, 8192
#: Ids that are joined to one piece: two to the power of this.
_PIECE_BITS = 12
_NAME = ("depth", "ha", "hb")


def in_slices(df: DataFrame, *order: Column | str, keep: list[Column | str], within: list[Column | str] | None = None) -> DataFrame:
    """``keep`` of the rows in ``order``, dealt by range and written, with the slice and place of each row."""
    return stage(
        df.repartitionByRange(*order).sortWithinPartitions(*(within or order))
        .select(*keep, F.spark_partition_id().alias("_slice"), F.monotonically_increasing_id().alias("_row")),
        "slices",
    )


def running(placed: DataFrame, group: str, values: dict[str, tuple]) -> DataFrame:
    """Adds running values along each group; ``values`` has (aggregate, how two of them combine, column).

    Every slice runs on its own and starts from what the group's earlier slices come to.
    """
    piece = Window.partitionBy(group, "_slice").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(group, "_slice").agg(*[f(c).alias(f"_of_{n}") for n, (f, _, c) in values.items()])
    before = totals.select(
        F.col(group).alias("_of_group"), F.col("_slice").alias("_of_slice"),
        *[F.coalesce(f(f"_of_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n, (f, _, _) in values.items()],
    )
    own = placed.select(*placed.columns, *[f(c).over(piece).alias(f"_own_{n}") for n, (f, _, c) in values.items()])
    return own.join(before, (F.col(group) == F.col("_of_group")) & (F.col("_slice") == F.col("_of_slice"))).select(
        *[c for c in placed.columns if c not in ("_slice", "_row")],
        *[both(F.col(f"_own_{n}"), F.col(f"_before_{n}")).alias(n) for n, (_, both, _) in values.items()],
    )


def _add(a: Column, b: Column) -> Column:
    return a + b


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), two hashes and the UTF-8 bytes of every turn."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", text_of("role").alias("role"), text_of("text").alias("text"),
    ).filter("conv_id is not null")
    placed = in_slices(
        rows, "conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 16), F.substring("text", 1, 16),
        within=["conv_id", F.col("turn").asc_nulls_first(), "role", "text"],
        keep=["conv_id", F.xxhash64(F.lit(1), "role", "text").alias("ta"), F.xxhash64(F.lit(2), "role", "text").alias("tb"),
              F.octet_length("text").cast("bigint").alias("bytes")],
    )
    return running(placed, "conv_id", {"place": (F.sum, _add, F.lit(1))})


def with_shared_heads(turns: DataFrame, share: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their ``share``: (turns by depth, ids).

    Conversation c takes the first h turns of c - c % share, h = crc32(c) % most, and goes on
    with its own turns after its first h.
    """
    # At most eight turns of each conversation are heads; every other row moves once.
    head = F.crc32(F.col("conv_id").cast("string")) % most
    ids = stage(turns.groupBy("conv_id").agg(F.max("place").alias("n")), "ids")
    sizes = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    begun = (
        ids.select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % share).alias("base"))
        .join(sizes, "base", "left")
        .select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    )
    begun = stage(begun, "begun")
    heads = turns.filter(F.col("place") < most).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "ta", "tb", "bytes")
    grafted = begun.join(heads, "base").filter("depth <= h").select("conv_id", "depth", "ta", "tb", "bytes")
    own = turns.filter(F.col("place") > head).join(begun, "conv_id").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "ta", "tb", "bytes")
    return grafted.unionByName(own), ids.select("conv_id")


def _minima(values: np.ndarray) -> np.ndarray:
    """Sparse table: row k holds the minimum of each run of 2**k values, by its start."""
    n = len(values)
    table = np.full((max(1, n.bit_length()), n), np.iinfo(np.int64).min, dtype=np.int64)
    table[0] = values
    for k in range(1, len(table)):
        half, last = 1 << (k - 1), n - (1 << k) + 1
        table[k, :last] = np.minimum(table[k - 1, :last], table[k - 1, half:half + last])
    return table


def left_extents(table: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """First row of the run that ends at ``at`` and in which neighbours share ``least`` names or more."""
    found = at.copy()
    for k in reversed(range(len(table))):
        start = found - (1 << k) + 1
        found = np.where((start >= 1) & (table[k][np.maximum(start, 0)] >= least), start - 1, found)
    return found


def right_extents(table: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Last row of the run that starts at ``at`` and in which neighbours share ``least`` names or more."""
    found, last = at.copy(), table.shape[1] - 1
    for k in reversed(range(len(table))):
        fits = found + (1 << k) <= last
        found = np.where(fits & (table[k][np.minimum(found + 1, last)] >= least), found + (1 << k), found)
    return found


def shared_names(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Leading names that each row shares with the row before it; 0 for the first."""
    width = a.shape[1]
    both = np.minimum(sizes[1:], sizes[:-1])[:, None] > np.arange(width)
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & both & (bands[1:] == bands[:-1])[:, None]
    return np.concatenate([[0], np.where(same.all(axis=1), width, same.argmin(axis=1))]).astype(np.int64)


def block_pieces(bands, convs, weights, sizes, names, lengths, band: int) -> dict[str, np.ndarray]:
    """Prefixes of one block of sorted rows, with what the block knows of each."""
    n, width = len(bands), int(sizes.max())
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    a, b, size_of = (np.zeros((n, width), dtype=np.int64) for _ in range(3))
    a[row, place], b[row, place], size_of[row, place] = names[0::2], names[1::2], lengths
    common = shared_names(a, b, sizes, bands)
    table, smallest = _minima(common), _minima(convs)

    # A prefix is a candidate at the first row of the block that has it.
    new = sizes - common
    first = np.cumsum(new) - new
    p = np.repeat(np.arange(n), new)
    i = np.arange(len(p)) - np.repeat(first, new) + common[p]
    left, right = left_extents(table, p, i + 1), right_extents(table, p, i + 1)
    k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    conv = np.minimum(smallest[k, left], smallest[k, right - (1 << k) + 1])
    members = np.concatenate([[0], np.cumsum(weights)])
    count = members[right + 1] - members[left]
    at_edge = (left == 0) | (right == n - 1)

    inner = i >= 1
    above = left_extents(table, p, i)
    parent = np.where(inner, first[above] + i - 1 - common[above], 0)
    children = np.bincount(parent[inner & ~at_edge], minlength=len(p))
    opens_band = (i == 0) & (bands[p] > 0)
    return {
        "depth": bands[p] * band + i, "ha": a[p, i], "hb": b[p, i], "conv_id": conv,
        # The band before counts the members of the prefix that opens a band.
        "n_convs": np.where(opens_band, 0, count), "n_children": children, "bytes": size_of[p, i],
        "pa": a[p, np.maximum(i - 1, 0)], "pb": b[p, np.maximum(i - 1, 0)], "has_parent": inner,
        "parent_conv": conv[parent], "parent_known": inner & ~at_edge[parent],
        "counted": inner & ~at_edge, "apart": at_edge | opens_band | (i == band),
    }


_PIECE = ("depth bigint, ha bigint, hb bigint, conv_id bigint, n_convs bigint, n_children bigint, bytes bigint, "
          "pa bigint, pb bigint, parent_conv bigint, counted boolean, apart boolean")


def _pieces(band: int, block_rows: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                bands, convs, weights = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "conv_id", "weight"))
                names, lengths = part.column("names"), part.column("lengths")
                sizes = np.diff(lengths.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
                found = block_pieces(bands, convs, weights, sizes, names.flatten().to_numpy(zero_copy_only=False),
                                     lengths.flatten().to_numpy(zero_copy_only=False), band)
                hidden = {"pa": ~found["has_parent"], "pb": ~found["has_parent"], "parent_conv": ~found["parent_known"]}
                columns = [c.split(" ")[0] for c in _PIECE.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[c], pa.bool_() if c in ("counted", "apart") else pa.int64(), mask=hidden.get(c)) for c in columns],
                    names=columns,
                )

    return apply


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sha256 per name over its pieces in order, comma between them."""
    name, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*[pa.array([v], pa.int64()) for v in name], pa.array([digest.hexdigest()])], names=[*_NAME, "ends_sha256"])

    for batch in batches:
        for *key, piece in zip(*(batch.column(c).to_pylist() for c in (*_NAME, "piece"))):
            if key == name:
                digest.update(b",")
            else:
                if name is not None:
                    yield done()
                name, digest = key, hashlib.sha256()
            digest.update(piece.encode())
    if name is not None:
        yield done()


def _digests(ends: DataFrame, classes: DataFrame) -> DataFrame:
    """sha256 of the ids of equal conversations, ascending, by name of the whole conversation."""
    single = classes.filter("weight = 1").select(*_NAME, F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    several = classes.filter("weight > 1").select(*_NAME)
    members = in_slices(ends.join(several, list(_NAME), "left_semi"), *_NAME, "conv_id", keep=[*_NAME, "conv_id"])
    pieces = (
        members.groupBy(*_NAME, F.shiftright("_row", _PIECE_BITS).alias("_piece"))
        .agg(F.min("conv_id").alias("least"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))
        .select(*_NAME, "least", "piece")
    )
    joined = pieces.repartition(*_NAME).sortWithinPartitions(*_NAME, "least").mapInArrow(
        _chained, "depth bigint, ha bigint, hb bigint, ends_sha256 string")
    return single.unionByName(joined)


def prefix_trie(turns: DataFrame, ids: DataFrame, band: int = BAND, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty prefix included.

    ``turns`` has conv_id, depth (1 to the conversation's length), ta and tb (hashes of the
    turn), bytes; ``ids`` has every conv_id once, also of conversations without turns.
    Returned: conv_id (smallest member), depth, parent_conv_id (of the prefix one turn
    shorter), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = turns.sparkSession
    with discarding(spark):
        named = stage(turns.select(
            "conv_id", "depth", F.xxhash64("depth", "ta").alias("za"), F.xxhash64("depth", "tb").alias("zb"), "bytes"), "named")
        whole = named.groupBy("conv_id").agg(F.count("*").alias("depth"), F.bit_xor("za").alias("ha"), F.bit_xor("zb").alias("hb"))
        ends = stage(ids.join(whole, "conv_id", "left").na.fill(0, list(_NAME)), "ends")
        classes = stage(ends.groupBy(*_NAME).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")), "classes")

        chosen = classes.select("conv_id", "weight")
        placed = in_slices(named.join(chosen, "conv_id"), "conv_id", "depth", keep=["conv_id", "weight", "depth", "za", "zb", "bytes"])
        paths = running(placed, "conv_id", {"ha": (F.bit_xor, _xor, F.col("za")), "hb": (F.bit_xor, _xor, F.col("zb"))})
        zero = F.lit(0).cast("bigint")
        roots = chosen.select("conv_id", "weight", *[zero.alias(c) for c in ("depth", "bytes", "ha", "hb")])
        paths = stage(paths.drop("za", "zb").unionByName(roots), "paths")

        # The last turn of a full band also opens the next one.
        bands = F.array_distinct(F.array(F.greatest(zero, F.floor((F.col("depth") - 1) / band)), F.floor(F.col("depth") / band)))
        rows = (
            paths.select("conv_id", "weight", F.explode(bands).alias("band"), F.struct("depth", "ha", "hb", "bytes").alias("turn"))
            .groupBy("conv_id", "band").agg(F.max("weight").alias("weight"), F.sort_array(F.collect_list("turn")).alias("path"))
            .select("conv_id", "band", "weight", F.flatten(F.transform("path", lambda t: F.array(t["ha"], t["hb"]))).alias("names"),
                    F.transform("path", lambda t: t["bytes"]).alias("lengths"))
        )
        pieces = stage(
            rows.repartitionByRange("band", "names").sortWithinPartitions("band", "names").mapInArrow(_pieces(band, block_rows), _PIECE),
            "pieces",
        )
        nodes = stage(_merged(pieces), "nodes")
        sums = _subtree_sums(paths, nodes)
        digests = _digests(ends, classes)
        found = nodes.join(sums, list(_NAME)).join(digests, list(_NAME), "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
        return stage(found, "trie", keep=True)


def _merged(pieces: DataFrame) -> DataFrame:
    """Whole prefixes: those inside a block as they are, the others from their pieces."""
    pieces_apart = (
        pieces.filter("apart").groupBy(*_NAME)
        .agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
             F.max("bytes").alias("bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
             F.max("parent_conv").alias("parent_conv"), F.bool_or("counted").alias("counted"))
    )
    apart = stage(pieces_apart, "apart")
    # A prefix at an edge was not counted by its parent, which is at that edge as well.
    late = (
        apart.filter("not counted and pa is not null")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ha"), F.col("pb").alias("hb")).agg(F.count("*").alias("late"))
    )
    apart = stage(
        apart.join(late, list(_NAME), "left").withColumn("n_children", F.col("n_children") + F.coalesce("late", F.lit(0))).drop("late", "counted"),
        "apart",
    )
    parents = apart.select((F.col("depth") + 1).alias("depth"), F.col("ha").alias("pa"), F.col("hb").alias("pb"), F.col("conv_id").alias("_above"))
    every = pieces.filter("not apart").select(apart.columns).unionByName(apart)
    return every.join(parents, ["depth", "pa", "pb"], "left").select(
        *_NAME, "conv_id", F.coalesce("parent_conv", "_above").alias("parent_conv_id"), "n_convs", "n_children", "bytes")


def _subtree_sums(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaves and saved bytes below every prefix.

    A prefix lies on the path of its smallest member; what it has is put there, summed from
    the path's end upwards, and added up over the members of each prefix.
    """
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
                       F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"))
    rows = paths.join(own, ["conv_id", "depth"], "left").na.fill(0, ["saved", "leaf"])
    placed = in_slices(rows, "conv_id", F.col("depth").desc(), keep=["conv_id", *_NAME, "saved", "leaf"])
    below = running(placed, "conv_id", {"below_saved": (F.sum, _add, F.col("saved")), "below_leaves": (F.sum, _add, F.col("leaf"))})
    return below.groupBy(*_NAME).agg(F.sum("below_leaves").alias("n_leaves"), F.sum("below_saved").alias("saved_tokens"))
