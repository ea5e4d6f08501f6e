"""Near-duplicate documents by a forest of sorted MinHash signatures.

A document is the set of its shingles of ``size`` words.  Documents with equal sets form a
class and are compared once.  A signature has 128 minima; order t of 32 sorts the signatures
from value 4t on, and documents that agree in the first four values of an order share a
region.  Documents joined by regions form a candidate cluster.

* A cluster of at most ``MOST`` classes is compared within one task, each text moved once.
* In a larger cluster, only neighbours are compared: the documents are sorted in each order
  and taken in runs of ``MOST``, each with the end of the one before.  A run is as deep a
  region as its neighbours' common prefix makes it, so dense regions are cut deeper.  The
  first order goes ahead; the others take only regions that still hold several components.
  Runs only link early.  Every region that then still holds several components is decided
  whole: its documents are dealt into blocks, and every two blocks meet in one task.  Pairs
  within one component are known; blocks of the region's largest component do not meet.

In a cluster, run or pair of blocks, signatures screen pairs (five and a half standard deviations below the
limit), and the full sets decide.  Pairs already connected are not compared again, and only
a link to the smallest document of each component leaves the task.  Two documents at the
limit of 0.85 share no region with probability (1 - 0.85^4)^32, or 6e-11.

Null text is empty; a text without words is linked with nothing.  Rows that share a doc_id
count as one document; rows without one are copies if a document has the same set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.bloom import keep_possible
from tallyspark.llm.common import mix64, shingle_hashes, small_batches, text_of
from tallyspark.llm.components import components
from tallyspark.session import discarding, stage

SLOTS, ORDERS, DEPTH = 128, 32, 4
MOST, OVERLAP, MOST_BYTES = 1024, 32, 32 << 20
BLOCK, BLOCK_BYTES = 512, 16 << 20
_KEY_SLOTS = 16
_FACTORS = mix64(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 minima of a set of hashes, each under another multiplication."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 2048):
        part = np.multiply.outer(_FACTORS, shingles[start:start + 2048])
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            counts, sums, mixes, regions = [], [], [], []
            for shingles in shingle_hashes(batch.column("text"), size):
                counts.append(len(shingles))
                sums.append(int(shingles.sum(dtype=np.uint64)))
                mixes.append(int(mix64(shingles + np.uint64(1)).sum(dtype=np.uint64)))
                if len(shingles):
                    heads = signature(shingles).astype(np.uint64).reshape(ORDERS, DEPTH)
                    head = np.arange(ORDERS, dtype=np.uint64)
                    for i in range(DEPTH):
                        head = mix64(head * np.uint64(0x100000001B3) + heads[:, i])
                    regions.append(head.view(np.int64))
                else:
                    regions.append(None)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.array(np.array(sums, dtype=np.uint64).view(np.int64)),
                pa.array(np.array(mixes, dtype=np.uint64).view(np.int64)),
                pa.array(regions, pa.list_(pa.int64())),
            ], names=["doc_id", "n_shingles", "h1", "h2", "regions"])

    return run


def link_sets(ids: list[int], sets: list[np.ndarray], percent: int, known: list[int] | None = None,
              sides: list[bool] | None = None, turn: int | None = None) -> list[tuple[int, int]]:
    """(id, smallest id) for every set connected to another by links of the given likeness.

    Sets of the same ``known`` component are connected from the start; their links are not repeated.
    With ``sides``, only sets of different sides are compared.  With ``turn``, a pair is left to the
    first order whose region it shares.
    """
    j = percent / 100
    enough = SLOTS * j - 5.5 * (SLOTS * j * (1 - j)) ** 0.5
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    signs = np.array([signature(sets[i]) for i in order]).reshape(len(order), SLOTS)
    sizes = np.array([len(sets[i]) for i in order])
    labels = np.array([ids[i] if known is None else known[i] for i in order], dtype=np.int64)
    side = None if sides is None else np.array([sides[i] for i in order])
    root = np.unique(labels, return_index=True)[1][np.unique(labels, return_inverse=True)[1]]
    heads = np.flatnonzero(root == np.arange(len(order)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(order) - 1):
        small, large = np.minimum(sizes[i + 1:], sizes[i]), np.maximum(sizes[i + 1:], sizes[i])
        wanted = (labels[i + 1:] != labels[i]) & (100 * small >= percent * large)
        if side is not None:
            wanted &= side[i + 1:] != side[i]
        others = np.flatnonzero(wanted) + i + 1
        equal = signs[others] == signs[i]
        fits = equal.sum(axis=1) >= enough
        others, equal = others[fits], equal[fits]
        if turn is not None and len(others):
            others = others[equal.reshape(-1, ORDERS, DEPTH).all(axis=2).argmax(axis=1) == turn]
        for k in others:
            a, b = find(i), find(k)
            if a != b:
                shared = len(np.intersect1d(sets[order[i]], sets[order[k]], assume_unique=True))
                if 100 * shared >= percent * (sizes[i] + sizes[k] - shared):
                    root[max(a, b)] = min(a, b)
    return [(ids[order[i]], ids[order[r]]) for i in heads if (r := find(i)) != i]


_LINK = "a bigint, b bigint"


def _links(rows: list[tuple[int, str]], size: int, percent: int, **only) -> pa.RecordBatch:
    sets: list[np.ndarray] = []
    texts: list[str] = []
    for _, text in rows:
        texts.append(text)
        if sum(map(len, texts)) > 1 << 20 or len(texts) == 256:
            sets += shingle_hashes(pa.array(texts, pa.large_string()), size)
            texts = []
    sets += shingle_hashes(pa.array(texts, pa.large_string()), size)
    links = link_sets([i for i, _ in rows], sets, percent, **only)
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])


def _link_clusters(size: int, percent: int):
    """Rows come cluster by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in small_batches(batches, "text"):
            for cluster, node, text in zip(*(batch.column(c).to_pylist() for c in ("cluster", "node", "text"))):
                if cluster != current:
                    if len(rows) > 1:
                        yield _links(rows, size, percent)
                    current, rows = cluster, []
                rows.append((node, text))
        if len(rows) > 1:
            yield _links(rows, size, percent)

    return run


def _link_runs(size: int, percent: int):
    """Rows come in the order of their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        held = new = 0
        for batch in small_batches(batches, "text"):
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                rows.append((node, text))
                held += len(text)
                new += 1
                if len(rows) >= MOST or held >= MOST_BYTES:
                    yield _links(rows, size, percent)
                    rows = rows[-OVERLAP:] if len(rows) > 2 * OVERLAP else rows[-1:]
                    held, new = sum(len(t) for _, t in rows), 0
        if new and len(rows) > 1:
            yield _links(rows, size, percent)

    return run


def _link_blocks(size: int, percent: int):
    """Rows come by pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, known, sides = None, [], [], []

        def decided() -> pa.RecordBatch:
            turn, _, x, y = current
            return _links(rows, size, percent, known=known, sides=sides if x < y else None, turn=turn)

        for batch in small_batches(batches, "text"):
            columns = (batch.column(c).to_pylist() for c in ("turn", "region", "x", "y", "node", "component", "side", "text"))
            for turn, region, x, y, node, component, side, text in zip(*columns):
                if (turn, region, x, y) != current:
                    if len(rows) > 1:
                        yield decided()
                    current, rows, known, sides = (turn, region, x, y), [], [], []
                rows.append((node, text))
                known.append(component)
                sides.append(side)
        if len(rows) > 1:
            yield decided()

    return run


def _order_keys(size: int):
    """For each text and order, the sort key (sixteen values from the order's first on) and the text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            keys = []
            for shingles in shingle_hashes(batch.column("text"), size):
                signs = signature(shingles).astype(">u4")
                keys += [np.roll(signs, -DEPTH * t)[:_KEY_SLOTS].tobytes() for t in range(ORDERS)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column("node").take(pa.array(np.repeat(np.arange(n), ORDERS))),
                pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), n)),
                pa.array(keys, pa.binary()),
                pa.array(np.repeat(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64), ORDERS)),
            ], names=["node", "turn", "key", "bytes"])

    return run


def _link_large(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links within clusters too large for one task: node, text."""
    keys = stage(texts.mapInArrow(_order_keys(size), "node bigint, turn int, key binary, bytes bigint"), "orders")

    def sorted_links(rows: DataFrame) -> DataFrame:
        full = stage(rows.join(texts, "node"), "runs")
        ordered = full.repartitionByRange("turn", "key", "node").sortWithinPartitions("turn", "key", "node")
        return stage(ordered.select("node", "text").mapInArrow(_link_runs(size, percent), _LINK), "run-links")

    first = sorted_links(keys.filter("turn = 0").drop("bytes"))
    found = components(first).select("node", "component")
    labelled = keys.filter("turn > 0").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = stage(labelled.withColumn("region", F.substring("key", 1, 4 * DEPTH)), "labelled")
    open_regions = (
        labelled.groupBy("turn", "region").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low < high").select("turn", "region")
    )
    early = first.union(sorted_links(labelled.join(open_regions, ["turn", "region"], "left_semi").select("node", "turn", "key")))
    return early.union(_link_open(keys, texts, early, size, percent))


def _link_open(keys: DataFrame, texts: DataFrame, early: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the components of ``early`` that share a region, all pairs decided."""
    found = components(early).select("node", "component")
    rows = keys.select("node", "turn", F.substring("key", 1, 4 * DEPTH).alias("region"), "bytes").join(found, "node", "left")
    rows = stage(rows.withColumn("component", F.coalesce("component", "node")), "region-rows")
    parts = rows.groupBy("turn", "region", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    regions = (
        parts.groupBy("turn", "region")
        .agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("bytes").alias("all_bytes"),
             F.max(F.struct("n", "component", "bytes")).alias("top"))
        .filter("parts > 1")
    )
    whole = (F.col("n") <= BLOCK) & (F.col("all_bytes") <= BLOCK_BYTES)

    def blocks(n: Column, held: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(held / BLOCK_BYTES), F.lit(1))

    regions = stage(regions.select(
        "turn", "region", F.when(~whole, F.col("top.component")).alias("largest"),
        F.when(whole, 1).otherwise(blocks(F.col("n") - F.col("top.n"), F.col("all_bytes") - F.col("top.bytes"))).alias("rest"),
        F.when(whole, 0).otherwise(blocks(F.col("top.n"), F.col("top.bytes"))).alias("own"),
    ), "open-regions")
    inside = F.coalesce(F.col("component") == F.col("largest"), F.lit(False))
    number = F.xxhash64("node")
    dealt = rows.join(regions, ["turn", "region"]).select(
        "node", "component", "turn", "region",
        F.when(inside, F.col("rest") + F.pmod(number, F.col("own"))).otherwise(F.pmod(number, F.col("rest"))).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("own")) - 1)).alias("other"))
    dealt = dealt.select("node", "component", "turn", "region", F.least("block", "other").alias("x"),
                         F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).alias("side"))
    pair = ["turn", "region", "x", "y"]
    met = dealt.join(texts, "node").select(*pair, "node", "component", "side", "text")
    return stage(met.repartition(*pair).sortWithinPartitions(*pair, "node").mapInArrow(_link_blocks(size, percent), _LINK), "block-links")


def link_documents(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (whether it is its own).

    Two documents are linked if 100 * shared shingles >= percent * all shingles of both.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    with discarding(docs.sparkSession):
        return stage(_linked(docs, size, percent), "linked", keep=True)


def _linked(docs: DataFrame, size: int, percent: int) -> DataFrame:
    features = stage(
        docs.mapInArrow(_features(size), "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, regions array<bigint>"), "features")
    rows = features.select("doc_id", "n_shingles", "h1", "h2")
    classes = stage(
        features.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles")
        .agg(F.min("doc_id").alias("node"), F.first("regions").alias("regions")), "classes")
    members = classes.filter("node is not null").select("node", F.explode("regions").alias("region"))
    shared = members.groupBy("region").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    shared = stage(shared.select("region", "least"), "shared-regions")
    spokes = stage(keep_possible(members, "region", shared).join(shared, "region").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "spokes")
    clusters = stage(components(spokes).withColumnsRenamed({"component": "cluster"}), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("nodes"))
    wanted = clusters.join(sizes, "cluster").select("node", "cluster", (F.col("nodes") > MOST).alias("large"))
    wanted = stage(wanted, "wanted").withColumnRenamed("node", "doc_id")
    texts = stage(
        keep_possible(docs, "doc_id", wanted).join(wanted, "doc_id").select(F.col("doc_id").alias("node"), "cluster", "large", "text"),
        "texts")
    links = stage(
        texts.filter("not large").select("cluster", "node", "text").repartition("cluster").sortWithinPartitions("cluster", "node")
        .mapInArrow(_link_clusters(size, percent), _LINK), "cluster-links")
    large = texts.filter("large").select("node", "text")
    if not large.isEmpty():
        links = links.union(_link_large(large, size, percent))
    named = rows.join(classes.select("h1", "h2", "n_shingles", "node"), ["h1", "h2", "n_shingles"], "left")
    twice = (
        named.filter("doc_id is not null and node is not null").groupBy("doc_id")
        .agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("b", "a")
    )
    found = components(links.union(twice)).withColumnRenamed("node", "of_node")
    component = F.coalesce("component", "node", "doc_id")
    return (
        named.join(found, F.col("node") == F.col("of_node"), "left")
        .select("doc_id", "n_shingles", component.alias("component_id"),
                F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
    )
