"""The trie of conversation prefixes against a dictionary of all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import prefix_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def ordered(rows) -> dict[int, list[tuple[str, str]]]:
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in talks.items()}


def with_shared_heads(talks) -> dict[int, list[tuple[str, str]]]:
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in talks}
    return {c: talks.get(c - c % 5, [])[:heads[c]] + turns[heads[c]:] for c, turns in talks.items()}


def plain_trie(talks) -> list[tuple]:
    members, children = defaultdict(list), defaultdict(set)
    for conv, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = own + sum(saved[c] for c in children[node])
    return [
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(talks[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()
    ]


def found(frame) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


def trie(spark, rows, heads=True, **options):
    schema = "conv_id bigint, turn bigint, role string, text string"
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, schema).repartition(3))
    if heads:
        turns, ids = prefix_trie.with_shared_heads(turns)
    else:
        ids = turns.select("conv_id").distinct()
        turns = turns.withColumnRenamed("place", "depth")
    return found(prefix_trie.prefix_trie(turns, ids, **options))


def expected(rows, heads=True) -> list[tuple]:
    talks = ordered(rows)
    return sorted(plain_trie(with_shared_heads(talks) if heads else talks), key=repr)


def talk(conv: int, texts) -> list[tuple]:
    return [(conv, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]


def random_rows(seed: int, convs: int, most: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        rows += talk(conv, ["".join(rng.choices("ab", k=rng.randrange(2))) + "é" * (rng.random() < 0.2) for _ in range(rng.randrange(1, most))])
    return rows


@pytest.mark.parametrize(("band", "block_rows"), [(64, 8192), (3, 4), (1, 1), (2, 7)])
def test_random_conversations(spark, band, block_rows):
    rows = random_rows(band, 60, 10)
    assert trie(spark, rows, band=band, block_rows=block_rows) == expected(rows)


def test_nulls_ties_repeats_and_ids_out_of_order(spark):
    rows = [
        (3, 0, "user", "a"), (3, 0, "user", "a"), (3, None, "system", None), (3, None, None, "x"), (3, 1, "b", "z" * 100_000),
        (20, 2, None, None), (20, 1, "user", "a"), (20, 1, "assistant", "a"), (7, None, None, None), (105, 0, "user", ""),
        (None, 0, "user", "nobody's"), (None, None, None, None), (11, 0, "us", "era"), (12, 0, "use", "ra"), (13, 5, "use", "ra"),
    ]
    for heads in (True, False):
        assert trie(spark, rows, heads=heads) == expected(rows, heads)


def test_long_conversation_and_many_copies(spark):
    """Longer than several bands, shared up to the middle of one, beside copies of one conversation."""
    long = [str(k % 7) for k in range(300)]
    rows = talk(900, long) + talk(901, long[:200] + ["other"] + long[201:]) + talk(902, long[:128]) + talk(903, long[:64] + ["end"])
    for conv in range(400):
        rows += talk(conv, ["hello", "hi"])
    assert trie(spark, rows, heads=False) == expected(rows, heads=False)
    assert trie(spark, rows, heads=False, band=16, block_rows=2) == expected(rows, heads=False)


def test_ids_are_joined_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_PIECE_BITS", 2)
    rows = [r for conv in range(90) for r in talk(conv, ["same"])]
    assert trie(spark, rows, heads=False) == expected(rows, heads=False)


def test_conversations_without_turns(spark):
    """Without the first of its five, a conversation can lose all its turns and still counts."""
    rows = [r for conv in range(1, 40) if conv % 5 for r in talk(conv, ["a", "b"])]
    assert any(not t for t in with_shared_heads(ordered(rows)).values())
    assert trie(spark, rows) == expected(rows)


def test_empty_table_and_other_columns(spark):
    assert trie(spark, []) == []
    rows = talk(1, ["a", "b"]) + talk(2, ["a", "c"])
    wide = spark.createDataFrame([(*r, 5, "x", 1, "y", 2) for r in rows],
                                 "conv_id bigint, turn bigint, role string, text string, depth int, ha string, _slice int, names string, place int")
    turns, ids = prefix_trie.with_shared_heads(prefix_trie.numbered_turns(wide))
    assert found(prefix_trie.prefix_trie(turns, ids)) == expected(rows)


def test_extents_are_those_of_a_scan():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64, 100):
        common = rng.integers(0, 5, n)
        common[0] = 0
        table = prefix_trie._minima(common)
        for least in range(1, 6):
            for at in range(n):
                left = right = at
                while left > 0 and common[left] >= least:
                    left -= 1
                while right + 1 < n and common[right + 1] >= least:
                    right += 1
                here = np.array([at])
                assert prefix_trie.left_extents(table, here, np.array([least]))[0] == left
                assert prefix_trie.right_extents(table, here, np.array([least]))[0] == right


def test_no_task_gathers_the_turns_of_one_conversation(spark):
    """Running values of one long group are spread over slices."""
    rows = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = prefix_trie.in_slices(rows, "g", "v", keep=["g", "v"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert placed.select("_slice").distinct().count() > 1
    sums = prefix_trie.running(placed, "g", {"total": (F.sum, prefix_trie._add, F.col("v"))})
    assert [r["total"] for r in sums.orderBy("v").collect()] == list(np.cumsum(np.arange(20_000)))
