"""Fill-in-the-middle texts against plain Python, and the rank index against all offsets."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from tallyspark.llm import fill_middle

LONG = "ab " * 400_000 + "x" * 1_500_000 + " é\n" * 300_000


def plain_version(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def made(spark, rows, schema="doc_id bigint, text string"):
    frame = fill_middle.with_restored(fill_middle.fill_in_middle(spark.createDataFrame(rows, schema)))
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    return [tuple(r[c] for c in names) for r in frame.collect()]


def test_awkward_texts(spark):
    texts = [
        None, "", " ", "a", "\n", "éßİ", "a<P>b", "<M>", "<S", "<P", ">", "P>a<", "a b  c\r\n\t\0d", "\U0001f600x\U0001f600",
        "<<P >M><S ", "Kſ k s", "word " * 3000, "x" * 5000,
    ]
    rows = [(i * 7 + k, t) for k in range(7) for i, t in enumerate(texts)]
    rows += [(None, "no id at all"), (5, "same row"), (5, "same row"), (-3, "below zero")]
    found = made(spark, rows)
    expected = [plain_version(*r) for r in rows]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_very_long_text(spark):
    assert made(spark, [(d, LONG) for d in (1, 2)]) == [plain_version(d, LONG) for d in (1, 2)]


def test_empty_table_and_clashing_columns(spark):
    assert made(spark, []) == []
    wide = "doc_id bigint, text string, output string, form int, n string, restored double"
    assert made(spark, [(4, "some text here", "x", 1, "y", 0.5)], wide) == [plain_version(4, "some text here")]


@pytest.mark.parametrize("seed", range(6))
def test_every_rank_is_exact(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [2, 12, 3000, 12, 40, 100000][seed], size=[5000, 20000, 300, 1, 9000, 40][seed])
    text = "".join("q" * int(k) + ". "[int(k) % 2] for k in lengths)
    index = fill_middle.RankIndex(text)
    offsets = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
    assert index.n == len(offsets) - 1
    assert [index.offset(r) for r in range(len(offsets))] == offsets


def test_segments_are_error_bounded_and_few():
    rng = np.random.default_rng(9)
    offsets = np.cumsum(rng.integers(1, 12, size=60_000))
    segments = fill_middle.fit_segments(offsets)
    ends = [rank for rank, _, _ in segments[1:]] + [len(offsets)]
    for (rank, base, slope), end in zip(segments, ends):
        assert np.abs(base + slope * np.arange(end - rank) - offsets[rank:end]).max() <= fill_middle.ERROR + 1e-6
    assert len(segments) < len(offsets) / 200
    # A segment could not have taken in the boundary after it with the same start.
    for (rank, base, _), end in zip(segments[:-1], ends):
        run = np.arange(1, end - rank + 1)
        rise = offsets[rank + 1:end + 1] - base
        assert ((rise - fill_middle.ERROR) / run).max() > ((rise + fill_middle.ERROR) / run).min()
