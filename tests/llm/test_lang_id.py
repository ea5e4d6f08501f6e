"""Language of texts: accuracy on texts held out, the network against plain loops, edge cases."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lang_id, queries

SF_DIR = "/root/testdata/sf0.01"
WORDS = {"en": "the and with there shall", "de": "der und nicht über schön", "fr": "le été qui vous ça"}


def text(lang: str, n: int, seed: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS[lang].split(), n))


SCHEMA = "doc_id bigint, text string, lang string, score string, lang_pred int, has_letter string, key int, stretches string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "h", 2, "t") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def learned():
    net = lang_id.ByteNet(sorted(WORDS))
    texts = [text(lang, 60, i).encode() for i in range(150) for lang in sorted(WORDS)]
    net.fit(texts, np.tile(np.arange(3), 150))
    return net


@pytest.mark.skipif(not os.path.exists(SF_DIR), reason="needs the tables of scale 0.01")
def test_held_out_accuracy(spark):
    rows = queries.op11_lang_id(spark, SF_DIR).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    right = []
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1
        if row["held_out"] and row["lang_pred"] != "und":
            right.append(row["lang_pred"] == docs[row["doc_id"]]["lang"])
    assert len(right) > 200 and np.mean(right) > 0.97


def test_answers_are_those_of_plain_loops(learned):
    w, found = learned.weights, []
    windows = np.zeros((3, lang_id.WINDOW), dtype=np.uint8)
    for i, t in enumerate(("the été und", "über", text("en", 90, 1))):
        data = t.encode()[:lang_id.WINDOW]
        windows[i, :len(data)] = np.frombuffer(data, dtype=np.uint8)
    for window in windows:
        largest = []
        for f in range(len(w["bias"])):
            width = lang_id.WIDTHS[f // lang_id.FILTERS]
            kernel = w["filters"][:width * lang_id.DIM, f].reshape(width, lang_id.DIM)
            answers = [sum(float(w["bytes"][window[at + k]] @ kernel[k]) for k in range(width)) for at in range(lang_id.STEP)]
            largest.append(max(0.0, max(answers) + float(w["bias"][f])))
        scores = np.array(largest) @ w["out"] + w["out_bias"]
        found.append(np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum())
    assert np.allclose(learned.predict(windows), found, atol=1e-4)


def test_gradients_are_those_of_small_steps(learned):
    net = lang_id.ByteNet(["a", "b"], seed=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(2)
    windows, labels = rng.integers(0, 256, (4, lang_id.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss() -> float:
        return -np.log(net.predict(windows)[np.arange(4), labels]).mean()

    slopes = net.gradients(windows, labels)
    for name, value in net.weights.items():
        for at in {tuple(rng.integers(0, s) for s in value.shape) for _ in range(12)}:
            if name == "filters" and not net.mask[at]:
                assert slopes[name][at] == 0
                continue
            before, losses = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = before + step
                losses.append(loss())
            value[at] = before
            assert np.isclose(slopes[name][at], (losses[0] - losses[1]) / 2e-5, atol=1e-5)


def test_windows_cover_every_run_of_bytes():
    sizes = np.array([0, 1, 251, 252, 253, 256, 1000, 0, 504])
    ends = np.cumsum(sizes)
    starts, owner = lang_id.window_starts(ends)
    for i, size in enumerate(sizes):
        begin = ends[i] - size
        seen = {(s, w) for s in starts[owner == i] - begin for w in [0]}
        for at in range(size):
            assert any(s <= at < s + lang_id.STEP for s, _ in seen)
        assert len(seen) == -(-size // lang_id.STEP)


def test_nulls_blanks_and_long_texts(spark, learned):
    long = text("fr", 200_000, 5)
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t123 ²³ !?", None), (4, "the and there", None), (None, "der und nicht", None),
            (5, long, None), (5, long, None), (6, "été", None), (7, "日本", None), (8, "1 " * 5000 + "vous le été qui", None)]
    found = {}
    for r in lang_id.predict(learned, table(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert [found[d] for d in (1, 2, 3)] == [[("und", 0.0)]] * 3
    assert found[4][0][0] == "en" and found[None][0][0] == "de" and found[8][0][0] == "fr"
    assert len(found[5]) == 2 and len(set(found[5])) == 1 and found[5][0][0] == "fr" and found[5][0][1] > 0.9
    assert found[7][0][0] in WORDS and sum(map(len, found.values())) == len(rows)


def test_a_text_is_judged_alike_in_any_batch(learned):
    texts = [text(lang, 30 * k, k) for k in range(1, 30) for lang in WORDS]
    together, windows = lang_id.text_probabilities(learned, pa.array(texts))
    alone = [lang_id.text_probabilities(learned, pa.array([t]))[0][0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5) and windows.sum() > len(texts)
    sliced, _ = lang_id.text_probabilities(learned, pa.array(["x", *texts]).slice(1))
    assert np.allclose(together, sliced, atol=1e-5)


def test_labels_that_are_held_out_are_not_learned(spark):
    """Wrong labels and wrong texts among the rows held out change nothing."""
    right = [(i, text(lang, 50, i), lang) for i, lang in enumerate(list(WORDS) * 40)]
    wrong = [(1000 + i, text("de", 50, i), "en") for i in range(60)] + [(2000 + i, text("en", 50, i), "xx") for i in range(60)]
    held = F.col("doc_id") >= 1000
    with_wrong = lang_id.identify_languages(table(spark, right + wrong), held_out=held).filter(~held)
    without = lang_id.identify_languages(table(spark, right), held_out=held)
    assert sorted(map(tuple, with_wrong.collect())) == sorted(map(tuple, without.collect()))
    assert "xx" not in {r["lang_pred"] for r in with_wrong.collect()}


def test_nothing_or_one_language_to_learn(spark):
    assert lang_id.identify_languages(table(spark, [])).collect() == []
    unlabelled = lang_id.identify_languages(table(spark, [(1, "some text", None), (2, "123", "en"), (3, None, "de")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in unlabelled] == [("und", 0.0)] * 3
    single = lang_id.identify_languages(table(spark, [(1, "some text", "en"), (2, "other", None), (3, "", None)])).collect()
    assert sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in single) == [(1, "en", 1.0), (2, "en", 1.0), (3, "und", 0.0)]


def test_the_sample_is_bounded_and_without_copies(spark):
    rows = [(i, text("en", 40, i % 300), "en") for i in range(3000)] + [(i, text("de", 40, i), "de") for i in range(200)]
    docs = table(spark, rows)
    sample = lang_id.training_rows(docs, F.col("lang"), F.lit(True), 100, 80).collect()
    by_lang = {lang: [r["key"] for r in sample if r["lang"] == lang] for lang in ("en", "de")}
    assert all(len(keys) == len(set(keys)) == 50 for keys in by_lang.values())
    assert all(len(r["stretches"]) == 2 for r in sample)
