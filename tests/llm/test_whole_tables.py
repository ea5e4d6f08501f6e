"""Registered queries over the smallest tables, against SQL or plain code."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from tallyspark.llm import mixing, near_dup, packing, reference_sql
from tallyspark.llm.queries import DOMAIN_WEIGHTS, LANG_WEIGHTS, QUERIES, domain_of
from tallyspark.llm.tokens import default_path
from tests.compare import connect, difference
from tests.llm import plain

WITH_SQL = sorted(name for name, (_, sql) in QUERIES.items() if sql)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, sf_dir, con, name):
    run, sql = QUERIES[name]
    mine = run(spark, sf_dir).toPandas()
    assert difference(mine, con.execute(sql).df()) is None
    assert len(mine) > 0


def library_ids(name: str, texts: list[str], end: int) -> list[list[int]]:
    from tokenizers import Tokenizer

    encoded = Tokenizer.from_file(default_path(name)).encode_batch(texts, add_special_tokens=False)
    return [e.ids + [end] for e in encoded]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def check_pieces(rows, ids_of: dict, window: int) -> None:
    for doc, pieces in plain.by_key(rows, "doc_id").items():
        at = 0
        for piece in sorted(pieces, key=lambda p: p["start"]):
            assert piece["start"] == at and piece["doc_tokens"] == len(ids_of[doc])
            at += piece["length"]
            assert piece["ids_crc32"] == crc(ids_of[doc][piece["start"]:at])
        assert at == len(ids_of[doc])
    for pieces in plain.by_key(rows, "sequence_id").values():
        at = 0
        for piece in sorted(pieces, key=lambda p: p["offset"]):
            assert piece["offset"] == at
            at += piece["length"]
        assert at == window or at & (at - 1) == 0


def test_packing(spark, sf_dir, docs):
    rows = QUERIES["op5_packing"][0](spark, sf_dir).collect()
    ids = library_ids("byte_bpe_50k.json", [t for _, t in docs], 0)
    assert {r["doc_id"] for r in rows} == {d for d, _ in docs}
    check_pieces(rows, {d: i for (d, _), i in zip(docs, ids)}, 1024)


def test_token_files(spark, sf_dir, docs):
    rows = sorted(QUERIES["op6_token_files"][0](spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    at = 0
    for row, (doc, _), ids in zip(rows, docs, library_ids("word_bpe_49k.json", [t for _, t in docs], 2), strict=True):
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc, at, len(ids), crc(ids))
        at += len(ids)


def test_mixing_takes_token_prefixes(spark, sf_dir, con):
    """Whole tables in token ids: budgets filled level by level, prefixes in the seeded order."""
    rows = con.execute("SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents").fetchall()
    sizes = {r[0]: len(i) for r, i in zip(rows, library_ids("byte_bpe_50k.json", [r[3] for r in rows], 0))}
    taken = QUERIES["op2_mixing"][0](spark, sf_dir).collect()
    got = {(r["doc_id"], r["epoch"]) for r in taken}
    assert len(got) == len(taken) and all(r["tokens"] == sizes[r["doc_id"]] for r in taken)
    assert got == plain.mixture([(r[0], r[1], r[2], sizes[r[0]]) for r in rows], 0.5, 3, 17, DOMAIN_WEIGHTS, LANG_WEIGHTS)


def test_mixing_in_words_matches_sql(spark, sf_dir, con):
    taken = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], domain_of(), fraction=0.5, max_epochs=3,
                       seed=17, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS)
    mine = taken.select("row.doc_id", "domain", "lang", "source", "words", "epoch").toPandas()
    assert difference(mine, con.execute(reference_sql.mixing(0.5, 3, 17, DOMAIN_WEIGHTS, LANG_WEIGHTS)).df()) is None


def test_near_duplicates(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op4_near_dup"][0](spark, sf_dir).collect()}
    found = plain.near_duplicates([t for _, t in docs], 3, 85)
    for (doc, text), least in zip(docs, found):
        assert rows[doc]["component_id"] == docs[least][0]
        assert rows[doc]["n_shingles"] == len(plain.shingles(text, 3))
        assert rows[doc]["kept"] == (docs[least][0] == doc)


def test_secrets(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op8_secrets"][0](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for doc, text in docs:
        base = plain.base_spans(text)
        said = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base]
        assert rows[doc]["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(rows[doc]["spans"].split(",")) or not said
        assert rows[doc]["n_hex"] == sum(k == 2 for _, k, _ in base)


def test_syncmers(spark, sf_dir, docs):
    """Fingerprints and likeness from runs looked at one by one, and a common subsequence."""
    rows = sorted(QUERIES["op9_syncmers"][0](spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    texts = [t for _, t in docs]
    following = texts[1:] + texts[:1]
    assert len(rows) == len(texts)
    compared = 0
    for row, text, after in zip(rows, texts, following):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(text) + len(after) > 8000:
            continue
        compared += 1
        mine, changed, others = (plain.kept_anchors(plain.closed_syncmers(t)) for t in (text, edited, after))
        assert row["fingerprint"] == f"{mine[0]:02x}" + "".join(f"{v:08x}{p:08x}" for p, v in mine[1])
        assert row["edited_fingerprint"] == f"{changed[0]:02x}" + "".join(f"{v:08x}{p:08x}" for p, v in changed[1])
        assert row["near_edited"] == plain.anchor_likeness(mine, changed)
        assert row["near_next"] == plain.anchor_likeness(mine, others)
    assert compared > len(texts) / 2


def test_pipeline_stages(spark, sf_dir):
    """Every stage against plain code on the rows of the stage before it."""
    import corpus_pipeline

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = rows.columns
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    def step(name, docs):
        out = stages[name](spark, docs, sf_dir)
        return out, [r.asDict() for r in out.collect()]

    before = [r.asDict() for r in rows.collect()]
    docs, kept = step("quality rules", rows)
    for row in before:
        n, *_, repeated = plain.quality_counts(row["text"])
        if n < 50 or 2 * repeated > n:
            assert row not in kept
    assert docs.columns == columns and all(r in before for r in kept) and len(kept) > len(before) / 2

    kept.sort(key=lambda r: r["doc_id"])
    cleaned = plain.without_repeated_lines([r["text"] for r in kept])
    docs, lines = step("line dedup", docs)
    expected = {r["doc_id"]: t for r, t in zip(kept, cleaned) if t == r["text"] or plain.words_of(t)}
    assert {r["doc_id"]: r["text"] for r in lines} == expected
    assert docs.columns == columns and all(r["n_chars"] == len(r["text"]) for r in lines)

    lines.sort(key=lambda r: r["doc_id"])
    docs, single = step("MinHash near-dedup", docs)
    least = plain.near_duplicates([r["text"] for r in lines], 5, 80)
    assert {r["doc_id"] for r in single} == {lines[i]["doc_id"] for i in set(least)}
    assert docs.columns == columns

    docs, mixed = step("mixing sources to target weights", docs)
    assert docs.columns == columns and all(r in single for r in mixed)
    every, taken = (sum(map(len, library_ids("byte_bpe_50k.json", [r["text"] for r in x], 0))) for x in (single, mixed))
    assert 0.6 * every < taken <= 0.8 * every

    _, packed = step("packing", docs)
    per_doc = {}
    for piece in packed:
        per_doc[piece["doc_id"]] = per_doc.get(piece["doc_id"], 0) + piece["length"]
    times = {}
    for row in mixed:
        times[row["doc_id"]] = times.get(row["doc_id"], 0) + 1
    texts = {r["doc_id"]: r["text"] for r in mixed}
    ids = library_ids("byte_bpe_50k.json", [texts[d] for d in sorted(texts)], 0)
    assert per_doc == {d: times[d] * len(i) for d, i in zip(sorted(texts), ids)}


def test_small_packers_agree_with_a_search(spark):
    """The level chosen is one that makes the sum of squares smallest."""
    rng = np.random.default_rng(3)
    made: list = []
    packer = packing.LevelPacker(16, made.append)
    for i in range(300):
        size = int(rng.integers(1, 16))
        levels = packer.levels.copy()
        packer.place((i, 0, b"\0" * 4 * size, size))
        best = []
        for level in range(0, 17 - size):
            if level == 0 or levels[level]:
                after = levels.copy()
                if level:
                    after[level] -= 1
                if level + size < 16:
                    after[level + size] += 1
                best.append(int((after ** 2).sum()))
        assert int((packer.levels ** 2).sum()) == min(best)
    packer.close()
    assert sum(len(p[2]) for pieces in made for p in pieces) % 4 == 0
    assert len(made) > 0


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    errors = []
    for share in (0.3, 0.6, 0.9):
        other = np.concatenate([base[: int(2000 * share)], rng.integers(0, 1 << 63, 2000 - int(2000 * share), dtype=np.uint64)])
        true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        errors.append(abs((near_dup.signature(base) == near_dup.signature(other)).mean() - true))
    assert max(errors) < 0.15
