"""Sizes and shapes at which rows used to be lost, or memory to run out."""

from __future__ import annotations

import glob
import hashlib
import json

from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark import session
from tallyspark.llm import chat, secret_scan, urls
from tests.llm import plain

LONG = 25_000_000


def test_a_very_long_turn_is_in_every_digest(spark):
    """Made by a native function; no JSON text of it is parsed."""
    rows = spark.createDataFrame([(1, 0, "user", 3), (1, 1, "assistant", LONG // 5), (1, 2, "user", 2), (1, 3, "assistant", 1)],
                                 "conv_id bigint, turn bigint, role string, n int")
    rows = rows.select("conv_id", "turn", F.struct("role", F.expr("repeat('é</s>', n)").alias("text")).alias("record"))
    row = chat.read_back(chat.format_records(rows)).first()
    turns = [("user", "é</s>" * 3), ("assistant", "é</s>" * (LONG // 5)), ("user", "é</s>" * 2), ("assistant", "é</s>")]
    assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == plain.chat_digest(turns)
    assert row["loss_chars"] == LONG + 5 and row["n_unread"] == 0


def test_structs_have_the_turns_of_their_json(spark):
    made = [
        ("struct('user' AS role, 'hi' AS text)", "turn"),
        ("struct(CAST(NULL AS STRING) AS role, 'hi' AS text, 7 AS id)", "turn"),
        ("struct(array(struct('user' AS role, 'a' AS content, 1 AS n), struct('assistant' AS role, 'b' AS content, 2 AS n)) AS messages, 'x' AS source)", "messages"),
        ("struct(array(struct('human' AS `from`, 'a' AS value), struct('gpt' AS `from`, 'b' AS value)) AS conversations)", "exchanges"),
        ("struct('s' AS system, 'do' AS instruction, CAST(NULL AS STRING) AS input, 'done' AS output)", "instruction"),
        ("struct('p' AS prompt, 'c' AS completion)", "completion"),
        ("struct('q' AS question, 'a' AS answer)", "answer"),
        ("struct('q' AS question, 'p' AS prompt)", None),
        ("struct(array('a') AS text)", None),
        ("struct('x' AS other)", None),
    ]
    for expression, layout in made:
        row = spark.range(1).select(F.expr(expression).alias("record"))
        typed = chat.canonical_turns(row).first()
        assert typed["layout"] == layout, expression
        if layout:
            parsed = chat.canonical_turns(row.select(F.to_json("record").alias("record"))).first()
            assert (typed["layout"], typed["turns"]) == (parsed["layout"], parsed["turns"]), expression
    none = spark.createDataFrame([(1, 1, None)], "conv_id bigint, turn bigint, record struct<role:string,text:string>")
    assert [r["formatted"] for r in chat.format_records(none).collect()] == [None]


def test_unread_records_are_counted(spark):
    records = [(1, 0, json.dumps({"role": "user", "text": "a"})), (1, 1, "{torn"), (1, 2, json.dumps({"who": "x"})),
               (1, 3, json.dumps({"role": "assistant", "text": "b"})), (2, 0, "{torn"), (3, 0, json.dumps({"role": "user", "text": ""}))]
    rows = chat.read_back(chat.format_records(spark.createDataFrame(records, "conv_id bigint, turn bigint, record string"))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["n_unread"]) for r in rows} == {1: (2, 2), 3: (1, 0)}


def test_hosts_of_many_labels(spark):
    """A url costs as many keys as rules have lengths, however many labels its host has."""
    rules = spark.createDataFrame([("com", "/", "block"), ("b.com", "/x/", "allow"), ("", "/y", "block")], "host string, path string, verdict string")
    pages = [(1, "http://" + "a." * 200_000 + "b.com/x/1"), (2, "http://" + "a" * 400_000 + ".com"), (3, "http://xb.com/x/"), (4, "http://com./y"),
             (5, "http://b.com/"), (6, "http:///y/z"), (7, None), (8, "http://" + "." * 100_000 + "/y")]
    judged = urls.judge_urls(spark.createDataFrame(pages, "page_id int, url string"), rules, ["page_id"])
    assert {r["row"]["page_id"]: (r["rule"], r["verdict"]) for r in judged.collect()} == {
        1: ("b.com/x/", "allow"), 2: (None, "allow"), 3: ("com/", "block"), 4: ("/y", "block"), 5: ("com/", "block"), 6: ("/y", "block"),
        7: (None, "allow"), 8: ("/y", "block")}
    assert len(urls.candidate_keys("a." * 100_000 + "com", "/", [3, 5], [1])) == 2


def test_copies_without_an_id_go(spark):
    base = " ".join(f"word{i}" for i in range(200))
    near, other = base + " end", " ".join(f"other{i}" for i in range(200))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"

    def left(*rows):
        docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], schema).repartition(3)
        return sorted((r["doc_id"] or -1, r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())

    assert left((1, base), (None, base), (None, near), (2, near)) == [(1, base)]
    assert left((None, base), (None, base), (None, near), (None, other)) in ([(-1, base), (-1, other)], sorted([(-1, near), (-1, other)]))
    assert left((9, other), (None, base)) == [(-1, base), (9, other)]


def test_candidate_secrets_are_not_left_behind(spark):
    root = session.shared_root(spark).removeprefix("file:")
    word = hashlib.sha256(b"x").hexdigest()
    docs = spark.createDataFrame([(1, f"key={word} and more")], "doc_id bigint, text string")
    assert secret_scan.scan_secrets(docs).first()["spans"]
    assert not glob.glob(f"{root}/tallyspark/{spark.sparkContext.applicationId}/secret-*")
