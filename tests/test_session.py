"""Numbering, staging and the shape of plans."""

from __future__ import annotations

import random

import pytest

import __spark_entry__ as entry
from tallyspark.session import number_rows, number_within, shared_root, stage


def test_running_number_is_dense_and_in_order(spark):
    values = random.Random(3).sample(range(100_000), 5_000)
    frame = spark.createDataFrame([(v, f"k{v:06d}") for v in values], "v bigint, k string").repartition(7)
    rows = number_rows(frame, ["k"], "n", start=11).orderBy("n").collect()
    assert [r["v"] for r in rows] == sorted(values)
    assert [r["n"] for r in rows] == list(range(11, 11 + len(values)))


def test_running_number_of_nothing(spark):
    assert number_rows(spark.createDataFrame([], "v bigint"), ["v"], "n").count() == 0


def test_position_in_groups_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot", i) for i in rng.sample(range(50_000), 3_000)] + [(f"g{i % 40}", i) for i in range(2_000)] + [(None, 1), (None, 2)]
    frame = spark.createDataFrame(rows, "g string, v bigint").repartition(6)
    got = {}
    for r in number_within(frame, ["g"], ["v"], "n").collect():
        got.setdefault(r["g"], []).append((r["n"], r["v"]))
    wanted = {}
    for g, v in rows:
        wanted.setdefault(g, []).append(v)
    assert {g: [v for _, v in sorted(p)] for g, p in got.items()} == {g: sorted(v) for g, v in wanted.items()}
    assert all([n for n, _ in sorted(p)] == list(range(1, len(p) + 1)) for p in got.values())


def test_staged_table_lies_in_the_shared_folder(spark):
    staged = stage(spark.range(10).toDF("v"))
    assert staged.count() == 10
    assert all(f.replace("file://", "").startswith(shared_root(spark)) for f in staged.inputFiles())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("str")))
def test_plans_have_no_cross_joins(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert operator not in plan


def test_reports_read_only_what_they_need(spark, sf_dir):
    plan = entry.queries()["agg2_votes_by_contest_precinct"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<contest_id:bigint,candidate_id_fk:bigint,barcode_id:bigint,vote_status:string>" in plan.replace(
        "ballot_image_id:bigint,", "")
    overvoted = entry.queries()["agg6_overvoted_ballots"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(vote_status,OVERVOTED)" in overvoted
