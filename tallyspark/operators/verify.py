"""Counts checked against known ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected_totals(truth: DataFrame) -> DataFrame:
    """Voted, overvoted and unmarked per contest and candidate; any other status is unmarked."""
    status = F.col("counted_as")
    marked = F.coalesce(status.isin("VOTED", "OVERVOTED"), F.lit(False))
    return truth.groupBy("contest", "candidate").agg(
        F.count_if(status == "VOTED").alias("voted"),
        F.count_if(status == "OVERVOTED").alias("overvoted"),
        F.count_if(~marked).alias("unmarked"),
    )


def verify_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Class of every contest and candidate found on either side.

    Physical marks are compared: an overvote is a mark that was really made.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "contest", "candidate",
            F.struct("voted", "overvoted", "unmarked").alias(name),
            (F.col("voted") + F.col("overvoted")).alias(f"{name}_marks"),
        )

    both = side(actual, "actual").join(side(expected, "expected"), ["contest", "candidate"], "full_outer")
    klass = (
        F.when(F.col("actual").isNull(), "missing_in_db")
        .when(F.col("expected").isNull(), "missing_in_gt")
        .when(F.col("actual_marks") == F.col("expected_marks"), "match")
        .otherwise("mismatch")
    )
    zero = F.lit(0).cast("bigint")
    rows = both.withColumn("class", klass)
    return rows.select(
        "contest", "candidate", "class",
        *[
            F.coalesce(F.col(f"{name}.{part}"), zero).alias(f"{name}_{part}")
            for name in ("actual", "expected") for part in ("voted", "overvoted", "unmarked")
        ],
        F.when(F.col("class") == "mismatch", F.col("actual_marks") - F.col("expected_marks")).alias("delta_voted"),
    )


def accuracy(verified: DataFrame) -> DataFrame:
    """One row: class counts and matches as a share of what both sides have."""
    counts = verified.agg(
        F.count_if(F.col("class") == "match").alias("matches"),
        F.count_if(F.col("class") == "mismatch").alias("mismatches"),
        F.count_if(F.col("class") == "missing_in_db").alias("missing_in_db"),
        F.count_if(F.col("class") == "missing_in_gt").alias("missing_in_gt"),
    )
    compared = F.col("matches") + F.col("mismatches")
    return counts.withColumn("accuracy_pct", F.when(compared > 0, F.lit(100.0) * F.col("matches") / compared))


def expected_by_combination(truth: DataFrame) -> DataFrame:
    """Voted marks per ballot combination, contest and candidate."""
    return truth.filter("counted_as = 'VOTED'").groupBy("combo_id", "precinct", "party", "contest", "candidate").agg(
        F.count("*").alias("votes")
    )
