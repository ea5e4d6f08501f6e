"""Who won, and what the results report shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark import schema as S
from tallyspark.operators import reports
from tallyspark.operators.ingest import SINGLE_MARK_TYPES, Star


def rank_winners(votes: DataFrame, config: DataFrame) -> DataFrame:
    """Rank and winner flag per contest and candidate.

    ``votes`` has one row per contest and candidate, so the windows run over the
    candidate list.  A single seat needs strictly more than its threshold; several
    seats go to the leaders.  Equal votes are ordered by name.
    """
    known = votes.join(config, "contest", "left")
    order = Window.partitionBy("contest").orderBy(F.desc("votes"), "candidate")
    total = F.sum("votes").over(Window.partitionBy("contest"))
    seats = F.coalesce("max_votes", F.lit(S.DEFAULT_MAX_VOTES))
    percent = F.coalesce("percent_to_win", F.lit(S.DEFAULT_PERCENT_TO_WIN))
    place = F.row_number().over(order)
    clears = (place == 1) & (total > 0) & (F.col("votes") > percent / 100.0 * total)
    elected = F.when(seats <= 1, clears).otherwise(place <= seats)
    applies = F.coalesce(F.col("contest_type").isin(*SINGLE_MARK_TYPES), F.lit(False))
    return known.select(
        *votes.columns,
        F.col("contest_type"),
        seats.alias("max_votes"),
        percent.alias("percent_to_win"),
        place.alias("place"),
        (applies & elected).alias("winner"),
    )


def results_report(star: Star) -> DataFrame:
    """Marked, overvoted and counted votes with winners, per contest and candidate."""
    return report_of_counts(star, reports.count_by_keys(star.vote_opportunity, "contest_id", "candidate_id_fk"))


def report_of_counts(star: Star, counts: DataFrame) -> DataFrame:
    """The report from counts per contest and candidate key; of ``star`` only those dimensions are read."""
    totals = reports.named_totals(star, counts).withColumn("votes", F.col("voted"))
    ranked = rank_winners(totals.select("contest", "candidate", "votes", "overvoted"), reports.contest_config(star))
    return ranked.select(
        "contest", "candidate", "contest_type", "max_votes", "percent_to_win",
        (F.col("votes") + F.col("overvoted")).alias("marked"),
        "overvoted",
        F.col("votes").alias("counted"),
        "place",
        "winner",
    )


def nondefault_thresholds(star: Star) -> DataFrame:
    """Reported contests whose threshold is not the simple majority."""
    seen = star.vote_opportunity.select("contest_id").distinct()
    titles = seen.join(reports.contest_names(star), "contest_id").select("contest").distinct()
    return titles.join(reports.contest_config(star), "contest").filter(
        F.col("percent_to_win") != S.DEFAULT_PERCENT_TO_WIN
    ).select("contest", "percent_to_win")


def no_winner_contests(report: DataFrame) -> DataFrame:
    """Single-seat contests of a results report in which nobody clears the threshold."""
    single = report.filter(F.col("contest_type").isin(*SINGLE_MARK_TYPES) & (F.col("max_votes") <= 1))
    return (
        single.groupBy("contest")
        .agg(
            F.bool_or("winner").alias("decided"),
            F.max("percent_to_win").alias("percent_to_win"),
            F.max("counted").alias("leading_votes"),
            F.sum("counted").alias("valid_votes"),
        )
        .filter(~F.col("decided"))
        .drop("decided")
    )
