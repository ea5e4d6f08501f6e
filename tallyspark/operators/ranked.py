"""Ranked-choice tabulation by elimination rounds, all contests at once.

Ballots are compressed to distinct preference lists with a weight.  A round is
one aggregate over the lists plus a few operations on the per-candidate counts;
eliminated names are then removed from the lists, which shrink and merge, so
every round works on less than the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import text
from tallyspark.operators.ingest import Star
from tallyspark.session import discarding, stage

# Outcomes, and what happened to a candidate in a round.
WINNER, TIE, NO_MAJORITY = "winner", "tie", "no_majority"
OVERVOTE_RULES = ("cut", "last_wins", "exhaust")
TIE_RULES = ("eliminate_last", "declare_tie")


def ranked_marks(star: Star, *statuses: str) -> DataFrame:
    """Rank boxes of ranked contests with one of the given statuses."""
    contests = star.contest.filter("contest_type = 'RANKED_CHOICE'").select(
        F.col("id").alias("contest_id"), "contest_title"
    )
    candidates = star.candidate.select(
        F.col("id").alias("candidate_id_fk"),
        "candidate_name",
        text.ranked_base("candidate_name").alias("base"),
        text.rank_of("candidate_name", text.RANK_FULL, 2).alias("rank"),
    ).filter(F.col("base").isNotNull())
    return (
        star.vote_opportunity.filter(F.col("vote_status").isin(*statuses))
        .select("ballot_image_id", "contest_id", "candidate_id_fk", "vote_status")
        .join(contests, "contest_id")
        .join(candidates, "candidate_id_fk")
    )


def ranked_ballots(star: Star, overvote_rule: str = "cut") -> DataFrame:
    """Preference list per contest and image, first choice first.

    ``cut``: the list ends before the first rank with two counted marks.
    ``last_wins``: a doubled rank goes to the last name.
    ``exhaust``: like ``cut``, and a rank stored as overvoted ends the list too.
    Marks are reduced to one row per rank before the ranks of a ballot are listed.
    """
    if overvote_rule not in OVERVOTE_RULES:
        raise ValueError(f"overvote_rule must be one of {OVERVOTE_RULES}")
    statuses = ("VOTED", "OVERVOTED") if overvote_rule == "exhaust" else ("VOTED",)
    counted = F.count_if(F.col("vote_status") == "VOTED")
    spoiled = F.count_if(F.col("vote_status") == "OVERVOTED")
    per_rank = ranked_marks(star, *statuses).groupBy("contest_id", "contest_title", "ballot_image_id", "rank").agg(
        F.max_by("base", "candidate_name").alias("base"),
        ((counted > 1) | (spoiled > 0)).alias("doubled"),
    )
    bad = F.lit(None).cast("int") if overvote_rule == "last_wins" else F.min(F.when(F.col("doubled"), F.col("rank")))
    usable = F.when((F.col("rank") >= 1) & F.col("base").isNotNull(), F.struct("rank", "base"))
    lists = per_rank.groupBy("contest_id", "contest_title", "ballot_image_id").agg(
        F.array_sort(F.collect_list(usable)).alias("ranks"), bad.alias("cut")
    )
    kept = F.filter("ranks", lambda r: F.col("cut").isNull() | (r["rank"] < F.col("cut")))
    prefs = F.transform(kept, lambda r: r["base"])
    return (
        lists.select("contest_id", "contest_title", "ballot_image_id", prefs.alias("prefs"))
        .filter(F.size("prefs") > 0)
    )


def _compress(ballots: DataFrame) -> DataFrame:
    return ballots.groupBy("contest_id", "prefs").agg(F.sum("weight").alias("weight"))


def _count_round(lists: DataFrame, number: int, tie_rule: str) -> DataFrame:
    """One row per contest and candidate still standing, with its fate in this round.

    The windows run over candidates, never over ballots.
    """
    counts = lists.groupBy("contest_id", F.get("prefs", 0).alias("candidate")).agg(F.sum("weight").alias("votes"))
    contest = Window.partitionBy("contest_id")
    order = contest.orderBy(F.desc("votes"), "candidate")
    stats = counts.withColumns(
        {
            "place": F.row_number().over(order),
            "active": F.sum("votes").over(contest),
            "standing": F.count("*").over(contest),
            "top": F.max("votes").over(contest),
            "bottom": F.min("votes").over(contest),
            "last_name": F.max("candidate").over(contest),
        }
    ).withColumn("majority", F.expr("active div 2 + 1"))
    leads = F.col("top") >= F.col("majority")
    level = F.col("top") == F.col("bottom")
    alone = F.col("standing") == 1
    pair = F.col("standing") == 2
    if tie_rule == "eliminate_last":
        tied = pair & level
        decided = leads | alone | (pair & ~level)
        tiebreak = (~decided) & (~tied) & level
        out = F.when(tiebreak, F.col("candidate") == F.col("last_name")).otherwise(F.col("votes") == F.col("bottom"))
    elif tie_rule == "declare_tie":
        decided = leads | alone
        tied = pair | level
        tiebreak = F.lit(False)
        out = F.col("votes") == F.col("bottom")
    else:
        raise ValueError(f"tie_rule must be one of {TIE_RULES}")
    fate = (
        F.when(decided, F.when(F.col("place") == 1, "winner").otherwise("continuing"))
        .when(tied, "tied")
        .when(out, "eliminated")
        .otherwise("continuing")
    )
    outcome = F.when(decided, WINNER).when(tied, TIE)
    return stats.select(
        "contest_id",
        F.lit(number).alias("round"),
        "candidate",
        "votes",
        "place",
        "active",
        "majority",
        fate.alias("fate"),
        tiebreak.alias("tiebreak"),
        outcome.alias("outcome"),
    )


def irv_rounds(ballots: DataFrame, tie_rule: str = "eliminate_last") -> DataFrame:
    """Full round history: one row per contest, round and candidate with votes.

    ``ballots`` has ``contest_id`` and ``prefs``.  Each round removes at least one
    candidate of every open contest, so the loop ends after as many rounds as the
    longest candidate list.  The distinct lists are written once and read by every
    round without the names that are out; a round writes its counts, a row per contest
    and candidate.  The driver only learns whether any contest is still open.
    """
    spark = ballots.sparkSession
    with discarding(spark):
        lists = stage(_compress(ballots.select("contest_id", "prefs", F.lit(1).cast("bigint").alias("weight"))), "lists")
        standing, history, number = lists, None, 0
        while True:
            number += 1
            counts = stage(_count_round(standing, number, tie_rule), "round")
            history = counts if history is None else history.unionByName(counts)
            undecided = counts.filter(F.col("outcome").isNull()).select("contest_id").distinct()
            if undecided.isEmpty():
                return stage(history, "history", keep=True)
            gone = (
                history.filter("fate = 'eliminated'").join(undecided, "contest_id", "left_semi")
                .groupBy("contest_id").agg(F.collect_list("candidate").alias("gone"))
            )
            left = lists.join(gone, "contest_id").select(
                "contest_id", F.filter("prefs", lambda p: ~F.array_contains("gone", p)).alias("prefs"), "weight")
            standing = left.filter(F.size("prefs") > 0)


def irv_results(ballots: DataFrame, rounds: DataFrame) -> DataFrame:
    """One row per contest that has ballots: total, rounds, winner, outcome.

    Every ballot is active in the first of its ``rounds``, so ``ballots`` is not read again.
    """
    ends = rounds.groupBy("contest_id").agg(
        F.max(F.when(F.col("round") == 1, F.col("active"))).alias("total_ballots"),
        F.max("round").alias("rounds"),
        F.max(F.when(F.col("fate") == "winner", F.col("candidate"))).alias("winner"),
        F.coalesce(F.max("outcome"), F.lit(NO_MAJORITY)).alias("outcome"),
    )
    return ends.select("contest_id", "total_ballots", "rounds", "winner", "outcome")


def irv_round_report(rounds: DataFrame) -> DataFrame:
    """Adds share of active ballots, change against round 1, and what the previous
    round redistributed.  A candidate unseen in round 1 is compared with 0 votes."""
    first = rounds.filter("round = 1").select("contest_id", "candidate", F.col("votes").alias("first_votes"))
    out = F.col("fate") == "eliminated"
    moved = rounds.groupBy("contest_id", (F.col("round") + 1).alias("round")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(out, F.struct("place", "candidate")))), lambda e: e["candidate"]
            ),
            ", ",
        ).alias("redistributed_from"),
        F.coalesce(F.sum(F.when(out, F.col("votes"))), F.lit(0)).alias("redistributed_votes"),
        F.bool_or("tiebreak").alias("after_tiebreak"),
    )
    change = F.when(F.col("round") > 1, F.col("votes") - F.coalesce("first_votes", F.lit(0)))
    return (
        rounds.join(first, ["contest_id", "candidate"], "left")
        .join(moved, ["contest_id", "round"], "left")
        .select(
            "contest_id", "round", "candidate", "votes", "active", "majority", "fate",
            (F.lit(100.0) * F.col("votes") / F.col("active")).alias("pct_of_active"),
            change.alias("change_vs_first"),
            "redistributed_from", "redistributed_votes", "after_tiebreak",
        )
    )
