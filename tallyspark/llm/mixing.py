"""Mixing sources to target weights, by budgets in a tree of domains, languages and sources.

The budget of all goes down the tree.  A node shares its budget among its children by their
weights; a child never gets more than its texts hold in ``max_epochs`` passes, and what it
cannot use goes to its siblings by their weights.  Only what a whole node cannot use reaches
the siblings of the node.  A leaf takes whole epochs and then a prefix of the next one, in
an order given by the seed: texts follow each other as long as the budget holds their size.

A text's size is its number of words unless ``size`` says otherwise; the query and the
pipeline count token ids (``tokens.id_counts``).  A size that is costly is computed once for
every text and again only for texts of the buckets in which a budget ends.

A leaf may hold any share of all rows: the prefix is found from the sums of hashed buckets,
and only the one bucket per leaf in which the budget ends is sorted.  Apart from ``size``,
only built-in expressions are used.  Null text is empty; texts of size 0 are taken in every
epoch at no cost.  Null languages and sources are children of their own; texts with the same
doc_id are ordered by their size.  An empty table gives no rows.  ``row`` keeps extra columns
apart, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import WORD, text_of
from tallyspark.session import discarding, stage

_LEAF = ["domain", "lang", "source"]


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def weight_of(value: Column, weights: Mapping[str, float]) -> Column:
    """Weight of a child by its name; a name without one has weight 1."""
    out = F.lit(1.0)
    for name, weight in weights.items():
        if weight <= 0:
            raise ValueError("weights are positive")
        out = F.when(value == name, F.lit(float(weight))).otherwise(out)
    return out


def share(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``given``: the parents' ``budget`` among children with ``capacity`` and ``weight``.

    Children are filled in order of capacity over weight; the first that is not filled sets
    the level for the rest.
    """
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.col("capacity") / F.col("weight"), *[c for c in _LEAF if c in children.columns])
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    ranked = children.withColumn("level", level).withColumn("full", F.col("capacity") <= F.col("level") * F.col("weight"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    common = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(whole)
    ranked = ranked.withColumn("common", common)
    given = F.when(F.col("full"), F.col("capacity")).otherwise(F.col("common") * F.col("weight"))
    return ranked.withColumn("given", given).drop("level", "full", "common")


def budgets(leaves: DataFrame, total: Column, max_epochs: int, domain_weights: Mapping[str, float],
            lang_weights: Mapping[str, float], source_weights: Mapping[str, float]) -> DataFrame:
    """Per leaf: the size it holds, whole epochs and the size of the last, partial epoch.

    ``leaves`` has domain, lang, source and words (the size).
    """
    caps = leaves.withColumn("capacity", (F.col("words") * max_epochs).cast("double"))
    top = caps.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    everything = F.sum("capacity").over(Window.partitionBy(F.lit(0)))
    top = top.withColumns({"budget": F.least(everything, total.cast("double")), "weight": weight_of(F.col("domain"), domain_weights)})
    top = share(top, [F.lit(0)])

    def down(parents: DataFrame, children: DataFrame, keys: list[str], weight: Column) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
        above = parents.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("given").alias("budget"))
        joined = children.join(above, same).select(*children.columns, "budget").withColumn("weight", weight)
        return share(joined, keys)

    middle = down(top, caps.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")), ["domain"],
                  weight_of(F.col("lang"), lang_weights))
    low = down(middle, caps, ["domain", "lang"], weight_of(F.col("source"), source_weights))
    given = F.floor(F.col("given")).cast("bigint")
    epochs = F.when(F.col("words") > 0, F.floor(given / F.col("words"))).otherwise(0).cast("bigint")
    return low.select(*_LEAF, "words", given.alias("given")).select(
        *_LEAF, "words", "given", epochs.alias("epochs"), (F.col("given") - epochs * F.col("words")).alias("rest"))


def mix(docs: DataFrame, keep: list[str], domain: Column, *, fraction: float = 0.5, max_epochs: int = 3, seed: int = 17,
        domain_weights: Mapping[str, float], lang_weights: Mapping[str, float] | None = None,
        source_weights: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", source_col: str = "source", size: Callable[[Column], Column] = count_words) -> DataFrame:
    """``row`` (a struct of the columns ``keep``), domain, lang, source, words (its size) and epoch of every text taken.

    The budget is ``fraction`` of the sizes of all texts; ``size`` is applied to the text, null
    read as empty.  A text taken in several epochs has a row each.
    """
    read = docs.select(F.struct(*keep).alias("row"), domain.alias("domain"), F.col(lang_col).alias("lang"),
                       F.col(source_col).alias("source"), F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    with discarding(docs.sparkSession):
        counted = stage(read.select(*_LEAF, "id", size(F.col("body")).alias("words")), "counted-sizes")
        leaves = stage(counted.groupBy(*_LEAF).agg(F.sum("words").alias("words")), "leaves")
        total = leaves.agg(F.floor(F.sum("words") * fraction)).first()[0] or 0
        plan = stage(
            budgets(leaves, F.lit(total), max_epochs, domain_weights, lang_weights or {}, source_weights or {}), "budgets")
        plan = stage(_with_edges(counted, plan, seed), "edges", keep=True)
    placed = _placed(read, plan, seed)
    edge = placed.filter("bucket = edge").withColumn("words", size(F.col("body"))).drop("body")
    running = F.sum("words").over(
        Window.partitionBy(*_LEAF, "bucket").orderBy("place", "id", "words").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("taken", F.col("before") + running <= F.col("rest"))
    rest = placed.filter("edge is null or bucket <> edge").withColumn("taken", F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))
    passes = F.col("epochs") + F.col("taken").cast("int")
    rest = rest.withColumn("passes", passes).filter("passes > 0").withColumn("words", size(F.col("body"))).drop("body")
    return (
        rest.unionByName(edge.withColumn("passes", passes).filter("passes > 0"))
        .select("row", *_LEAF, "words", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1)).alias("epoch"))
    )


def _placed(read: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Texts with their leaf's plan, their place in the leaf's partial epoch and its bucket."""
    named = plan.drop("words", "given").withColumnsRenamed({c: f"of_{c}" for c in _LEAF})
    same = F.lit(True)
    for c in _LEAF:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    placed = read.join(named, same).drop(*[f"of_{c}" for c in _LEAF]).withColumn("place", place)
    return placed.withColumn("bucket", F.substring("place", 1, 3))


def _with_edges(counted: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Adds to each leaf's plan the bucket in which its budget ends and the size before it.

    Buckets before the edge are taken whole, those after it not at all; without an edge,
    the budget holds every bucket.
    """
    sums = _placed(counted, plan, seed).groupBy(*_LEAF, "bucket", "rest").agg(F.sum("words").alias("inside"))
    upto = F.sum("inside").over(Window.partitionBy(*_LEAF).orderBy("bucket"))
    over = sums.withColumn("upto", upto).filter("upto > rest")
    first = over.groupBy(*_LEAF).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("inside")).alias("before"))).alias("edge"))
    first = first.select(*[F.col(c).alias(f"of_{c}") for c in _LEAF], F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before"))
    same = F.lit(True)
    for c in _LEAF:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return plan.join(first, same, "left").drop(*[f"of_{c}" for c in _LEAF])
