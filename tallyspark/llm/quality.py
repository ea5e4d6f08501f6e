"""Quality rules with thresholds taken from the data, by language and source.

Every text gets counts.  Base rules use fixed limits.  For the rest, four measures of a text
(word length, symbols, repeated lines, repeated words) go into quantile sketches per language
and source: counts of logarithmic cells of 2 % width, which merge by addition, so sketches of
sources add up to those of languages and of all.  A text is rejected where a measure lies
outside its group's quartiles by more than three times their distance plus a slack.  Groups
of fewer than ``MIN_GROUP`` texts use their language's sketch, small languages that of all.

Only built-in expressions are used.  Null text has no words and fails the base rules; null
languages and sources are groups of their own; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import WORD, text_of
from tallyspark.session import discarding, stage

MIN_WORDS, MOST_REPEATED_PCT = 50, 50
MIN_GROUP = 50
#: measure: slack added beyond the fences, and whether small values are outliers as well.
MEASURES = {
    "word_length": (0.75, True),
    "symbol_rate": (0.10, False),
    "dup_line_rate": (0.45, False),
    "repeat_rate": (0.40, False),
}
FENCE = 3.0
CELL = 1.02
_ZERO = -100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column) -> Column:
    """Words that lie in a window of three that occurs more than once in the text."""

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.zip_with(
                F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
            )
            return let(F.sort_array(F.array_distinct(F.flatten(twice))), of_places)

        def of_places(p: Column) -> Column:
            steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(3)))
            return F.aggregate(steps, F.lit(3).cast("bigint"), lambda total, x: total + x)

        numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            let(F.sort_array(numbered), of_sorted)
        )

    n = F.size(words) - 2
    windows = F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))
    hashes = F.transform(windows, lambda w: F.xxhash64(w["a"], w["b"], w["c"]))
    return F.when(n < 1, F.lit(0).cast("bigint")).otherwise(let(hashes, of_hashes))


def text_counts(text: Column) -> Column:
    """Struct of the counts of one text."""
    symbols = F.size(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>]"), 0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            _covered(words).alias("n_repeat_words"),
        )

    return F.struct(
        let(F.regexp_extract_all(text, F.lit(WORD), 0), of_words).alias("words"),
        symbols.cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        )).alias("lines"),
    )


def _cell(value: Column) -> Column:
    return F.when(value > 0, F.ceil(F.log(value) / F.log(F.lit(CELL)))).otherwise(_ZERO).cast("int")


def _value(cell: Column) -> Column:
    """Middle of a cell."""
    return F.when(cell == _ZERO, 0.0).otherwise(2 * F.pow(F.lit(CELL), cell) / (CELL + 1))


def _measured() -> list[Column]:
    """The measures of a text with words, in the order of ``MEASURES``."""
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return [F.col("word_chars") / n, F.col("n_symbols") / n, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n]


def sketches(counted: DataFrame) -> DataFrame:
    """Cell counts of every measure by language and source."""
    return (
        counted.filter("n_words > 0")
        .select("lang", "source", F.posexplode(F.array(*_measured())).alias("measure", "value"))
        .groupBy("lang", "source", "measure", _cell(F.col("value")).alias("cell"))
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketch.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("cell"))
    whole = F.sum("n").over(group)
    return (
        merged.select(*keys, "measure", "cell", upto.alias("upto"), whole.alias("whole"))
        .groupBy(*keys, "measure", "whole")
        .agg(F.min(F.when(4 * F.col("upto") >= F.col("whole"), F.col("cell"))).alias("low"),
             F.min(F.when(4 * F.col("upto") >= 3 * F.col("whole"), F.col("cell"))).alias("high"))
        .select(*keys, "measure", F.col("whole").alias("texts"), _value(F.col("low")).alias("q1"), _value(F.col("high")).alias("q3"))
    )


def thresholds(counted: DataFrame) -> DataFrame:
    """Per language and source, the lowest and highest value allowed of each measure.

    One row per group: ``low`` and ``high`` are arrays in the order of ``MEASURES``.
    """
    sketch = stage(sketches(counted), "sketches")

    def renamed(df: DataFrame, suffix: str, *keys: str) -> DataFrame:
        names = {"texts": f"texts_{suffix}", "q1": f"q1_{suffix}", "q3": f"q3_{suffix}", "measure": f"measure_{suffix}"}
        return df.withColumnsRenamed(names | {k: f"{k}_{suffix}" for k in keys})

    own = _quartiles(sketch, ["lang", "source"])
    lang = renamed(_quartiles(sketch, ["lang"]), "l", "lang")
    every = renamed(_quartiles(sketch, []), "a")
    joined = (
        own.join(lang, F.col("lang").eqNullSafe(F.col("lang_l")) & (F.col("measure") == F.col("measure_l")))
        .join(every, F.col("measure") == F.col("measure_a"))
    )

    def pick(name: str) -> Column:
        return (
            F.when(F.col("texts") >= MIN_GROUP, F.col(name))
            .when(F.col("texts_l") >= MIN_GROUP, F.col(f"{name}_l"))
            .otherwise(F.col(f"{name}_a"))
        )

    slack = F.array(*[F.lit(s) for s, _ in MEASURES.values()])
    both = F.array(*[F.lit(b) for _, b in MEASURES.values()])
    reach = FENCE * (F.col("high") - F.col("low")) + F.get(slack, F.col("measure"))
    return (
        joined.select("lang", "source", "measure", pick("q1").alias("low"), pick("q3").alias("high"))
        .select("lang", "source", F.struct(
            "measure",
            F.when(F.get(both, F.col("measure")), F.col("low") - reach).otherwise(F.lit(-1.0)).alias("low"),
            (F.col("high") + reach).alias("high"),
        ).alias("limit"))
        .groupBy("lang", "source").agg(F.sort_array(F.collect_list("limit")).alias("limits"))
        .select("lang", "source", F.col("limits.low").alias("low"), F.col("limits.high").alias("high"))
    )


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _counted(docs: DataFrame, keep: list[str], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``row`` (a struct of the columns ``keep``), lang, source and the counts of every text."""
    # Through an explode, later filters and columns use the counts instead of computing them anew.
    return (
        docs.select(F.struct(*keep).alias("row"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                    F.explode(F.array(text_counts(text_of(text_col)))).alias("c"))
        .select("row", "lang", "source", "c.words.*", "c.n_symbols", "c.lines.*")
    )


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``row``, the counts, ``base_failed`` and ``kept`` of counted texts, by the limits of their group."""
    limits = limits.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "low", "high")
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PCT * n)
    inside = F.lit(True)
    for i, value in enumerate(_measured()):
        inside = inside & value.between(F.col("low")[i], F.col("high")[i])
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    return (
        counted.join(limits, same, "left")
        .select("row", *_COUNTS, base.alias("base_failed"), (~base & F.coalesce(inside, F.lit(False))).alias("kept"))
    )


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   source_col: str = "source") -> DataFrame:
    """Counts and verdicts of every text.  Texts are read once; their counts are written."""
    counted = stage(_counted(docs, [id_col], text_col, lang_col, source_col), "counted")
    judged = judge(counted, stage(thresholds(counted), "limits"))
    return judged.select(F.col("row")[id_col].alias("doc_id"), *_COUNTS, "base_failed", "kept")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns.

    Texts are counted twice, for the limits and for the verdicts, so that no copy of them
    is written or moved.
    """
    with discarding(docs.sparkSession):
        counted = stage(_counted(docs, [lang_col], text_col, lang_col, source_col).drop("row"), "counted")
        limits = stage(thresholds(counted), "limits", keep=True)
    return judge(_counted(docs, docs.columns, text_col, lang_col, source_col), limits).filter("kept").select("row.*")
