"""Removal of lines that repeat an earlier line, exactly or up to one edit.

Lines are numbered within their text; a line is earlier if its (doc_id, hash of the text,
number) is smaller.  The unit of an edit is a word between single blanks in lines of at least
``min_units`` words, and a code point in all others (short lines, scripts without blanks): one
unit replaced, inserted or left out.  With five units, one edit leaves at least four fifths of
a line alike.  If two lines are one edit apart, the first or the last half of their units is
untouched, and within the other half again one of its halves.  Lines that share a half, and
then a quarter, with another line emit all variants with one of the remaining units deleted as
hashed keys; equal variants join, the pair's edit distance is verified, and the later line
goes.  Each group of equal variants is compared with its earliest line only, which
decides for the whole group, so no group is paired with itself.

Lines of fewer than ``min_chars`` code points stay; those of fewer than ``min_units`` code
points are compared exactly only.  A line counted in words and one counted in code points are
never near each other.  Null text is empty and stays null.  Null ids come first.  Rows
that repeat wholly are treated alike.  Only built-in expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import sent, text_of
from tallyspark.llm.quality import let
from tallyspark.session import discarding, stage

MIN_CHARS, MIN_UNITS = 20, 5
#: Follows every code point that is a unit, and stands for a blank among them; no word ends so.
_MARK = "\x01"


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    # The hash and the split come before the explode, so that no row carries the whole text.
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    return (
        split.select("doc_id", "text_hash", F.posexplode("lines").alias("number", "line"))
        .filter(F.length("line") >= min_chars)
        .withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})
    )


def _words_in(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _code_points(line: Column) -> Column:
    """The line's code points as units between single blanks."""
    return F.concat(F.array_join(F.split(F.translate(line, " ", _MARK), ""), f"{_MARK} "), F.lit(_MARK))


def _in_units(line: Column, min_units: int, then) -> Column:
    """``then`` of the line written as units between single blanks; null if it has too few."""
    return (
        F.when(_words_in(line) >= min_units, then(line))
        .when(F.length(line) >= min_units, let(_code_points(line), then))
    )


def _part(line: Column, size: Column) -> Column:
    """The first ``size`` words of a line, or the last ones if negative."""
    return F.when(size == 0, F.lit("")).otherwise(F.call_function("substring_index", line, F.lit(" "), size))


def _halves(n: Column) -> Column:
    """Sizes of the halves that a line of ``n`` words may share with a line one edit away.

    Negative sizes count from the end.  Even sizes n give n/2; odd ones both neighbours, so
    that lines of n and n + 1 words have a common size.
    """
    low, high = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
    return F.when(low == high, F.array(low, -low)).otherwise(F.array(low, -low, high, -high))


def _half_keys(line: Column) -> Column:
    return let(_words_in(line), lambda n: F.transform(_halves(n), lambda k: F.xxhash64(F.signum(k), _part(line, k))))


def _quarters(line: Column) -> Column:
    """Struct of key, low and high for every half and quarter a line may share.

    ``low`` to ``high`` are the places of the words outside both.
    """

    def of_words(n: Column) -> Column:
        return F.flatten(F.transform(_halves(n), lambda half: of_half(n, half)))

    def of_half(n: Column, half: Column) -> Column:
        size = F.abs(half)
        rest = _part(line, F.when(half > 0, size - n).otherwise(n - size))
        base = F.when(half > 0, size).otherwise(0)

        def of_both(both: Column) -> Column:
            def of_quarter(quarter: Column) -> Column:
                key = F.xxhash64(F.signum(half), both["half"], F.signum(quarter), _part(both["rest"], quarter))
                low = base + F.when(quarter > 0, quarter).otherwise(0)
                high = base + (n - size) - 1 + F.when(quarter < 0, quarter).otherwise(0)
                return F.struct(key.alias("key"), low.alias("low"), high.alias("high"))

            return F.transform(_halves(n - size), of_quarter)

        return let(F.struct(F.xxhash64(_part(line, half)).alias("half"), rest.alias("rest")), of_both)

    return let(_words_in(line), of_words)


def _variants(near: DataFrame) -> DataFrame:
    """Hashed keys of the variants of the lines in ``near``: at, is_whole, key, key2, kind.

    Kind 0: one word blanked at its place; lines that share it differ in that word alone.
    Kind 1: the line without one word, or the whole line (is_whole).
    Each word is hashed with its place, so a variant is the exclusive or of its words; only
    words in one of the line's ``ranges`` are deleted.
    """
    words = near.select("at", "ranges", F.posexplode(F.split("line", " ", -1)).alias("place", "word"))
    words = words.select(
        "at", "place", F.exists("ranges", lambda r: F.col("place").between(r["low"], r["high"])).alias("free"),
        F.xxhash64("word", "place").alias("here"),
        F.xxhash64("word", F.col("place") - 1).alias("moved"),
    )
    whole = Window.partitionBy("at")
    before = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    upto = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    found = words.select(
        "at", "place", "free", "here",
        F.bit_xor("here").over(whole).alias("all_here"),
        F.bit_xor("moved").over(whole).alias("all_moved"),
        F.coalesce(F.bit_xor("here").over(before), F.lit(0).cast("bigint")).alias("start"),
        F.bit_xor("moved").over(upto).alias("moved_upto"),
        F.count("*").over(whole).cast("int").alias("n"),
    ).filter("free or place = 0")

    def key(kind: int, n: Column, place: Column, value: Column, is_whole: bool) -> Column:
        return F.struct(
            F.lit(is_whole).alias("is_whole"),
            F.xxhash64(F.lit(kind), n, place, value).alias("key"),
            F.xxhash64(value, place, n, F.lit(kind)).alias("key2"),
            F.lit(kind).alias("kind"),
        )

    here, n, free = F.col("here"), F.col("n"), F.col("free")
    tail = F.col("all_moved").bitwiseXOR(F.col("moved_upto"))
    keys = F.array(
        F.when(free, key(0, n, F.col("place"), F.col("all_here").bitwiseXOR(here), False)),
        F.when(free, key(1, n - 1, F.lit(0), F.col("start").bitwiseXOR(tail), False)),
        F.when(F.col("place") == 0, key(1, n, F.lit(0), F.col("all_here"), True)),
    )
    return found.select("at", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k")).select("at", "k.*")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by at most one replaced, inserted or missing word."""

    def shared(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(differs == 0, F.least(F.size(x), F.size(y))).otherwise(differs - 1)

    most = F.greatest(F.size(a), F.size(b))
    alike = shared(a, b) + shared(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & ((alike >= most - 1) | (a == b))


def _shared(keys: DataFrame, key: str) -> DataFrame:
    """Keys that at least two different lines have (``at`` is the place of a line's first copy)."""
    return keys.groupBy(key).agg(F.min("at").alias("a"), F.max("at").alias("b")).filter("a < b").select(key)


def _near_repeats(docs: DataFrame, first: DataFrame, min_chars: int, min_units: int) -> DataFrame:
    """First places of the lines that are one edit away from an earlier line."""
    halves = first.select("at", F.explode("halves").alias("half"))
    flagged = halves.join(_shared(halves, "half"), "half", "left_semi").select("at").distinct()
    flagged = stage(flagged.select("at.*"), "near-places")
    same = ["doc_id", "text_hash", "number"]
    texts = stage(
        _lines(docs, min_chars).select(*same, "line")
        .join(sent(flagged.select(*[F.col(c).alias(f"of_{c}") for c in same])),
              F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("text_hash") == F.col("of_text_hash"))
              & (F.col("number") == F.col("of_number")), "left_semi")
        .select(F.struct(*same).alias("at"), _in_units(F.col("line"), min_units, lambda u: u).alias("line")), "near-texts").dropDuplicates(["at"])
    quarters = stage(texts.select("at", F.explode(_quarters(F.col("line"))).alias("q")).select("at", "q.*"), "quarters")
    ranges = (
        quarters.join(_shared(quarters, "key"), "key", "left_semi")
        .groupBy("at").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    )
    near = stage(texts.join(ranges, "at"), "near-lines")
    variants = stage(_variants(near), "variants")
    groups = (
        variants.groupBy("kind", "key", "key2")
        .agg(F.min(F.when(~F.col("is_whole"), F.col("at"))).alias("cut"), F.min(F.when(F.col("is_whole"), F.col("at"))).alias("whole"),
             F.count("*").alias("members"))
        .filter("members > 1")
    )
    other = F.when((F.col("kind") == 0) | F.col("is_whole"), F.col("cut")).otherwise(F.col("whole"))
    pairs = (
        variants.join(groups, ["kind", "key", "key2"]).select("at", other.alias("by"))
        .filter(F.col("by") < F.col("at")).distinct()
    )
    left = near.select("at", "line")
    right = near.select(F.col("at").alias("by"), F.col("line").alias("by_line"))
    checked = pairs.join(left, "at").join(right, "by")
    return checked.filter(_one_edit(F.split("line", " ", -1), F.split("by_line", " ", -1))).select("at").distinct()


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_units: int = MIN_UNITS) -> DataFrame:
    """Lines to remove: doc_id, text_hash and the array of their numbers, for texts that have any.

    ``docs`` has doc_id and text (not null).
    """
    if min_units < 2:
        raise ValueError("a line must keep a unit beside the edited one")
    halves = _in_units(F.col("line"), min_units, _half_keys)
    at = F.struct("doc_id", "text_hash", "number")
    light = stage(_lines(docs, min_chars).select(at.alias("at"), "h", "h2", halves.alias("halves")), "lines")
    first = stage(
        light.groupBy("h", "h2").agg(F.min("at").alias("at"), F.max("at").alias("last"), F.first("halves").alias("halves")), "first-lines")
    near = _near_repeats(docs, first, min_chars, min_units).withColumn("near", F.lit(True))
    decided = stage(
        first.select("h", "h2", "at", "last").join(near, "at", "left")
        .filter(F.coalesce("near", F.lit(False)) | (F.col("at") < F.col("last")))
        .select("h", "h2", F.col("at").alias("kept_at"), F.coalesce("near", F.lit(False)).alias("near")), "repeats")
    return (
        light.select("h", "h2", "at").join(sent(decided), ["h", "h2"])
        .filter(F.col("near") | (F.col("kept_at") < F.col("at")))
        .groupBy("at.doc_id", "at.text_hash").agg(F.collect_set("at.number").alias("removed"))
    )


def dedup_lines(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_units: int = MIN_UNITS) -> DataFrame:
    """``row`` (a struct of the columns ``keep``), the cleaned text, n_lines and n_removed."""
    read = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    with discarding(docs.sparkSession):
        gone = stage(repeated_lines(read, min_chars, min_units), "removed", keep=True)
    gone = gone.select(
        F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "removed")
    rows = docs.select(
        F.struct(*keep).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.xxhash64(text_of(text_col)).alias("text_hash"))
    joined = rows.join(sent(gone, F.size("removed")), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    lines = F.split("text", "\n", -1)
    rest = let(lines, lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: F.get(x, i)), "\n"))
    return joined.select(
        "row",
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("bigint").alias("n_removed"),
    )


def cleaned_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                  min_units: int = MIN_UNITS) -> DataFrame:
    """doc_id, the text without repeated lines, its lines before, and how many went."""
    done = dedup_lines(docs, [id_col], id_col, text_col, min_chars, min_units)
    return done.select(F.col("row")[id_col].alias("doc_id"), "text", "n_lines", "n_removed")
