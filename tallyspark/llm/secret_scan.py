"""Secrets in texts: fixed patterns, and strings that pass a battery of randomness tests.

Patterns give the base spans.  Besides, every run of twenty or more characters of the
base-64 alphabets that mixes letters and digits is a candidate; ``=`` ends a run and belongs
to it as padding only.  A run that fits no single alphabet is cut into its longest pieces of
either base-64 alphabet and of letters and digits.  A candidate's encoding is inferred as
the smallest alphabet that holds it, and three tests ask whether it could be random in that
alphabet: chi-squared uniformity of its characters, runs above and below the middle of the
alphabet, and correlation of neighbours.  The three probabilities combine by Bonferroni.

Which candidates count as random is decided per band of length, over all texts.  Random
strings pass a limit t with probability (1 - t/3)^3, so their number follows from those above
one half; what else passes is false.  Each band takes the smallest limit, ``LEAST`` or more,
at which at most ``FALSE_SHARE`` of what passes is false.

Spans count code points, end exclusive.  A random span inside a base span or a wider random one is left out.
Null text is empty.  Repeated rows are reported each.  Only built-in expressions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import text_of
from tallyspark.llm.quality import let
from tallyspark.session import discarding, stage

KINDS = ("assign", "access", "hex", "random")
_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN_LEAST = 6
#: Runs are as long as they can be, so the least length can stand in the pattern.
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
_RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?"
#: Longest pieces of a run that no single alphabet holds.
_PIECES = (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9]{20,}")

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from small to large alphabets: pattern that holds the string, alphabet.
ENCODINGS = (
    (r"[0-9a-f]+", _DIGITS + "abcdef"),
    (r"[0-9A-F]+", _DIGITS + "ABCDEF"),
    (r"[A-Z2-7]+", _LOWER.upper() + "234567"),
    (r"[0-9a-z]+", _DIGITS + _LOWER),
    (r"[0-9A-Z]+", _DIGITS + _LOWER.upper()),
    (r"[0-9A-Za-z]+", _LOWER.upper() + _LOWER + _DIGITS),
    (r"[0-9A-Za-z+/]+", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    (r"[0-9A-Za-z_-]+", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
)
BANDS = (20, 24, 32, 48, 64, 128)
FALSE_SHARE = 0.1
LEAST = 0.001
_GRID = 100


def _tail(z: Column) -> Column:
    """Probability that a standard normal value is above ``z`` (rational approximation)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def randomness(body: Column, alphabet: Column) -> Column:
    """Combined probability of the three tests that ``body`` is random in ``alphabet``."""
    size = F.length(alphabet).cast("double")
    length = F.length(body).cast("double")

    def of_places(v: Column) -> Column:
        squares = F.aggregate(
            F.transform(F.split(alphabet, ""), lambda c: length - F.length(F.replace(body, c, F.lit("")))),
            F.lit(0.0), lambda total, n: total + n * n)
        chi = squares * size / length - length
        ratio = 2 / (9 * (size - 1))
        p_chi = _tail((F.pow(chi / (size - 1), F.lit(1 / 3)) - (1 - ratio)) / F.sqrt(ratio))

        above = F.transform(v, lambda x: x >= size / 2)
        n1 = F.size(F.filter(above, lambda x: x)).cast("double")
        n2 = length - n1
        pairs = F.zip_with(F.slice(above, 1, F.size(v) - 1), F.slice(above, 2, F.size(v) - 1), lambda a, b: a != b)
        runs = 1.0 + F.size(F.filter(pairs, lambda x: x))
        mean = 2 * n1 * n2 / length + 1
        spread = (mean - 1) * (mean - 2) / (length - 1)
        p_runs = F.when(spread > 0, 2 * _tail(F.abs(runs - mean) / F.sqrt(spread))).otherwise(0.0)

        centre = F.aggregate(v, F.lit(0.0), lambda total, x: total + x) / length
        p_serial = let(F.transform(v, lambda x: x - centre), lambda d: let(
            F.aggregate(d, F.lit(0.0), lambda total, x: total + x * x), lambda own: F.when(
                own > 0,
                2 * _tail(F.abs(1 / F.sqrt(length) + F.sqrt(length) / own * F.aggregate(
                    F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d) - 1), lambda a, b: a * b),
                    F.lit(0.0), lambda total, x: total + x)))).otherwise(0.0)))
        return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

    return let(F.transform(F.split(body, ""), lambda c: F.instr(alphabet, c) - 1.0), of_places)


def _alphabet(body: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, alphabet in reversed(ENCODINGS):
        out = F.when(body.rlike(f"^(?:{pattern})$"), F.lit(alphabet)).otherwise(out)
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    return F.when(mixed, out)


def _pieces(body: Column) -> Column:
    """Distinct (skip, piece) of a run: characters before the piece, and the piece."""

    def of(pattern: str) -> Column:
        lengths = F.transform(F.split(body, pattern, -1), lambda g: F.length(g))
        return let(F.regexp_extract_all(body, F.lit(pattern), 0), lambda found: let(lengths, lambda gaps: F.transform(
            found, lambda piece, i: F.struct(
                (F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda total, n: total + n)
                 + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda total, m: total + F.length(m))).alias("skip"),
                piece.alias("piece")))))

    mixed = body.rlike("[+/]") & body.rlike("[_-]")
    whole = F.array(F.struct(F.lit(0).alias("skip"), body.alias("piece")))
    return F.when(mixed, F.array_distinct(F.concat(*[of(p) for p in _PIECES]))).otherwise(whole)


def _found(text: Column, kind: str, pattern: str, hint: str, usable: Column | None = None) -> Column:
    """Matches in order: length before it since the last one, its length, whether it counts, its string."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    counts = usable if usable is not None else F.transform(matches, lambda m: F.lit(True))
    zipped = F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("gap"), counts.alias("ok"))
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,ok:boolean,body:string>>")
    number = KINDS.index(kind)
    body = (lambda m: m) if kind == "random" else (lambda m: F.lit(None).cast("string"))
    rows = F.transform(zipped, lambda z: F.struct(
        F.lit(number).alias("kind"), z["gap"].alias("gap"), F.length(z["m"]).alias("len"), z["ok"].alias("ok"),
        body(z["m"]).alias("body")))
    return F.when(text.rlike(hint), rows).otherwise(none)


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a number each, and the places of all matches and candidates."""
    text = F.col("text")
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(_ASSIGN), 2), lambda g: F.length(g) >= _ASSIGN_LEAST)
    found = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id",
            _found(text, "assign", _ASSIGN, _KEYWORD, long_enough).alias("assign"),
            _found(text, "access", _ACCESS, _ACCESS).alias("access"),
            _found(text, "hex", _HEX, _HEX).alias("hex"),
            _found(text, "random", _RANDOM, _RANDOM).alias("random"),
        ),
        "secret-matches",
    )
    each = found.select("row", F.explode(F.array("assign", "access", "hex", "random")).alias("group"))
    each = each.select("row", F.posexplode("group").alias("number", "m")).select("row", "number", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("number")
    body = F.rtrim(F.col("body"), F.lit("="))
    placed = each.select(
        "row", "kind", "ok", F.sum(F.col("gap").cast("bigint") + F.col("len")).over(upto).alias("end"), "len", body.alias("body"))
    placed = placed.select("row", "kind", "ok", (F.col("end") - F.col("len")).alias("start"), "end", "body", F.length("body").alias("run"),
                           F.explode(_pieces(F.col("body"))).alias("part"))
    stop = F.col("part.skip") + F.length("part.piece")
    placed = placed.select(
        "row", "kind", "ok", (F.col("start") + F.coalesce("part.skip", F.lit(0))).alias("start"),
        F.when(stop < F.col("run"), F.col("start") + stop).otherwise(F.col("end")).alias("end"),
        F.col("part.piece").alias("body"))
    placed = placed.select(
        "row", "kind", "ok", "start", "end", F.length("body").alias("size"), "body",
        _alphabet(F.col("body")).alias("alphabet"))
    long_body = F.col("alphabet").isNotNull() & (F.col("size") >= BANDS[0])
    band = sum((F.when(F.col("size") >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))
    spans = stage(
        placed.select("row", "kind", "ok", "start", "end", F.when(long_body, band).alias("band"),
                      F.when(long_body, randomness(F.col("body"), F.col("alphabet"))).alias("p")),
        "secret-spans",
    )
    return found.select("row", "doc_id"), spans.filter((F.col("kind") < 3) & F.col("ok") | F.col("p").isNotNull())


def limits(spans: DataFrame) -> DataFrame:
    """Per band of length, the least probability that counts as random (one row per band)."""
    cells = spans.filter(F.col("p") >= LEAST).groupBy("band", F.floor(F.col("p") * _GRID).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("band").orderBy(F.desc("cell")))
    # A cell without strings needs no row: the limit can only fall where strings are.
    passing = cells.select("band", "cell", above.alias("passing"))
    half = cells.groupBy("band").agg(F.sum(F.when(F.col("cell") >= _GRID // 2, F.col("n")).otherwise(0)).alias("half"))
    t = F.col("cell") / F.lit(float(_GRID))
    random = F.col("half") / (1 - 0.5 / 3) ** 3 * F.pow(1 - t / 3, F.lit(3))
    fine = (F.col("cell") >= _GRID // 2) | (F.col("passing") - random <= FALSE_SHARE * F.col("passing"))
    return passing.join(half, "band").filter(fine).groupBy("band").agg(F.greatest(F.min("cell") / F.lit(float(_GRID)), F.lit(LEAST)).alias("limit"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ``spans``, an array of (start, kind, end) in order of start and kind.

    ``kind`` is the index in ``KINDS``.  What is written on the way holds candidates in clear
    and is deleted before this returns; the result has places only.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    with discarding(docs.sparkSession):
        return stage(_scanned(docs), "secrets", keep=True)


def _scanned(docs: DataFrame) -> DataFrame:
    rows, spans = _spans(docs)
    limit = stage(limits(spans), "secret-limits").withColumnRenamed("band", "of_band")
    wide = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Only base spans that start no later can hold a random one; those that start with it sort first.
    reach = F.coalesce(F.max(F.when(F.col("kind") < 3, F.col("end"))).over(wide), F.lit(-1))
    random = F.col("kind") == 3
    kept = (
        spans.join(limit, F.col("band") == F.col("of_band"), "left")
        .filter(~random | (F.col("p") >= F.col("limit")))
        .select("row", "kind", "start", "end", reach.alias("reach"))
        .filter(~random | (F.col("end") > F.col("reach")))
    )
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = F.coalesce(F.max(F.when(random, F.col("end"))).over(before), F.lit(-1))
    kept = kept.select("row", "kind", "start", "end", outer.alias("outer")).filter(~random | (F.col("end") > F.col("outer")))
    listed = kept.groupBy(F.col("row").alias("of_row")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.join(listed, F.col("row") == F.col("of_row"), "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
