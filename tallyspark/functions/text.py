"""String columns: barcode fields, rank suffixes, escaping, globbing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a rank is written into a candidate name, per place of use.
RANK_FULL = r"^(.+?)\s+\(Rank\s+(\d+)\)$"      # tabulation: the whole name must fit
RANK_FIND = r"\(Rank (\d+)\)$"                 # ingest, audit, review: one space
RANK_STRIP = r"\s*\(Rank \d+\)$"               # reports: what to cut from the name
RANK_LOOSE = r"^(.+?)\s*\(Rank\s*(\d+)\)$"     # station exports: spaces are optional
NO_RANK = 99
BARCODE_FIELDS = (
    "jurisdiction_id",
    "region_id",
    "party_id",
    "ballot_type_id",
    "election_id",
    "page_number",
)
PAGE_SUFFIX = r"_c\d+\.png.*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_int(c: Column | str) -> Column:
    """Integer of a text made of digits and an optional sign; null otherwise."""
    text = _col(c)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def parse_barcode(raw: Column | str) -> Column:
    """Six nullable text fields; empty middle and trailing fields stay empty."""
    parts = F.split(F.coalesce(_col(raw), F.lit("")), r"\|", -1)
    return F.struct(*[F.get(parts, i).alias(name) for i, name in enumerate(BARCODE_FIELDS)])


def barcode_page(raw: Column | str) -> Column:
    """Page number in the sixth field, 1 when absent or not a number."""
    field = F.get(F.split(_col(raw), r"\|", -1), 5)
    return F.coalesce(strict_int(field), F.lit(1))


def encode_barcode(*fields: Column) -> Column:
    return F.concat_ws("|", *[f.cast("string") for f in fields])


def rank_of(name: Column | str, pattern: str = RANK_FIND, group: int = 1) -> Column:
    """Rank written in a candidate name, null when there is none."""
    return F.regexp_extract(_col(name), pattern, group).try_cast("int")


def rank_or_last(name: Column | str) -> Column:
    return F.coalesce(rank_of(name), F.lit(NO_RANK))


def ranked_base(name: Column | str) -> Column:
    """Base name under the tabulation pattern, null for an unranked name."""
    text = _col(name)
    return F.when(text.rlike(RANK_FULL), F.trim(F.regexp_extract(text, RANK_FULL, 1)))


def parse_rank(name: Column | str) -> Column:
    """Report view of a name: base, rank, label and whether it is ranked at all."""
    text = _col(name)
    ranked = F.coalesce(text.rlike(RANK_FIND), F.lit(False))
    return F.struct(
        F.when(ranked, F.regexp_replace(text, RANK_STRIP, "")).otherwise(text).alias("base_name"),
        F.when(ranked, rank_of(text)).alias("rank"),
        F.when(ranked, F.concat(F.lit("Rank "), F.regexp_extract(text, RANK_FIND, 1))).alias("rank_label"),
        ranked.alias("ranked_choice"),
    )


def is_blank(c: Column | str) -> Column:
    text = _col(c)
    return text.isNull() | text.rlike(r"^\s*$")


def blank_to(c: Column | str, default: str) -> Column:
    """Original text, or ``default`` when it is null or only white space."""
    return F.when(is_blank(c), F.lit(default)).otherwise(_col(c))


def csv_escape(c: Column | str) -> Column:
    text = F.coalesce(_col(c), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def html_escape(c: Column | str) -> Column:
    text = F.coalesce(_col(c), F.lit(""))
    # The four characters that are escaped.
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def yaml_escape(c: Column | str) -> Column:
    text = F.coalesce(_col(c), F.lit(""))
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def glob_to_regex(pattern: str) -> str:
    """Regex for a file glob: ``*`` and ``?`` are wild, a dot is itself, case is folded."""
    wild = {".": "[.]", "*": ".*", "?": "."}
    return "".join(wild.get(ch, ch) for ch in pattern.lower())
