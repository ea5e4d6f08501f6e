"""Several counting stations merged into one star.

Keys are remapped set-wise: every dimension and image row learns which station's
row survives for its natural key, and facts follow their keys.  A natural key
occurs at most once per station, so the windows below never see more rows per key
than there are stations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import text
from tallyspark.operators import reports
from tallyspark.operators.ingest import Star
from tallyspark.session import stage

@dataclass(frozen=True)
class Stations:
    """The tables of all stations, one below the other, with ``station_no``: a row's station
    as its place in ``labels``.  However many there are, a table is one scan."""

    tables: Star
    labels: tuple[str, ...]


StationList = Sequence[tuple[str, Star]]


@dataclass(frozen=True)
class Merged:
    """The merged star, and what was left out: per station and kind."""

    star: Star
    rejects: DataFrame


def stack(stations: StationList | Stations) -> Stations:
    """Stations that are given one by one, as one set; a set stays as it is."""
    if isinstance(stations, Stations):
        return stations
    if not stations:
        raise ValueError("no stations to merge")
    tables = {}
    for number, (_, star) in enumerate(stations):
        for name, rows in star.tables().items():
            rows = rows.withColumn("station_no", F.lit(number))
            tables[name] = tables[name].unionByName(rows) if name in tables else rows
    return Stations(Star(**tables), tuple(label for label, _ in stations))


def _shift(stacked: DataFrame) -> Column:
    """Amount added to a station's ids: the highest ids of the stations before it."""
    highest = {r["station_no"]: r["top"] for r in stacked.groupBy("station_no").agg(F.max("id").alias("top")).collect()}
    shifts, total = [], 0
    for number in range(max(highest, default=-1) + 1):
        shifts.append(total)
        total += highest.get(number, 0)
    return F.get(F.lit(shifts).cast("array<bigint>"), F.col("home_no"))


def _resolve(stacked: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``new_id`` and ``survives``: the first station that has a key keeps the row."""
    first = Window.partitionBy(*keys).orderBy("station_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    homed = stacked.withColumns(
        {"home_no": F.first("station_no").over(first), "home_id": F.first("id").over(first)}
    )
    return (
        homed.withColumn("new_id", F.col("home_id") + _shift(stacked))
        .withColumn("survives", F.col("home_no") == F.col("station_no"))
        .drop("home_no", "home_id")
    )


def _survivors(resolved: DataFrame, columns: list[str]) -> DataFrame:
    kept = resolved.filter("survives").withColumn("id", F.col("new_id"))
    return kept.select(*columns)


def _mapping(resolved: DataFrame, old: str, new: str, *more: str) -> DataFrame:
    return resolved.select("station_no", F.col("id").alias(old), F.col("new_id").alias(new), *more)


def _own_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c != "station_no"]


def merge_stations(stations: StationList | Stations, on_duplicate_image: str = "skip") -> Merged:
    """Union of the stations with duplicates resolved; the first station wins.

    An image scanned at two stations is kept once.  ``skip`` also leaves out the
    later station's votes for it; ``append`` adds them to the surviving image,
    which counts the ballot twice.  All columns are carried over, and images
    without a barcode stay.
    """
    if on_duplicate_image not in ("skip", "append"):
        raise ValueError("on_duplicate_image must be 'skip' or 'append'")
    all_of = stack(stations).tables
    codes = stage(_resolve(all_of.barcode, ["raw_data"]), "barcodes")
    contests = stage(_resolve(all_of.contest, ["contest_title", "contest_type"]), "contests")
    contest_map = _mapping(contests, "contest_id", "new_contest")
    names = all_of.candidate.join(contest_map, ["station_no", "contest_id"])
    candidates = stage(
        _resolve(names.drop("contest_id").withColumnRenamed("new_contest", "contest_id"), ["contest_id", "candidate_name"]),
        "candidates",
    )
    images = stage(_resolve(all_of.ballot_image, ["image_path"]), "images")
    merged_images = _remap_barcode(images.filter("survives"), codes).withColumn("id", F.col("new_id")).select(
        *_own_columns(all_of.ballot_image)
    )
    # The surviving image's barcode is looked up per image, so that the facts move once.
    codes_of = merged_images.select(F.col("id").alias("new_image"), "barcode_id")
    image_map = _mapping(images, "ballot_image_id", "new_image", "survives").join(codes_of, "new_image", "left")

    facts = (
        all_of.vote_opportunity
        .drop("barcode_id")
        .join(image_map, ["station_no", "ballot_image_id"], "left")
        .join(contest_map, ["station_no", "contest_id"], "left")
        .join(_mapping(candidates, "candidate_id_fk", "new_candidate"), ["station_no", "candidate_id_fk"], "left")
    )
    mapped = F.col("new_image").isNotNull() & F.col("new_contest").isNotNull() & F.col("new_candidate").isNotNull()
    usable = mapped if on_duplicate_image == "append" else mapped & F.col("survives")
    moved = facts.filter(usable).withColumns(
        {"ballot_image_id": F.col("new_image"), "contest_id": F.col("new_contest"), "candidate_id_fk": F.col("new_candidate")}
    )
    star = Star(
        _survivors(codes, _own_columns(all_of.barcode)),
        merged_images,
        _survivors(contests, _own_columns(all_of.contest)),
        _survivors(candidates, _own_columns(all_of.candidate)),
        moved.select(*_own_columns(all_of.vote_opportunity)),
    )
    duplicates = images.filter(~F.col("survives")).groupBy("station_no").agg(F.count("*").alias("n"))
    unmapped = facts.filter(~mapped).groupBy("station_no").agg(F.count("*").alias("n"))
    rejects = duplicates.withColumn("kind", F.lit("duplicate_image")).unionByName(
        unmapped.withColumn("kind", F.lit("unmapped_fact"))
    )
    return Merged(star, rejects)


def _remap_barcode(images: DataFrame, codes: DataFrame) -> DataFrame:
    code_map = _mapping(codes, "barcode_id", "new_barcode")
    return (
        images.join(code_map, ["station_no", "barcode_id"], "left")
        .drop("barcode_id")
        .withColumnRenamed("new_barcode", "barcode_id")
    )


def _label(stations: Stations) -> Column:
    return F.get(F.lit(list(stations.labels)), F.col("station_no"))


def _votes(stations: Stations) -> DataFrame:
    """Voted and overvoted per station number, contest and candidate, counted by key before any name."""
    tables = stations.tables
    contests = tables.contest.select("station_no", F.col("id").alias("contest_id"), F.col("contest_title").alias("contest"))
    names = tables.candidate.select("station_no", F.col("id").alias("candidate_id_fk"), F.col("candidate_name").alias("candidate"))
    counted = reports.count_by_keys(tables.vote_opportunity, "station_no", "contest_id", "candidate_id_fk")
    named = counted.join(contests, ["station_no", "contest_id"]).join(names, ["station_no", "candidate_id_fk"])
    return named.groupBy("station_no", "contest", "candidate").agg(
        F.sum("voted").alias("voted"), F.sum("overvoted").alias("overvoted"))


def station_votes(stations: StationList | Stations) -> DataFrame:
    """Voted and overvoted per station, contest and candidate."""
    stations = stack(stations)
    return _votes(stations).select(_label(stations).alias("station"), "contest", "candidate", "voted", "overvoted")


def station_totals(stations: StationList | Stations) -> DataFrame:
    """The same, with the number of images of the station."""
    stations = stack(stations)
    images = stations.tables.ballot_image.groupBy("station_no").agg(F.count("*").alias("images"))
    return _votes(stations).join(images, "station_no", "left").select(
        _label(stations).alias("station"), "contest", "candidate", "voted", "overvoted",
        F.coalesce("images", F.lit(0)).alias("ballot_images"))


def compare_stations(stations: StationList | Stations) -> DataFrame:
    """Contest and candidate with a column per station and the sum; absent counts as 0."""
    stations = stack(stations)
    labels = stations.labels
    wide = station_votes(stations).groupBy("contest", "candidate").pivot("station", list(labels)).agg(
        F.sum("voted").alias("voted"), F.sum("overvoted").alias("overvoted")
    )
    filled = wide.na.fill(0)
    for kind in ("voted", "overvoted"):
        total = sum((F.col(f"`{label}_{kind}`") for label in labels), F.lit(0))
        filled = filled.withColumn(f"merged_{kind}", total.cast("bigint"))
    return filled


def export_rows(stations: StationList | Stations) -> DataFrame:
    """Detail rows per station and a SUM row per contest, base name and rank.

    Rows are laid out from the wide comparison, so no keys are crossed with stations.
    """
    stations = stack(stations)
    labels = stations.labels

    def row(kind: str, source: str, column: str, place: int) -> Column:
        return F.struct(
            F.lit(kind).alias("row_type"), F.lit(source).alias("source"),
            F.col(f"`{column}_voted`").alias("votes"), F.col(f"`{column}_overvoted`").alias("overvotes"),
            F.lit(place).alias("place"),
        )

    lines = [row("Detail", f"DB {i + 1}", label, i) for i, label in enumerate(labels)]
    lines.append(row("SUM", f"SUM (DB 1–{len(labels)})", "merged", len(labels)))
    ranked = F.col("candidate").rlike(text.RANK_LOOSE)
    base = F.when(ranked, F.trim(F.regexp_extract("candidate", text.RANK_LOOSE, 1))).otherwise(F.col("candidate"))
    rank = F.when(ranked, F.regexp_extract("candidate", text.RANK_LOOSE, 2)).otherwise("")
    return (
        compare_stations(stations)
        .select("contest", F.col("candidate").alias("full_name"), base.alias("candidate"), rank.alias("rank"),
                F.inline(F.array(*lines)))
        .select("row_type", "contest", "candidate", "rank", "source", "votes", "overvotes", "full_name", "place")
    )


def write_export(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    ordered = rows.orderBy("contest", "full_name", "place").drop("full_name", "place")
    ordered.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def merge_log(stations: StationList | Stations, merged: Merged) -> DataFrame:
    """Duplicate images and unmapped facts per station, for stations that had any."""
    counted = merged.rejects.groupBy("station_no").pivot("kind", ["duplicate_image", "unmapped_fact"]).agg(F.sum("n"))
    return counted.na.fill(0).select(
        _label(stack(stations)).alias("station"),
        F.col("duplicate_image").alias("duplicate_images"),
        F.col("unmapped_fact").alias("unmapped_facts"),
    )
