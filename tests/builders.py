"""Small fixtures: marks, scans and stars written out by hand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tallyspark import schema as S
from tallyspark.operators import ingest
from tallyspark.operators.ingest import Star


def scan(image_id: int, path: str | None = None, barcode: str | None = "1|10|2|1|1|1", error: str | None = None, page: int = 1,
         name: str | None = None) -> dict:
    path = path or f"/in/b{image_id}_c{page}.png"
    return {
        "image_id": image_id, "image_path": path, "image_name": name or path.rsplit("/", 1)[1],
        "counted_at": dt.datetime(2026, 1, 1, 12, 0, 0), "dpi": 300, "warp_dpi": 200, "page_number": page, "was_rotated": False,
        "corners_found": True, "content_width_in": 7.5, "content_height_in": 10.0, "corner_marks": None, "barcode_data": barcode,
        "error_message": error, "scribble_flagged": False, "scribble_pixels": 0, "scribble_outline_path": None,
    }


def mark(image_id: int, seq: int, name: str | None, marked: bool = True, *, contest_id: int | None = 1, title: str | None = "Mayor",
         kind: str | None = "PLURALITY", max_votes: int | None = 1, percent: float | None = 50.0, candidate_id: int | None = None,
         write_in: bool = False, **more) -> dict:
    pct = 40.0 if marked else 0.0
    row = {
        "image_id": image_id, "seq": seq, "contest_id": contest_id, "contest_title": title, "contest_type": kind, "max_votes": max_votes,
        "percent_to_win": percent, "candidate_id": seq if candidate_id is None else candidate_id, "candidate_name": name,
        "write_in": write_in, "indicator_style": "OVAL", "dark_pct": pct, "dark_pixels": int(pct), "total_pixels": 100,
        "mean_intensity": 255 - 2 * pct, "trimmed_pct": pct, "trimmed_dark": int(pct), "trimmed_total": 100,
        "trimmed_mean": 255 - 2 * pct, "zone_dark": None, "abs_left": 10 * seq, "abs_top": 5, "width": 8, "height": 6, "warp_dpi": 200,
        "image_x": 15 * seq, "image_y": 8, "threshold": 128,
    }
    row.update(more)
    return row


def _rows(spark: SparkSession, rows: list[dict], schema) -> DataFrame:
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)


def scans_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return _rows(spark, rows, S.SCAN)


def marks_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return _rows(spark, rows, S.MEASUREMENT)


def star_of(spark: SparkSession, scans: list[dict], marks: list[dict]) -> Star:
    return ingest.build_star(scans_df(spark, scans), marks_df(spark, marks))


def dicts(df: DataFrame, *keys: str) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[k]) for k in keys)) if keys else rows
