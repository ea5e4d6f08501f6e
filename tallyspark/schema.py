"""Fixed table schemas.  Spark does not enforce nullability on read; ingest does."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


_LONG, _INT, _STR = T.LongType(), T.IntegerType(), T.StringType()
_DBL, _BOOL = T.DoubleType(), T.BooleanType()

# The vocabularies of the data model.
VOTE_STATUSES = ("UNMARKED", "VOTED", "OVERVOTED")
CONTEST_TYPES = ("PLURALITY", "RANKED_CHOICE", "APPROVAL", "MEASURE")
REGION_TYPES = ("SINGLE_PRECINCT", "PRECINCT_GROUP")
UNREAD_BARCODE = "(not decoded)"
UNKNOWN = "(unknown)"

# Defaults used where a source leaves a setting out.
DEFAULT_CONTEST_TYPE = "PLURALITY"
DEFAULT_MAX_VOTES = 1
DEFAULT_PERCENT_TO_WIN = 50.0
DEFAULT_INDICATOR_STYLE = "OVAL"
DEFAULT_DARK_PCT_MIN = 8.0
DEFAULT_DARK_THRESHOLD = 128
DEFAULT_REVIEW_LIMIT = 10
DEFAULT_SNAPSHOT_INTERVAL = 500

BARCODE = _struct(
    ("id", _LONG, False),
    ("raw_data", _STR, False),
    ("jurisdiction_id", _STR, True),
    ("region_id", _STR, True),
    ("party_id", _STR, True),
    ("ballot_type_id", _STR, True),
    ("election_id", _STR, True),
    ("page_number", _STR, True),
)

BALLOT_IMAGE = _struct(
    ("id", _LONG, False),
    ("image_path", _STR, False),
    ("image_name", _STR, False),
    ("counted_at", T.TimestampNTZType(), True),
    ("dpi", _INT, True),
    ("page_number", _INT, True),
    ("was_rotated", _BOOL, True),
    ("corners_found", _BOOL, True),
    ("warp_dpi", _INT, True),
    ("canonical_width", _INT, True),
    ("canonical_height", _INT, True),
    ("corner_marks", _STR, True),
    ("scribble_flagged", _BOOL, True),
    ("scribble_pixels", _INT, True),
    ("scribble_outline_path", _STR, True),
    ("barcode_id", _LONG, True),
)

CONTEST = _struct(
    ("id", _LONG, False),
    ("contest_title", _STR, False),
    ("contest_type", _STR, False),
    ("max_votes", _INT, True),
    ("percent_to_win", _DBL, True),
)

CANDIDATE = _struct(
    ("id", _LONG, False),
    ("contest_id", _LONG, False),
    ("candidate_name", _STR, False),
    ("ballot_candidate_id", _LONG, True),
    ("write_in", _BOOL, True),
)


# ``seq`` is the marking's place on its image; with the image id it is the row's key, so no
# global numbering of the facts is needed.  ``barcode_id`` is carried from the image so that
# precinct and party reports never join the image table.
VOTE_OPPORTUNITY = _struct(
    ("ballot_image_id", _LONG, False),
    ("seq", _LONG, False),
    ("contest_id", _LONG, False),
    ("candidate_id_fk", _LONG, False),
    ("barcode_id", _LONG, True),
    ("abs_left", _INT, True),
    ("abs_top", _INT, True),
    ("indicator_width", _INT, True),
    ("indicator_height", _INT, True),
    ("warp_dpi", _INT, True),
    ("image_x", _INT, True),
    ("image_y", _INT, True),
    ("threshold", _INT, True),
    ("dark_pct", _DBL, True),
    ("dark_pixels", _INT, True),
    ("total_pixels", _INT, True),
    ("mean_intensity", _DBL, True),
    ("vote_status", _STR, False),
)


RESULT_TABLES = ("barcode", "ballot_image", "contest", "candidate", "vote_opportunity")

# One row per scanned image, as delivered by the scanner.
SCAN = _struct(
    ("image_id", _LONG, False),
    ("image_path", _STR, False),
    ("image_name", _STR, False),
    ("counted_at", T.TimestampNTZType(), True),
    ("dpi", _INT, True),
    ("warp_dpi", _INT, True),
    ("page_number", _INT, True),
    ("was_rotated", _BOOL, True),
    ("corners_found", _BOOL, True),
    ("content_width_in", _DBL, True),
    ("content_height_in", _DBL, True),
    ("corner_marks", _STR, True),
    ("barcode_data", _STR, True),
    ("error_message", _STR, True),
    ("scribble_flagged", _BOOL, True),
    ("scribble_pixels", _INT, True),
    ("scribble_outline_path", _STR, True),
)


# One row per measured indicator box: the input contract of ingest.
MEASUREMENT = _struct(
    ("image_id", _LONG, False),
    ("seq", _LONG, False),
    ("contest_id", _LONG, True),
    ("contest_title", _STR, True),
    ("contest_type", _STR, True),
    ("max_votes", _INT, True),
    ("percent_to_win", _DBL, True),
    ("candidate_id", _LONG, True),
    ("candidate_name", _STR, True),
    ("write_in", _BOOL, True),
    ("indicator_style", _STR, True),
    ("dark_pct", _DBL, True),
    ("dark_pixels", _INT, True),
    ("total_pixels", _INT, True),
    ("mean_intensity", _DBL, True),
    ("trimmed_pct", _DBL, True),
    ("trimmed_dark", _INT, True),
    ("trimmed_total", _INT, True),
    ("trimmed_mean", _DBL, True),
    ("zone_dark", _INT, True),
    ("abs_left", _INT, True),
    ("abs_top", _INT, True),
    ("width", _INT, True),
    ("height", _INT, True),
    ("warp_dpi", _INT, True),
    ("image_x", _INT, True),
    ("image_y", _INT, True),
    ("threshold", _INT, True),
)


LAYOUT_ROW = _struct(
    ("source_file", _STR, True),
    ("file_name", _STR, True),
    ("page_number", _INT, True),
    ("content_left", _DBL, True),
    ("content_top", _DBL, True),
    ("content_width", _DBL, True),
    ("content_height", _DBL, True),
    ("barcode_x", _DBL, True),
    ("barcode_y", _DBL, True),
    ("corner_marks", T.ArrayType(T.ArrayType(_DBL)), True),
    ("page_marks", T.ArrayType(T.ArrayType(_DBL)), True),
    ("contest_pos", _INT, True),
    ("contest_id", _LONG, True),
    ("contest_title", _STR, True),
    ("contest_type", _STR, True),
    ("max_votes", _INT, True),
    ("percent_to_win", _DBL, True),
    ("contest_left", _DBL, True),
    ("contest_top", _DBL, True),
    ("contest_width", _DBL, True),
    ("contest_height", _DBL, True),
    ("candidate_pos", _INT, True),
    ("candidate_id", _LONG, True),
    ("candidate_name", _STR, True),
    ("write_in", _BOOL, True),
    ("indicator_left", _DBL, True),
    ("indicator_top", _DBL, True),
    ("indicator_width", _DBL, True),
    ("indicator_height", _DBL, True),
    ("indicator_style", _STR, True),
)

AUDIT_EVENT = _struct(
    ("event_time", _STR, False),
    ("event", _STR, False),
    ("username", _STR, True),
    ("detail", _STR, True),
)

_GT_INDICATOR = _struct(
    ("contest", _STR, True),
    ("candidate", _STR, True),
    ("contestType", _STR, True),
    ("maxVotes", _INT, True),
    ("writeIn", _BOOL, True),
    ("indicatorStyle", _STR, True),
    ("x", _INT, True),
    ("y", _INT, True),
    ("w", _INT, True),
    ("h", _INT, True),
    ("action", _STR, True),
    ("counted_as", _STR, True),
)

GROUND_TRUTH_IMAGE = _struct(
    ("combo_id", _STR, True),
    ("precinct", _STR, True),
    ("party", _STR, True),
    ("scenario", _STR, True),
    ("yaml_source", _STR, True),
    ("distortion", _STR, True),
    ("copy", _INT, True),
    ("source_png", _STR, True),
    ("indicators", T.ArrayType(_GT_INDICATOR), True),
)
