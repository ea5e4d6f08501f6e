"""Statistics of rectified pixels: dark share per box and ink no earlier ballot had.

Pixels come as rows ``(image_id, barcode, seq, x, y, lum)``.  Pages of one barcode
share a layout, and ``seq`` is the scan order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.schema import DEFAULT_DARK_THRESHOLD
from tallyspark.session import stage

# Defaults of stray-ink detection.
DILATION_IN = 0.0625
INDICATOR_PAD_IN = 0.125
FLAG_PIXELS = 50
CLUSTER_MIN_PIXELS = 8


def dark_mask(pixels: DataFrame, threshold: int = DEFAULT_DARK_THRESHOLD) -> DataFrame:
    return pixels.filter(F.col("lum") < threshold)


# --- box samples -------------------------------------------------------------


def box_cells(boxes: DataFrame) -> DataFrame:
    """Every pixel position a box looks at, with the samples it belongs to.

    Bounded by the printed area of the layouts, however many ballots are scanned.
    ``boxes``: barcode, box_id, style, left, top, width, height; where page_width and
    page_height are given, boxes are clipped to the page.
    """
    def bound(name: str) -> Column:
        return F.col(name) if name in boxes.columns else F.lit(None).cast("int")

    def edge(start: str, size: str, page: Column) -> Column:
        return F.least(F.col(start) + F.col(size), F.coalesce(page, F.col(start) + F.col(size)))

    framed = boxes.withColumns(
        {
            "x0": F.greatest(F.lit(0), F.col("left")),
            "y0": F.greatest(F.lit(0), F.col("top")),
            "x1": edge("left", "width", bound("page_width")),
            "y1": edge("top", "height", bound("page_height")),
            # Arrow: a zone around the centre.  Connect-dots: a centred vertical stripe.
            "ax": F.expr("left + width div 2"),
            "ay": F.expr("top + height div 2"),
            "ahw": F.expr("greatest(1, width div 8)"),
            "ahh": F.expr("greatest(1, height div 8)"),
            "sw": F.expr("greatest(1, width div 10)"),
        }
    ).withColumn("sx", F.expr("greatest(0, left + (width - sw) div 2)"))
    xs = F.expr("sequence(greatest(0, least(left, ax - ahw)), cast(greatest(x1, ax + ahw, left) as int))")
    ys = F.expr("sequence(greatest(0, least(top, ay - ahh)), cast(greatest(y1, ay + ahh, top) as int))")
    spots = framed.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))
    x, y = F.col("x"), F.col("y")
    style = F.upper("style")
    in_box = (x >= F.col("x0")) & (x < F.col("x1")) & (y >= F.col("y0")) & (y < F.col("y1"))
    in_trim = (x > F.col("x0")) & (x < F.col("x1") - 1) & (y > F.col("y0")) & (y < F.col("y1") - 1)
    arrow = (F.abs(x - F.col("ax") + 0.5) < F.col("ahw")) & (F.abs(y - F.col("ay") + 0.5) < F.col("ahh"))
    stripe = (x >= F.col("sx")) & (x < F.col("sx") + F.col("sw")) & in_box
    zone = F.when(style == "ARROW", arrow).when(style == "CONNECT_DOTS", stripe).otherwise(F.lit(False))
    return (
        spots.select("barcode", "box_id", "x", "y", in_box.alias("in_box"), in_trim.alias("in_trim"), zone.alias("in_zone"))
        .filter("in_box OR in_zone")
    )


def sample_regions(pixels: DataFrame, images: DataFrame, boxes: DataFrame,
                   threshold: int = DEFAULT_DARK_THRESHOLD) -> DataFrame:
    """Dark, total and mean per image and box, for the box and for its trimmed inside.

    Boxes are laid out as positions and pixels find theirs by equality, so no
    pixel is ever compared with boxes it is not in.  The positions are a written
    table; while it is small Spark ships it to the pixels and nothing is shuffled
    but the sums.  A box no pixel falls in is empty: 0 % dark, white.
    """
    cells = stage(box_cells(boxes), "cells")
    dark = F.col("lum") < threshold
    sums = (
        pixels.select("image_id", "barcode", "x", "y", "lum")
        .join(cells, ["barcode", "x", "y"])
        .groupBy("image_id", "box_id")
        .agg(
            F.count_if("in_box").alias("total"),
            F.count_if(F.col("in_box") & dark).alias("dark"),
            F.sum(F.when(F.col("in_box"), F.col("lum"))).alias("lum_sum"),
            F.count_if("in_trim").alias("t_total"),
            F.count_if(F.col("in_trim") & dark).alias("t_dark"),
            F.sum(F.when(F.col("in_trim"), F.col("lum"))).alias("t_sum"),
            F.count_if(F.col("in_zone") & dark).alias("zone_dark"),
        )
    )
    every_box = images.select("image_id", "barcode").join(boxes, "barcode")
    return _samples(every_box.join(sums, ["image_id", "box_id"], "left"))


def _samples(boxes: DataFrame) -> DataFrame:
    """The measured columns from boxes of images with their sums; no sums mean no pixel."""
    zero = F.lit(0).cast("bigint")

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), zero).cast("int")

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.lit(100.0) * F.col(part) / F.col(whole)).otherwise(0.0)

    stripe = F.expr("greatest(1, width div 10)") * F.col("height")
    dots = F.upper("style") == "CONNECT_DOTS"
    return boxes.select(
        "image_id", "box_id", F.col("style").alias("indicator_style"),
        count("dark").alias("dark_pixels"),
        F.when(dots, stripe.cast("int")).otherwise(count("total")).alias("total_pixels"),
        share("dark", "total").alias("dark_pct"),
        F.when(F.col("total") > 0, F.col("lum_sum") / F.col("total")).otherwise(255.0).alias("mean_intensity"),
        count("t_dark").alias("trimmed_dark"),
        count("t_total").alias("trimmed_total"),
        share("t_dark", "t_total").alias("trimmed_pct"),
        F.when(F.col("t_total") > 0, F.col("t_sum") / F.col("t_total")).otherwise(255.0).alias("trimmed_mean"),
        count("zone_dark").alias("zone_dark"),
    )


# --- stray ink ---------------------------------------------------------------


def first_dark(dark: DataFrame) -> DataFrame:
    """The first ballot that is dark at each position of each barcode.

    This is all stray-ink detection needs to remember: its size is the printed
    page, not the number of ballots.
    """
    first = dark.groupBy("barcode", "x", "y").agg(F.min(F.struct("seq", "image_id")).alias("first"))
    return first.select("barcode", "x", "y", "first.seq", "first.image_id")


def novel_positions(first: DataFrame, radius: int) -> DataFrame:
    """Positions whose first ink has no earlier ink within the square radius.

    A pixel can only be novel on the ballot that darkened its position first, so the
    answer follows from ``first_dark`` alone.  The square is dilated in two passes:
    copies along y reduced by a minimum, then a sliding minimum along x, whose
    partitions are single pixel rows of one page.
    """
    if radius <= 0:
        return first
    spread = first.withColumn("dy", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).groupBy(
        "barcode", "x", (F.col("y") + F.col("dy")).alias("y")
    ).agg(
        F.min("seq").alias("column_min"),
        F.min(F.when(F.col("dy") == 0, F.col("seq"))).alias("seq"),
        F.min(F.when(F.col("dy") == 0, F.col("image_id"))).alias("image_id"),
    )
    near = Window.partitionBy("barcode", "y").orderBy("x").rangeBetween(-radius, radius)
    return (
        spread.withColumn("earliest", F.min("column_min").over(near))
        .filter(F.col("seq").isNotNull() & (F.col("earliest") == F.col("seq")))
        .select("barcode", "x", "y", "seq", "image_id")
    )


def dilated(positions: DataFrame, radius: int) -> DataFrame:
    """All positions within the square radius of some position, along y and then along x."""
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    columns = positions.select("barcode", "x", F.explode(F.transform(offsets, lambda d: F.col("y") + d)).alias("y")).distinct()
    return columns.select("barcode", F.explode(F.transform(offsets, lambda d: F.col("x") + d)).alias("x"), "y").distinct()


def masked_positions(boxes: DataFrame, warp_dpi: int, pad_in: float = INDICATOR_PAD_IN) -> DataFrame:
    """Positions in and around the indicator boxes; a write-in box has no bottom pad,
    because a name written below it must be seen."""
    pad = int(pad_in * warp_dpi + 0.5)
    bottom = F.when(F.col("write_in"), 0).otherwise(pad)
    padded = boxes.select(
        "barcode",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("left") - pad), F.col("left") + F.col("width") + pad - 1)).alias("x"),
        F.greatest(F.lit(0), F.col("top") - pad).alias("y0"),
        (F.col("top") + F.col("height") + bottom - 1).alias("y1"),
    )
    return padded.select("barcode", "x", F.explode(F.sequence("y0", "y1")).alias("y")).distinct()


def novel_ink(dark: DataFrame, images: DataFrame, boxes: DataFrame, warp_dpi: int,
              dilation_in: float = DILATION_IN, pad_in: float = INDICATOR_PAD_IN) -> DataFrame:
    """Suspicious pixels: dark, away from earlier ink and from the indicator boxes.

    The first ballot of a barcode shows what is printed and is never suspicious.
    """
    radius = int(dilation_in * warp_dpi + 0.5)
    seeds = images.groupBy("barcode").agg(F.min("seq").alias("seed_seq"))
    mask = stage(masked_positions(boxes, warp_dpi, pad_in), "mask")
    return (
        novel_positions(first_dark(dark), radius)
        .join(mask, ["barcode", "x", "y"], "left_anti")
        .join(seeds, "barcode")
        .filter(F.col("seq") > F.col("seed_seq"))
        .drop("seed_seq")
    )


def ink_report(novel: DataFrame, images: DataFrame, flag_pixels: int = FLAG_PIXELS) -> DataFrame:
    """Suspicious pixel count and flag of every image."""
    counts = novel.groupBy("image_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return images.join(counts, "image_id", "left").select(
        "image_id", "barcode", "seq", n.alias("scribble_pixels"), (n >= flag_pixels).alias("scribble_flagged")
    )


# --- clusters ----------------------------------------------------------------


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest vertex id of each vertex's component.

    ``vertices``: grp, v.  ``edges``: grp, a, b, in one direction.  Each round takes the
    smallest label among the neighbours and then the label of that label, which
    halves the distance to the root; rounds grow with the logarithm of a
    component's length.  Labels are written between rounds.
    """
    both = stage(edges.unionByName(edges.select("grp", F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stage(vertices.select("grp", "v", F.col("v").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select("grp", F.col("v").alias("b"), F.col("label").alias("other")), ["grp", "b"])
            .groupBy("grp", F.col("a").alias("v")).agg(F.min("other").alias("other"))
        )
        hooked = stage(
            labels.join(near, ["grp", "v"], "left").select(
                "grp", "v", "label", F.least("label", "other").alias("hook")
            ),
            "hooked",
        )
        roots = hooked.select("grp", F.col("v").alias("hook"), F.col("hook").alias("root"))
        jumped = stage(hooked.join(roots, ["grp", "hook"]).select("grp", "v", "label", "root"), "labels")
        changed = not jumped.filter(F.col("root") != F.col("label")).isEmpty()
        labels = jumped.select("grp", "v", F.col("root").alias("label"))
        if not changed:
            return labels


def ink_clusters(novel: DataFrame, min_pixels: int = CLUSTER_MIN_PIXELS) -> DataFrame:
    """4-connected clusters of suspicious pixels: box with exclusive end, and size.

    Pixels are first joined to horizontal runs; runs that touch across a row border
    are the edges of a graph, and its components are the clusters.  No image is
    ever handled as a whole.
    """
    pixels = novel.select("image_id", "x", "y")
    row = Window.partitionBy("image_id", "y").orderBy("x")
    starts = F.when(F.coalesce(F.col("x") - F.lag("x").over(row), F.lit(0)) != 1, F.col("x"))
    runs = stage(
        pixels.withColumn("start", starts)
        .withColumn("run_x", F.last("start", ignorenulls=True).over(row))
        .select(F.col("image_id").alias("grp"), "x", "y",
                (F.shiftleft(F.col("y").cast("bigint"), 32) + F.col("run_x")).alias("v")),
        "runs",
    )
    below = runs.select("grp", "x", (F.col("y") - 1).alias("y"), F.col("v").alias("b"))
    edges = runs.withColumnRenamed("v", "a").join(below, ["grp", "x", "y"]).select("grp", "a", "b").distinct()
    labels = connected_components(runs.select("grp", "v").distinct(), edges)
    return (
        runs.groupBy("grp", "v").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                                     F.count("*").alias("size"))
        .join(labels, ["grp", "v"])
        .groupBy(F.col("grp").alias("image_id"), "label")
        .agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), (F.max("x1") + 1).alias("x1"), (F.max("y0") + 1).alias("y1"),
             F.sum("size").alias("pixels"))
        .filter(F.col("pixels") >= min_pixels)
        .drop("label")
    )


# --- image source ------------------------------------------------------------


def pixels_of_images(images: DataFrame) -> DataFrame:
    """Pixel rows of Spark's ``image`` source (columns image_id, barcode, seq, image).

    The source hands out rows of B, G, R bytes; the colours are weighed in the JVM
    after one Arrow pass has unpacked the bytes.
    """
    from tallyspark.functions.measure import luminance

    def unpack(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for image_id, barcode, seq, image in zip(batch["image_id"], batch["barcode"], batch["seq"], batch["image"]):
                shape = (image["height"], image["width"], image["nChannels"])
                data = np.frombuffer(image["data"], dtype=np.uint8).reshape(shape)
                blue, green, red = (data[:, :, min(i, shape[2] - 1)].ravel() for i in range(3))
                ys, xs = np.indices(shape[:2])
                yield pd.DataFrame({
                    "image_id": image_id, "barcode": barcode, "seq": seq, "x": xs.ravel(), "y": ys.ravel(),
                    "r": red.astype("int32"), "g": green.astype("int32"), "b": blue.astype("int32"),
                })

    schema = "image_id bigint, barcode string, seq bigint, x int, y int, r int, g int, b int"
    raw = images.select("image_id", "barcode", "seq", "image").mapInPandas(unpack, schema)
    return raw.select("image_id", "barcode", "seq", "x", "y", luminance(F.col("r"), F.col("g"), F.col("b")).alias("lum"))


_BOX_COLUMNS = ("box_id", "style", "left", "top", "width", "height")
_SUMS = ("total", "dark", "lum_sum", "t_total", "t_dark", "t_sum", "zone_dark")


def _rectangles(style: str, left: int, top: int, width: int, height: int) -> list[tuple[int, int, int, int]]:
    """The box, its inside and the zone of its style, as (left, top, right, bottom), ends exclusive.

    The parts are those of ``box_cells``: an arrow has a zone around the centre,
    connect-dots a centred stripe.
    """
    box = (max(0, left), max(0, top), left + width, top + height)
    inside = (box[0] + 1, box[1] + 1, box[2] - 1, box[3] - 1)
    zone = (0, 0, 0, 0)
    if style.upper() == "ARROW":
        x, y, half_w, half_h = left + width // 2, top + height // 2, max(1, width // 8), max(1, height // 8)
        zone = (x - half_w, y - half_h, x + half_w, y + half_h)
    elif style.upper() == "CONNECT_DOTS":
        stripe = max(1, width // 10)
        start = max(0, left + (width - stripe) // 2)
        zone = (max(start, box[0]), box[1], min(start + stripe, box[2]), box[3])
    return [box, inside, zone]


def _summed_areas(threshold: int):
    """Per page: sums of brightness and of dark pixels over everything above and left of each place."""
    def measure_pages(batches):
        import numpy as np
        import pyarrow as pa

        def table_of(values):
            table = np.zeros((values.shape[0] + 1, values.shape[1] + 1), dtype=np.int64)
            np.cumsum(values, axis=0, dtype=np.int64, out=table[1:, 1:])
            np.cumsum(table[1:, 1:], axis=1, out=table[1:, 1:])
            return table

        for batch in batches:
            rows = []
            for image_id, image, boxes in zip(*(batch.column(c) for c in ("image_id", "image", "boxes"))):
                height, width, channels = (image[k].as_py() for k in ("height", "width", "nChannels"))
                data = np.frombuffer(image["data"].as_buffer(), dtype=np.uint8).reshape(height, width, channels)
                blue, green, red = (data[:, :, min(i, channels - 1)].astype(np.int32) for i in range(3))
                lum = (299 * red + 587 * green + 114 * blue) // 1000
                bright, dark = table_of(lum), table_of(lum < threshold)

                def area(table, part):
                    x0, x1 = (min(max(v, 0), width) for v in (part[0], part[2]))
                    y0, y1 = (min(max(v, 0), height) for v in (part[1], part[3]))
                    return int(table[y1, x1] - table[y0, x1] - table[y1, x0] + table[y0, x0]) if x1 > x0 and y1 > y0 else 0

                def size(part):
                    x0, x1 = (min(max(v, 0), width) for v in (part[0], part[2]))
                    y0, y1 = (min(max(v, 0), height) for v in (part[1], part[3]))
                    return max(0, x1 - x0) * max(0, y1 - y0)

                for box in boxes.as_py():
                    whole, inside, zone = _rectangles(box["style"] or "", *(box[k] for k in ("left", "top", "width", "height")))
                    rows.append((image_id.as_py(), *(box[k] for k in ("box_id", "style", "width", "height")),
                                 size(whole), area(dark, whole), area(bright, whole),
                                 size(inside), area(dark, inside), area(bright, inside), area(dark, zone)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * len(_SUMS)]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["image_id", "box_id", "style", "width", "height", *_SUMS])

    return measure_pages


def sample_images(images: DataFrame, boxes: DataFrame, threshold: int = DEFAULT_DARK_THRESHOLD) -> DataFrame:
    """``sample_regions`` for rows of Spark's ``image`` source (image_id, barcode, image).

    Each page is summed up once in a table of areas; a box is four look-ups then, whatever
    its size, and no row per pixel is made.  The boxes of a barcode travel as one list,
    bounded by the printed sheet.  A page without boxes gives no rows.  A task holds the
    pages of one Arrow batch: ``spark.sql.execution.arrow.maxRecordsPerBatch`` bounds them.
    """
    listed = boxes.groupBy("barcode").agg(F.collect_list(F.struct(*[
        F.col(c).cast("string" if c == "style" else "bigint" if c == "box_id" else "int").alias(c) for c in _BOX_COLUMNS])).alias("boxes"))
    pages = images.select("image_id", "barcode", "image").join(stage(listed, "boxes"), "barcode").select("image_id", "image", "boxes")
    sums = ", ".join(f"{c} bigint" for c in _SUMS)
    return _samples(pages.mapInArrow(
        _summed_areas(threshold), f"image_id bigint, box_id bigint, style string, width int, height int, {sums}"))
