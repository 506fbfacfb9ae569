"""Rectangles, rotations and placements, as columns. A rectangle is struct<x0, y0, x1, y1>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A4 in points, the margin around a placed image, a span's padding, the gap of columns and lines.
A4 = (595.0, 842.0)
MARGIN = 10.0
PAD = 1.0
COLUMN_GAP_CHARS = 3.0
MAX_LINE_GAP = 3.0


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)))


def overlaps(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["y0"] < b["y1"]) & (a["y1"] > b["y0"])


def any_overlap(a: Column, b: Column) -> Column:
    """Some rectangle of one array meets one of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: overlaps(x, y)))


def covered(rects: Column, existing: Column, tolerance: float = 1.0) -> Column:
    """Every rectangle equals an existing one up to the tolerance on each side."""
    return F.forall(rects, lambda r: F.exists(existing, lambda e: (F.abs(r["x0"] - e["x0"]) <= tolerance) & (F.abs(r["y0"] - e["y0"]) <= tolerance) & (F.abs(r["x1"] - e["x1"]) <= tolerance) & (F.abs(r["y1"] - e["y1"]) <= tolerance)))


def same_places(rects: DataFrame, existing: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(page_uid, r) of rects that equal some d of existing (page_uid, d) up to the tolerance on each side.

    Corners of equal rectangles lie in one cell of twice the tolerance or in neighbouring ones, so the join is on equal cells; sides are compared behind it.
    """
    cell = lambda r, side: F.floor(F.col(r)[side] / (2 * tolerance))
    around = lambda side: F.explode(F.sequence(cell("r", side) - 1, cell("r", side) + 1))
    near = rects.withColumn("__cx", around("x0")).withColumn("__cy", around("y0"))
    placed = existing.select("page_uid", "d", cell("d", "x0").alias("__cx"), cell("d", "y0").alias("__cy"))
    same = [F.abs(F.col("r")[side] - F.col("d")[side]) <= tolerance for side in ("x0", "y0", "x1", "y1")]
    return near.join(placed.hint("merge"), ["page_uid", "__cx", "__cy"]).where(same[0] & same[1] & same[2] & same[3]).select("page_uid", "r").distinct()


def upper_median(values: Column) -> Column:
    """The element in the middle of the sorted array; of two, the greater."""
    return F.element_at(F.sort_array(values), (F.size(values) / 2).cast("int") + 1)


def drop_outliers(rects: Column) -> Column:
    """Rectangles not further from the first one's top than some line heights for each; at least one."""
    tall = upper_median(F.transform(rects, lambda r: r["y1"] - r["y0"]))
    limit = MAX_LINE_GAP * F.when(tall == 0, F.lit(1.0)).otherwise(tall) * F.size(rects)
    kept = F.filter(rects, lambda r: F.abs(r["y0"] - F.element_at(rects, 1)["y0"]) <= limit)
    return F.when(F.size(rects) < 2, rects).when(F.size(kept) > 0, kept).otherwise(F.slice(rects, 1, 1))


def rotate_point(x: Column, y: Column, width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """From the unrotated page into the rotated one."""
    d = F.pmod(degrees, F.lit(360))
    return (
        F.when(d == 0, x).when(d == 90, height - y).when(d == 180, width - x).otherwise(y),
        F.when(d == 0, y).when(d == 90, x).when(d == 180, height - y).otherwise(width - x),
    )


def unrotate_point(x: Column, y: Column, width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    d = F.pmod(degrees, F.lit(360))
    return (
        F.when(d == 0, x).when(d == 90, y).when(d == 180, width - x).otherwise(width - y),
        F.when(d == 0, y).when(d == 90, height - x).when(d == 180, height - y).otherwise(x),
    )


def to_canvas(x: Column, y: Column, width: Column, height: Column, degrees: Column, scale: Column, off_x: Column, off_y: Column, crop: Column | None = None) -> tuple[Column, Column]:
    """Page point to canvas pixel: rotate, take off the crop's corner, scale, move."""
    rx, ry = rotate_point(x, y, width, height, degrees)
    if crop is not None:
        corners = [rotate_point(crop[a], crop[b], width, height, degrees) for a in ("x0", "x1") for b in ("y0", "y1")]
        rx, ry = rx - F.least(*(c[0] for c in corners)), ry - F.least(*(c[1] for c in corners))
    return off_x + rx * scale, off_y + ry * scale


def from_canvas(cx: Column, cy: Column, width: Column, height: Column, degrees: Column, scale: Column, off_x: Column, off_y: Column) -> tuple[Column, Column]:
    return unrotate_point((cx - off_x) / scale, (cy - off_y) / scale, width, height, degrees)


def normalise(r: Column) -> Column:
    """Corners in order."""
    return rect(F.least(r["x0"], r["x1"]), F.least(r["y0"], r["y1"]), F.greatest(r["x0"], r["x1"]), F.greatest(r["y0"], r["y1"]))


def clamp(r: Column, box: Column, least: float = 1.0) -> Column:
    """The part inside box; null if it is narrower or lower than least."""
    x0, y0 = F.greatest(r["x0"], box["x0"]), F.greatest(r["y0"], box["y0"])
    x1, y1 = F.least(r["x1"], box["x1"]), F.least(r["y1"], box["y1"])
    return F.when((x1 - x0 >= least) & (y1 - y0 >= least), rect(x0, y0, x1, y1))


def a4_placement(width: Column, height: Column) -> Column:
    """struct<x, y, w, h>: an image in the middle of an A4 page, as large as the margin lets it be."""
    most_w, most_h = A4[0] - 2 * MARGIN, A4[1] - 2 * MARGIN
    ratio = height / width.cast("double")
    tall = most_w * ratio > most_h
    w = F.when(tall, most_h / ratio).otherwise(F.lit(most_w))
    h = F.when(tall, F.lit(most_h)).otherwise(most_w * ratio)
    return F.struct(((A4[0] - w) / 2).alias("x"), ((A4[1] - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


def zoom_dpi(target_px: Column, page_points: Column, low: float = 8.0, high: float = 200.0) -> Column:
    """Dots per inch that give a page the target width, within limits."""
    return F.greatest(F.lit(low), F.least(F.lit(high), target_px * 72.0 / page_points))
