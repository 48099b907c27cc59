"""Rectangles in millimetres (origin top left) as structs of left, top, width, height, and their arithmetic as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fenestra.functions.numbers import bind

TOLERANCE = 0.05


def rect(left, top, width, height) -> Column:
    lit = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.struct(lit(left).alias("left"), lit(top).alias("top"), lit(width).alias("width"), lit(height).alias("height"))


def right(r: Column) -> Column:
    return r["left"] + r["width"]


def bottom(r: Column) -> Column:
    return r["top"] + r["height"]


def from_edges(left: Column, top: Column, right_: Column, bottom_: Column) -> Column:
    return rect(left, top, right_ - left, bottom_ - top)


def deflate(r: Column, mm: Column) -> Column:
    """Each side moved inwards; width and height stay at 0 or more."""
    return rect(r["left"] + mm, r["top"] + mm, F.greatest(F.lit(0.0), r["width"] - 2 * mm), F.greatest(F.lit(0.0), r["height"] - 2 * mm))


def offset(r: Column, dx: Column, dy: Column) -> Column:
    return rect(r["left"] + dx, r["top"] + dy, r["width"], r["height"])


def union(a: Column, b: Column) -> Column:
    return from_edges(F.least(a["left"], b["left"]), F.least(a["top"], b["top"]), F.greatest(right(a), right(b)), F.greatest(bottom(a), bottom(b)))


def contains(outer: Column, inner: Column, tolerance: float = TOLERANCE) -> Column:
    return (
        (inner["left"] >= outer["left"] - tolerance) & (inner["top"] >= outer["top"] - tolerance)
        & (right(inner) <= right(outer) + tolerance) & (bottom(inner) <= bottom(outer) + tolerance)
    )


def intersection_area(a: Column, b: Column) -> Column:
    """0 unless both overlaps are more than 0."""
    w = F.least(right(a), right(b)) - F.greatest(a["left"], b["left"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["top"], b["top"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlap_score(block: Column, window: Column) -> Column:
    """The overlap, weighted by the share of the block inside the window."""
    area, over = block["width"] * block["height"], intersection_area(block, window)
    return F.when(area > 0, over * (over / area)).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    dx = F.greatest(F.lit(0.0), b["left"] - right(a), a["left"] - right(b))
    dy = F.greatest(F.lit(0.0), b["top"] - bottom(a), a["top"] - bottom(b))
    return F.sqrt(dx * dx + dy * dy)


def overflow(allowed: Column, text: Column) -> Column:
    """How far `text` sticks out of `allowed` on each side, half-even to 0.1 mm; up to the tolerance counts as 0."""
    side = lambda v: F.when(v > TOLERANCE, F.bround(v, 1)).otherwise(F.lit(0.0))
    return F.struct(
        side(allowed["left"] - text["left"]).alias("left"), side(allowed["top"] - text["top"]).alias("top"),
        side(right(text) - right(allowed)).alias("right"), side(bottom(text) - bottom(allowed)).alias("bottom"),
    )


def overflow_mm(o: Column) -> Column:
    return F.greatest(o["left"], o["top"], o["right"], o["bottom"])


def overflow_text(o: Column) -> Column:
    """The sides that overflow, left, right, top, bottom, as side and millimetres with a decimal comma."""
    names = (("left", "z lewej"), ("right", "z prawej"), ("top", "u góry"), ("bottom", "u dołu"))
    each = [F.when(o[k] > 0, F.concat(F.lit(f"{word} o "), F.replace(F.format_string("%.1f", o[k]), F.lit("."), F.lit(",")), F.lit(" mm"))) for k, word in names]
    return F.concat_ws(", ", *each)


def fits(text: Column, window: Column, clearance: Column) -> Column:
    """outside, too_close (to the window's edge) or inside."""
    return F.when(overflow_mm(overflow(window, text)) > 0, "outside").when(~contains(deflate(window, clearance), text), "too_close").otherwise("inside")


def looks_like_label(r: Column) -> Column:
    return (r["width"] >= 20) & (r["height"] >= 4) & (r["width"] / r["height"]).between(1.5, 10)


def label_geometry(label: Column, window: Column, clearance: Column) -> Column:
    """not_overlapping, too_large, outside, too_close or inside, the first that holds."""
    room = deflate(window, clearance)
    large = (label["width"] > room["width"] + TOLERANCE) | (label["height"] > room["height"] + TOLERANCE)
    return F.when(intersection_area(label, window) <= 0, "not_overlapping").when(large, "too_large").otherwise(fits(label, window, clearance))


MM = 25.4 / 72


def to_page(x: Column, y: Column, crop_left: Column, crop_bottom: Column, rotation: Column, height_pt: Column) -> tuple[Column, Column]:
    """A point of a PDF page (points, origin bottom left) in millimetres from the top left, as it is shown.

    The crop box's corner is the origin on an upright page, its lower edge on one turned by 90 degrees, and nothing on others.
    """
    turn = F.pmod(rotation, F.lit(360))
    dx, dy = F.when(turn == 90, crop_bottom).when(turn.isin(180, 270), 0.0).otherwise(crop_left), F.when(turn.isin(90, 180, 270), 0.0).otherwise(crop_bottom)
    return (x - dx) * MM, (height_pt - (y - dy)) * MM


def page_rect(left: Column, bottom_: Column, right_: Column, top: Column, crop_left: Column, crop_bottom: Column, rotation: Column, height_pt: Column) -> Column:
    """A rectangle of a PDF page as it is shown: what its corners span."""
    x1, y1 = to_page(left, bottom_, crop_left, crop_bottom, rotation, height_pt)
    x2, y2 = to_page(right_, top, crop_left, crop_bottom, rotation, height_pt)
    return from_edges(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


# How far letters reach above and below their baseline, in their size, and the capitals that reach higher.
ASCENT, ACCENTED_ASCENT, DESCENT = 0.8, 0.92, 0.22
ACCENTED_CAPITALS = "ĄĆĘŁŃÓŚŹŻ"


def glyph_box(text: Column, size: Column, x1: Column, y1: Column, x2: Column, y2: Column, turn: Column) -> Column:
    """left, bottom, right, top (points) of a letter on the baseline from (x1, y1) to (x2, y2), and its end (x2, y2).

    A letter without an advance lies along its orientation, `turn` degrees to the left, for half its size.
    """
    flat = F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) < 1e-6
    ux, uy = F.when(turn.isin(90, 270), 0.0).when(turn == 180, -1.0).otherwise(1.0), F.when(turn == 90, 1.0).when(turn == 270, -1.0).otherwise(0.0)
    end_x, end_y = F.when(flat, x1 + ux * size * 0.5).otherwise(x2), F.when(flat, y1 + uy * size * 0.5).otherwise(y2)

    def box(e: Column) -> Column:
        length = F.sqrt((e["x"] - x1) * (e["x"] - x1) + (e["y"] - y1) * (e["y"] - y1))
        nx, ny = -(e["y"] - y1) / length, (e["x"] - x1) / length
        up = size * F.when(F.substring(text, 1, 1).rlike(f"[{ACCENTED_CAPITALS}]"), ACCENTED_ASCENT).otherwise(ASCENT)
        down = size * DESCENT
        xs = [x1 - nx * down, x1 + nx * up, e["x"] - nx * down, e["x"] + nx * up]
        ys = [y1 - ny * down, y1 + ny * up, e["y"] - ny * down, e["y"] + ny * up]
        return F.struct(F.least(*xs).alias("left"), F.least(*ys).alias("bottom"), F.greatest(*xs).alias("right"), F.greatest(*ys).alias("top"), e["x"].alias("x2"), e["y"].alias("y2"))

    return bind(F.struct(end_x.alias("x"), end_y.alias("y")), box)


def is_a4_portrait(width: Column, height: Column) -> Column:
    return (F.abs(width - 210) < 2) & (F.abs(height - 297) < 2)
