"""Envelope layouts: where windows lie on the page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.functions import geometry as g

SHEET = (210.0, 99.0)


@dataclass(frozen=True)
class EnvelopeWindow:
    """A window on the envelope; exactly one horizontal and one vertical distance is given."""

    width: float
    height: float
    from_left: float | None = None
    from_right: float | None = None
    from_bottom: float | None = None
    from_top: float | None = None

    def on_envelope(self, width: float, height: float) -> tuple[float, float, float, float]:
        """left, top, width, height."""
        if (self.from_left is None) == (self.from_right is None) or (self.from_bottom is None) == (self.from_top is None):
            raise ValueError("give one horizontal and one vertical distance")
        left = self.from_left if self.from_left is not None else width - self.from_right - self.width
        top = self.from_top if self.from_top is not None else height - self.from_bottom - self.height
        if left < 0 or top < 0 or left + self.width > width or top + self.height > height:
            raise ValueError("the window doesn't fit on the envelope")
        return left, top, self.width, self.height


def on_page(window: EnvelopeWindow, envelope: tuple[float, float], centered: bool = False, sheet: tuple[float, float] = SHEET) -> tuple[tuple[float, float, float, float], float]:
    """What a window always shows of the folded sheet, and the clearance to keep.

    A sheet that may lie anywhere loses the slack at right and bottom (clearance 1 mm); a centred one is moved by half of it (3 mm).
    """
    if sheet[0] > envelope[0] or sheet[1] > envelope[1]:
        raise ValueError("the sheet doesn't fit in the envelope")
    slack = envelope[0] - sheet[0], envelope[1] - sheet[1]
    left, top, w, h = window.on_envelope(*envelope)
    if centered:
        area, clearance = (left - slack[0] / 2, top - slack[1] / 2, w, h), 3.0
    else:
        area, clearance = (left, top, min(left + w - slack[0], sheet[0]) - left, min(top + h - slack[1], sheet[1]) - top), 1.0
    if area[2] <= 2 * clearance or area[3] <= 2 * clearance:
        raise ValueError("no part of the page is always visible in the window")
    return area, clearance


def overlap(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> bool:
    return min(a[0] + a[2], b[0] + b[2]) > max(a[0], b[0]) and min(a[1] + a[3], b[1] + b[3]) > max(a[1], b[1])


# Sizes of the C6/5 envelope and its windows, and the DIN 5008 fields, in millimetres.
C65 = (229.0, 114.0)
C65_RECIPIENT = EnvelopeWindow(90, 45, from_right=20, from_bottom=15)
C65_SENDER = EnvelopeWindow(70, 30, from_left=28, from_bottom=20)
DIN_B, DIN_A, TOP_LEFT = (20.0, 45.0, 85.0, 45.0), (20.0, 27.0, 85.0, 45.0), (20.0, 12.0, 85.0, 28.0)


def layouts() -> list[tuple[str, str, float, float, float, float, float]]:
    """Rows of layout, role, left, top, width, height, clearance."""
    recipient, sender = on_page(C65_RECIPIENT, C65), on_page(C65_SENDER, C65)
    found = {
        "c65_single": {"recipient": recipient}, "c65_two": {"recipient": recipient, "sender": sender},
        "dl_din_b": {"recipient": (DIN_B, 3.0)}, "dl_din_a": {"recipient": (DIN_A, 3.0)}, "dl_two_left": {"recipient": (DIN_B, 3.0), "sender": (TOP_LEFT, 3.0)},
    }
    for name, roles in found.items():
        if "sender" in roles and overlap(roles["sender"][0], roles["recipient"][0]):
            raise ValueError(f"the windows of {name} overlap")
    return [(name, role, *map(float, area), clearance) for name, roles in found.items() for role, (area, clearance) in roles.items()]


def place_windows(envelopes: DataFrame, windows: DataFrame) -> DataFrame:
    """Many envelopes at once: layout, role, window (on the page), clearance and problem for every window of `windows`.

    `envelopes`: layout, width, height, centered, sheet_width, sheet_height. `windows`: layout, role, width, height and the distances from_left, from_right, from_top, from_bottom, of which one each way
    is given. The problem, null for a window that can be used, is the first of: sheet (doesn't fit in the envelope), size, distances, does_not_fit (on the envelope), nothing_visible, and, for a
    sender's window, overlap (with its layout's recipient's). The window is null where there is a problem but overlap.
    """
    e = envelopes.select("layout", F.struct("width", "height", "centered", "sheet_width", "sheet_height").alias("e"))
    x = windows.join(e, "layout")
    env, w, h = F.col("e"), F.col("width"), F.col("height")
    left = F.coalesce("from_left", env["width"] - F.col("from_right") - w)
    top = F.coalesce("from_top", env["height"] - F.col("from_bottom") - h)
    x = x.withColumns({"_left": left, "_top": top, "_dx": env["sheet_width"] - env["width"], "_dy": env["sheet_height"] - env["height"]})  # the slack, negative
    left, top, dx, dy = (F.col(c) for c in ("_left", "_top", "_dx", "_dy"))
    right = lambda at, size, d, sheet: F.least(at + size + d, sheet)
    loose = g.from_edges(left, top, right(left, w, dx, env["sheet_width"]), right(top, h, dy, env["sheet_height"]))
    x = x.withColumns({"_area": F.when(env["centered"], g.rect(left + dx / 2, top + dy / 2, w, h)).otherwise(loose), "clearance": F.when(env["centered"], 3.0).otherwise(1.0)})
    two = lambda a, b: F.col(a).isNull() == F.col(b).isNull()
    out = (left < 0) | (top < 0) | (left + w > env["width"]) | (top + h > env["height"])
    hidden = (F.col("_area.width") <= 2 * F.col("clearance")) | (F.col("_area.height") <= 2 * F.col("clearance"))
    problem = (
        F.when((dx > 0) | (dy > 0), "sheet").when((w <= 0) | (h <= 0), "size").when(two("from_left", "from_right") | two("from_top", "from_bottom"), "distances")
        .when(out, "does_not_fit").when(hidden, "nothing_visible")
    )
    placed = x.select("layout", "role", F.when(problem.isNull(), F.col("_area")).alias("window"), "clearance", problem.alias("problem"))
    first = placed.where("role = 'recipient'").select("layout", F.col("window").alias("_other"))
    both = placed.join(first, "layout", "left")
    over = (F.col("role") == "sender") & F.col("_other").isNotNull() & (g.intersection_area(F.col("window"), F.col("_other")) > 0)
    return both.select("layout", "role", "window", "clearance", F.when(F.col("problem").isNull() & over, "overlap").otherwise(F.col("problem")).alias("problem"))


# Names of windows and layouts in messages.
ROLE_NAMES = {"recipient": "okno adresata", "sender": "okno nadawcy"}
DIN_NAMES = {"dl_din_b": "okno adresata (DIN 5008 B)", "dl_din_a": "okno adresata (DIN 5008 A)", "dl_two_left": "okno adresata (DIN 5008 B)"}
LAYOUT_NAMES = {
    "c65_single": "C65, jedno okienko", "c65_two": "C65, dwa okienka", "dl_din_b": "DL, jedno okienko po lewej (DIN 5008 B)", "dl_din_a": "DL, jedno okienko po lewej (DIN 5008 A)", "dl_two_left": "DL, dwa okienka (adresat po lewej)",
}


def layout_windows(spark: SparkSession) -> DataFrame:
    """layout, role, window (struct of left, top, width, height), clearance, name, layout_name: a dimension of a few rows, safe to broadcast."""
    named = lambda n, r: DIN_NAMES.get(n, ROLE_NAMES[r]) if r == "recipient" else ROLE_NAMES[r]
    rows = [(n, r, (a, b, c, d), k, named(n, r), LAYOUT_NAMES[n]) for n, r, a, b, c, d, k in layouts()]
    return spark.createDataFrame(rows, "layout string, role string, window struct<left:double,top:double,width:double,height:double>, clearance double, name string, layout_name string")
