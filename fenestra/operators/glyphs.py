"""From positioned glyphs to rows, segments, lines and blocks.

A glyph has doc, ord, text, horizontal, size, cross (where its baseline lies), along and along_end; lines() also takes left, top, right, bottom of its box, font (points) and italic where they are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenestra.functions import geometry as g
from fenestra.functions.numbers import bind
from fenestra.operators.scans import carried, counted

ROW_STEP, COLUMN_GAP, WORD_GAP = 0.35, 3.0, 0.25
#: How near a line must be to the block's last one, in the taller one's height, and how far it may reach into it.
BLOCK_GAP, BLOCK_OVERLAP = 0.6, 0.5
#: Lengths of the ranges that rows and segments are scanned by, in the unit of cross and along.
ROW_RANGE, SEGMENT_RANGE = 200.0, 500.0


def _range(c: Column, width: float) -> Column:
    return F.floor(c / width)


def rows(glyphs: DataFrame) -> DataFrame:
    """Adds row: glyphs of a page and direction, by cross then ord, start a new row where cross moves by more than 0.35 of the larger size.

    Glyphs of one cross never start a new row after one another, so only the first and last size of each cross are scanned, by ranges of cross.
    """
    keys, order = ["doc", "horizontal"], [F.col("cross")]
    levels = glyphs.groupBy(*keys, "cross").agg(F.min_by("size", "ord").alias("_first"), F.max_by("size", "ord").alias("_last"))
    part = _range(F.col("cross"), ROW_RANGE)
    known = carried(levels, keys, part, order, {"_cross": F.col("cross"), "_size": F.col("_last")})
    new = F.coalesce((F.col("cross") - F.col("_cross") > ROW_STEP * F.greatest("_first", "_size")).cast("int"), F.lit(0))
    numbered = counted(known, keys, part, order, new, "row")
    return glyphs.join(numbered.select(*keys, "cross", "row"), [*keys, "cross"])


def _begin() -> Column:
    return F.least("along", "along_end")


def _end() -> Column:
    return F.greatest("along", "along_end")


def segments(glyphs: DataFrame) -> DataFrame:
    """Adds segment: within a row, a gap to the glyph before of more than three sizes starts a new one."""
    keys, order, part = ["doc", "horizontal", "row"], [_begin(), F.col("ord")], _range(_begin(), SEGMENT_RANGE)
    known = carried(glyphs, keys, part, order, {"_to": _end(), "_size": F.col("size")})
    new = F.coalesce((_begin() - F.col("_to") > COLUMN_GAP * F.greatest("size", "_size")).cast("int"), F.lit(0))
    return counted(known, keys, part, order, new, "segment").drop("_to", "_size")


def lines(glyphs: DataFrame) -> DataFrame:
    """One row a segment: its text, with a space where a gap exceeds a quarter of the size, its edges and its glyph count.

    Glyphs with boxes also give bounds (what visible glyphs' boxes span), font_min and font_max (points, to one decimal), italic, and whether the line is rotated.
    """
    keys, order, part = ["doc", "horizontal", "row"], [_begin(), F.col("ord")], _range(_begin(), SEGMENT_RANGE)
    blank = F.trim("text") == ""
    known = carried(glyphs, keys, part, order, {"_to": _end(), "_blank": blank, "_segment": F.col("segment")})
    spaced = (F.col("_segment") == F.col("segment")) & (_begin() - F.col("_to") > WORD_GAP * F.col("size")) & ~blank & ~F.col("_blank")
    piece = F.when(spaced, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(_begin().alias("a"), "ord", piece.alias("p")))), lambda x: x["p"]), "")
    found = [
        text.alias("text"), F.min(_begin()).alias("left"), F.max(_end()).alias("right"),
        F.min("cross").alias("top"), F.max(F.col("cross") + F.col("size")).alias("bottom"), F.count(F.lit(1)).alias("n_glyphs"),
    ]
    if "box" in glyphs.columns:
        seen = lambda c: F.when(~blank, c)
        box = F.col("box")
        found += [
            g.from_edges(F.min(seen(box["left"])), F.min(seen(box["top"])), F.max(seen(g.right(box))), F.max(seen(g.bottom(box)))).alias("bounds"),
            F.min(seen(F.bround("font", 1))).alias("font_min"), F.max(seen(F.bround("font", 1))).alias("font_max"), F.coalesce(F.bool_or(seen(F.col("italic"))), F.lit(False)).alias("italic"),
        ]
    return known.groupBy(*keys, "segment").agg(*found)


def blocks(found: DataFrame) -> DataFrame:
    """Adds block to lines(): by top, then left, each line joins the first block whose last line has its direction, is near above and overlaps it in x.

    Which block that is depends on all lines before, so a page's lines are folded in order; the state holds each block's last line as long as a later line may still join it.
    """
    order = ["top", "left", "row", "segment"]
    line = F.struct(*order, *[c for c in found.columns if c not in order and c != "doc"])
    pages = found.groupBy("doc").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.max(F.col("bottom") - F.col("top")).alias("tall"))
    kept = lambda x, k: F.struct(x["top"].alias("top"), x["bottom"].alias("bottom"), x["left"].alias("left"), x["right"].alias("right"), x["horizontal"].alias("horizontal"), k.cast("int").alias("block"))
    none = "array<struct<top:double,bottom:double,left:double,right:double,horizontal:boolean,block:int>>"
    start = F.struct(F.array().cast(none).alias("open"), F.array().cast("array<int>").alias("of"), F.lit(0).alias("n"))
    tall = F.col("tall")

    def joins(x: Column, y: Column) -> Column:
        own, gap = y["bottom"] - y["top"], x["top"] - y["bottom"]
        over = F.least(x["right"], y["right"]) > F.greatest(x["left"], y["left"])
        return (x["horizontal"] == y["horizontal"]) & (gap > -BLOCK_OVERLAP * own) & (gap <= BLOCK_GAP * F.greatest(x["bottom"] - x["top"], own)) & over

    def step(s: Column, x: Column) -> Column:
        near = F.filter(s["open"], lambda y: x["top"] - y["bottom"] <= BLOCK_GAP * F.greatest(tall, y["bottom"] - y["top"]))

        def joined(o: Column, k: Column) -> Column:
            return F.struct(F.array_append(F.filter(o, lambda y: y["block"] != k), kept(x, k)).alias("open"), F.array_append(s["of"], k).alias("of"), F.greatest(s["n"], k + 1).alias("n"))

        return bind(near, lambda o: bind(F.coalesce(F.array_min(F.transform(F.filter(o, lambda y: joins(x, y)), lambda y: y["block"])), s["n"]), lambda k: joined(o, k)))

    of = F.aggregate("lines", start, step, lambda s: s["of"])
    each = pages.select("doc", F.inline(F.transform(F.arrays_zip(F.col("lines").alias("l"), of.alias("b")), lambda z: F.struct(z["l"].alias("l"), z["b"].alias("block")))))
    return each.select(*(F.col("doc") if c == "doc" else F.col(f"l.{c}").alias(c) for c in found.columns), "block")


def on_page(glyphs: DataFrame) -> DataFrame:
    """Letters on baselines as glyphs on the page as it is shown: adds horizontal, size, cross, along, along_end (mm) and box.

    Needs text, font (points), x1, y1, x2, y2 (the baseline, in points) and turn, and of the page crop_left, crop_bottom, rotation and height_pt. Letters without text or size are none.
    """
    page = [F.col(c) for c in ("crop_left", "crop_bottom", "rotation", "height_pt")]
    x = glyphs.where((F.length("text") > 0) & (F.col("font") > 0))
    x = x.withColumn("_b", g.glyph_box(F.col("text"), F.col("font"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("turn")))
    (sx, sy), (ex, ey) = g.to_page(F.col("x1"), F.col("y1"), *page), g.to_page(F.col("_b.x2"), F.col("_b.y2"), *page)
    x = x.withColumns({"_sx": sx, "_sy": sy, "_ex": ex, "_ey": ey, "box": g.page_rect(*(F.col(f"_b.{c}") for c in ("left", "bottom", "right", "top")), *page)})
    flat = F.abs(F.col("_ex") - F.col("_sx")) >= F.abs(F.col("_ey") - F.col("_sy"))
    pick = lambda a, b: F.when(F.col("horizontal"), F.col(a)).otherwise(F.col(b))
    x = x.withColumns({"horizontal": flat, "size": F.col("font") * g.MM})
    return x.withColumns({"cross": pick("_sy", "_sx"), "along": pick("_sx", "_sy"), "along_end": pick("_ex", "_ey")}).drop("_b", "_sx", "_sy", "_ex", "_ey")


def level_rows(levels: DataFrame) -> DataFrame:
    """One row for each row of glyphs: doc, horizontal, row, and `levels`, an array of what the levels have besides.

    A level is all of a page's glyphs of one direction and cross, in whatever form its other columns hold them; it needs doc, horizontal, cross, and first_size and last_size, those of its least and its greatest ord.
    Rows begin as in rows(). Levels are dealt out by doc, once; what follows here, in level_lines() and in blocks() moves nothing again.
    """
    dealt = levels.repartition("doc")
    before = Window.partitionBy("doc", "horizontal").orderBy("cross")
    new = F.col("cross") - F.lag("cross").over(before) > ROW_STEP * F.greatest("first_size", F.lag("last_size").over(before))
    row = F.sum(F.coalesce(F.col("_new").cast("bigint"), F.lit(0))).over(before.rowsBetween(Window.unboundedPreceding, 0))
    held = F.struct(*[c for c in levels.columns if c not in ("doc", "horizontal", "first_size", "last_size")])
    return dealt.withColumn("_new", new).withColumn("row", row).groupBy("doc", "horizontal", "row").agg(F.collect_list(held).alias("levels"))


def in_order(glyphs: Column) -> Column:
    """A row's glyphs, an array of structs with ord, text, size, cross, along and along_end, as begin, ord, end, size, cross, text: by where they begin, then ord."""
    return F.array_sort(F.transform(glyphs, lambda x: F.struct(
        F.least(x["along"], x["along_end"]).alias("begin"), x["ord"].alias("ord"), F.greatest(x["along"], x["along_end"]).alias("end"), x["size"].alias("size"), x["cross"].alias("cross"), x["text"].alias("text"),
    )))


def cut(ordered: Column) -> Column:
    """The segments of a row's glyphs as in_order() gives them, as in segments(): an array of arrays."""

    def at(x: Column, i: Column) -> Column:
        y = F.get(ordered, i - 1)
        return F.when((i == 0) | (x["begin"] - y["end"] > COLUMN_GAP * F.greatest(x["size"], y["size"])), i)

    starts = F.filter(F.transform(ordered, at), lambda i: i.isNotNull())
    return bind(starts, lambda b: F.transform(b, lambda i, k: F.slice(ordered, i + 1, F.coalesce(F.get(b, k + 1), F.size(ordered)) - i)))


def spelled(segment: Column) -> Column:
    """The text of a segment that cut() gives, as in lines()."""

    def piece(x: Column, i: Column) -> Column:
        y = F.get(segment, i - 1)
        spaced = (i > 0) & (x["begin"] - y["end"] > WORD_GAP * x["size"]) & (F.trim(x["text"]) != "") & (F.trim(y["text"]) != "")
        return F.when(spaced, F.concat(F.lit(" "), x["text"])).otherwise(x["text"])

    return F.array_join(F.transform(segment, piece), "")


def level_lines(found: DataFrame) -> DataFrame:
    """lines() of level_rows() whose `glyphs` are in_order(): doc, horizontal, row, segment, text, left, right, top, bottom, n_glyphs and first_ord. Works inside each row."""
    each = found.select("doc", "horizontal", "row", F.posexplode(cut(F.col("glyphs"))).alias("segment", "s"))
    of = lambda f: F.transform("s", f)
    return each.select(
        "doc", "horizontal", "row", F.col("segment").cast("bigint").alias("segment"), spelled(F.col("s")).alias("text"), F.get("s", 0)["begin"].alias("left"), F.array_max(of(lambda x: x["end"])).alias("right"),
        F.array_min(of(lambda x: x["cross"])).alias("top"), F.array_max(of(lambda x: x["cross"] + x["size"])).alias("bottom"), F.size("s").cast("bigint").alias("n_glyphs"), F.array_min(of(lambda x: x["ord"])).alias("first_ord"),
    )


def text_blocks(glyphs: DataFrame) -> DataFrame:
    """The blocks that pages.inspect() takes (doc, ord, bounds, lines, font_min, font_max, italic, rotated, non_left) from glyphs with box, font and italic, in both directions of text.

    Typography is added up from glyphs to lines to blocks. Lines without a visible glyph are none. A block is rotated if most of its lines run down or up the page, and not aligned to the left if its
    lines' left edges differ by more than 2 mm while their right edges, or their middles, lie within 1 mm.
    """
    each = lines(segments(rows(glyphs))).where(F.col("bounds.left").isNotNull())
    r = F.col("bounds")
    each = each.select("doc", "horizontal", "row", "segment", F.trim("text").alias("text"), r["left"].alias("left"), g.right(r).alias("right"), r["top"].alias("top"), g.bottom(r).alias("bottom"), "font_min", "font_max", "italic")
    spread = lambda c: F.max(c) - F.min(c)
    centre = F.col("left") + (F.col("right") - F.col("left")) / 2
    turned = F.sum((~F.col("horizontal")).cast("int")) * 2 > F.count(F.lit(1))
    ragged = (F.count(F.lit(1)) >= 2) & (spread(F.col("left")) > 2) & ((spread(F.col("right")) < 1) | (spread(centre) < 1))
    # in the order in which lines were joined
    text = F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "row", "segment", "text"))), lambda x: x["text"])
    return blocks(each).groupBy("doc", F.col("block").cast("bigint").alias("ord")).agg(
        g.from_edges(F.min("left"), F.min("top"), F.max("right"), F.max("bottom")).alias("bounds"), text.alias("lines"), F.min("font_min").alias("font_min"), F.max("font_max").alias("font_max"),
        F.bool_or("italic").alias("italic"), turned.alias("rotated"), ragged.alias("non_left"),
    )
