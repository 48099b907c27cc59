"""Rules: conditions that turn into coded issues, and their roll-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenestra.functions import addresses as a
from fenestra.functions import geometry as g
from fenestra.functions import messages as m
from fenestra.functions.numbers import bind


@dataclass(frozen=True)
class AddressRules:
    min_lines: int = 3
    max_lines: int = 6
    max_chars: int = 40
    min_font: float = 8.0
    max_font: float = 14.0
    foreign: bool = True
    postal: bool = True
    warn_decorated: bool = True
    warn_alignment: bool = True


RECIPIENT, SENDER = AddressRules(), AddressRules(min_lines=2, max_lines=5)


def issue(condition: Column, code: str, severity: Column | str = "Error", said: Column | None = None) -> Column:
    """An array of a struct of code and severity, and message where one is given, if the condition holds, else an empty one."""
    level = severity if isinstance(severity, Column) else F.lit(severity)
    none = F.array().cast(f"array<struct<code:string,severity:string{'' if said is None else ',message:string'}>>")
    return F.when(condition, F.array(F.struct(F.lit(code).alias("code"), level.alias("severity"), *([] if said is None else [said.alias("message")])))).otherwise(none)


def issues(*each: Column) -> Column:
    """Those of issue() that hold. Arrays of one are put together, which Spark compiles; taking nulls out of one array would interpret all that is in it."""
    return F.concat(*each)


def address_facts(lines: Column, text: Column, rules: AddressRules = RECIPIENT) -> Column:
    """What address_issues() goes by, of normalized lines that are also given as one text with line ends."""
    return F.struct(lines.alias("l"), F.size(lines).alias("n"), a.has_merge_field_in(text).alias("fields"), (a.postal_verdict_of(lines, text, rules.foreign) if rules.postal else F.lit("ok")).alias("verdict"), a.unusual_characters_in(text).alias("odd"))


def address_issues(lines: Column, rules: AddressRules = RECIPIENT, texts: bool = False, facts: Column | None = None) -> Column:
    """Issues of an address's text; `lines` are normalized (see addresses.normalize_lines). One LINE_TOO_LONG for each such line. With `texts`, issues have messages. `facts`: a column of address_facts(), if there is one."""
    t = lambda f: f() if texts else None
    base = facts if facts is not None else F.struct(lines.alias("l"), F.size(lines).alias("n"), a.has_merge_field(lines).alias("fields"), (a.postal_verdict(lines, rules.foreign) if rules.postal else F.lit("ok")).alias("verdict"), a.unusual_characters(lines).alias("odd"))

    def found(x: Column) -> Column:
        own, n, fields, verdict = x["l"], x["n"], x["fields"], x["verdict"]
        level, some = F.when(fields, "Warning").otherwise("Error"), n > 0
        postal = lambda: m.text("TEXT_AFTER_POSTAL_CODE_LINE", line=F.get(F.filter(own, lambda y: y.rlike(a.POSTAL_LINE)), 0))
        missing = lambda: m.text("POSTAL_CODE_LINE_MISSING", foreign=m.FOREIGN_HINT if rules.foreign else m.NO_HINT, hint=m.postal_hint(own))
        # the place of a line, as messages count it
        numbered = F.transform(own, lambda y, i: F.struct(y.alias("y"), (i + 1).alias("i")))
        long = F.transform(
            F.filter(numbered, lambda z: F.length(z["y"]) > rules.max_chars),
            lambda z: F.struct(F.lit("LINE_TOO_LONG").alias("code"), F.lit("Error").alias("severity"), *[m.line_too_long(z["i"], z["y"], rules.max_chars).alias("message")] * texts),
        )
        none = issue(F.lit(False), "LINE_TOO_LONG", said=t(lambda: F.lit("")))
        single = issues(
            issue(~some, "ADDRESS_EMPTY", said=t(lambda: m.text("ADDRESS_EMPTY"))), issue(some & fields, "MERGE_FIELDS_PRESENT", "Warning", t(lambda: m.text("MERGE_FIELDS_PRESENT"))),
            issue(some & (n < rules.min_lines), "TOO_FEW_LINES", said=t(lambda: m.line_count(n, rules.min_lines, True))), issue(n > rules.max_lines, "TOO_MANY_LINES", said=t(lambda: m.line_count(n, rules.max_lines, False))),
            issue(some & (verdict == "text_after"), "TEXT_AFTER_POSTAL_CODE_LINE", level, t(postal)), issue(some & (verdict == "missing"), "POSTAL_CODE_LINE_MISSING", level, t(missing)),
            issue(some & (F.size(x["odd"]) > 0), "UNUSUAL_CHARACTERS", "Warning", t(lambda: m.unusual(x["odd"]))),
        )
        return F.concat(single, F.when(F.length(F.array_join(own, "")) > rules.max_chars, long).otherwise(none))

    return found(facts) if facts is not None else bind(base, found)


def type_issues(min_font: Column, max_font: Column, italic: Column, non_left: Column, rules: AddressRules = RECIPIENT, texts: bool = False, some: Column | None = None) -> Column:
    """Issues of an address's type; `some`: whether there is a text at all."""
    t = lambda f: f() if texts else None
    if some is not None:
        min_font, max_font, italic, non_left = (F.when(some, c) for c in (min_font, max_font, italic, non_left))
    return issues(
        issue(min_font < rules.min_font, "FONT_TOO_SMALL", said=t(lambda: m.font(min_font, rules.min_font, True))), issue(max_font > rules.max_font, "FONT_TOO_LARGE", "Warning", t(lambda: m.font(max_font, rules.max_font, False))),
        issue(italic & rules.warn_decorated, "DECORATED_TEXT", "Warning", t(lambda: m.text("DECORATED_TEXT"))), issue(non_left & rules.warn_alignment, "NON_LEFT_ALIGNMENT", "Warning", t(lambda: m.text("NON_LEFT_ALIGNMENT"))),
    )


def _over(window: Column, bounds: Column) -> Column:
    return g.overflow_text(g.overflow(window, bounds))


def address_place(bounds: Column, window: Column, clearance: Column) -> Column:
    """outside, too_close or inside; a block that the window doesn't show at all is outside, whatever its size."""
    return F.when(g.overlap_score(bounds, window) <= 0, "outside").otherwise(g.fits(bounds, window, clearance))


def place_issues(bounds: Column, window: Column, clearance: Column, rotated: Column, name: Column | None = None, neighbour: Column | None = None, texts: bool = True, place: Column | None = None) -> Column:
    """Issues of where a block lies. With the window's `name`, and its neighbour's if the block shows there, issues have messages, unless `texts` is false. `place`: a column of address_place(), if there is one."""
    t = lambda f: f() if name is not None and texts else None
    shown = lambda: {"name": name, "window": m.place(window), "bounds": m.place(bounds)}
    outside = lambda: F.when(g.overlap_score(bounds, window) <= 0, m.text("ADDRESS_OUTSIDE_WINDOW/away", where=m.where_instead(neighbour), **shown())).otherwise(m.text("ADDRESS_OUTSIDE_WINDOW", over=_over(window, bounds), **shown()))
    close = lambda: m.text("ADDRESS_TOO_CLOSE_TO_EDGE", name=name, clearance=m.mm(clearance), over=_over(g.deflate(window, clearance), bounds))
    found = lambda p: issues(
        issue(rotated, "TEXT_ROTATED", said=t(lambda: m.text("TEXT_ROTATED", name=name))), issue(p == "outside", "ADDRESS_OUTSIDE_WINDOW", said=t(outside)), issue(p == "too_close", "ADDRESS_TOO_CLOSE_TO_EDGE", said=t(close)),
    )
    return found(place) if place is not None else bind(address_place(bounds, window, clearance) if name is not None else g.fits(bounds, window, clearance), found)


@dataclass(frozen=True)
class LabelRules:
    read_barcode: bool = True
    domestic: bool = True
    international: bool = True
    min_module_px: float = 2.5


def label_issues(bounds: Column, window: Column, clearance: Column, barcode: Column, number: Column, expected: Column, gs1: Column, module_px: Column, rules: LabelRules = LabelRules(), name: Column | None = None, neighbour: Column | None = None, pixels: Column | None = None, texts: bool = True, place: Column | None = None) -> Column:
    """Issues of a label: its place, then, if barcodes are read, what its barcode says. `number` is the struct of numbers.parse_number(); a null barcode stops the content checks.

    With the window's `name`, and its neighbour's if the label shows there, issues have messages, unless `texts` is false; `pixels` is the picture's size in words. `place`: a column of geometry.label_geometry(), if there is one.
    """
    t = lambda f: f() if name is not None and texts else None
    shown = lambda: {"name": name, "window": m.place(window), "bounds": m.place(bounds)}
    outside = lambda: F.when(g.intersection_area(bounds, window) <= 0, m.text("LABEL_OUTSIDE_WINDOW/away", where=m.where_instead(neighbour), **shown())).otherwise(m.text("LABEL_OUTSIDE_WINDOW", over=_over(window, bounds), **shown()))
    margin = lambda: F.when(clearance > 0, m.said(" (z odstępem ", m.mm(clearance), " od krawędzi)")).otherwise("")
    large = lambda: m.text("LABEL_TOO_LARGE", size=m.size(bounds), name=name, room=m.size(g.deflate(window, clearance)), margin=margin())
    close = lambda: m.text("LABEL_TOO_CLOSE_TO_EDGE", name=name, clearance=m.mm(clearance), over=_over(g.deflate(window, clearance), bounds))
    of_place = lambda p: issues(
        issue(p.isin("not_overlapping", "outside"), "LABEL_OUTSIDE_WINDOW", said=t(outside)), issue(p == "too_large", "LABEL_TOO_LARGE", said=t(large)), issue(p == "too_close", "LABEL_TOO_CLOSE_TO_EDGE", said=t(close)),
    )
    placed = of_place(place) if place is not None else bind(g.label_geometry(bounds, window, clearance), of_place)
    if not rules.read_barcode:
        return placed
    read, valid, kind = barcode.isNotNull(), F.coalesce(number["is_valid"], F.lit(False)), number["type"]
    banned = ((kind == "Domestic") & (not rules.domestic)) | ((kind == "International") & (not rules.international))
    of = lambda i: F.when(kind == "Domestic", m.KINDS["Domestic"][i]).otherwise(m.KINDS["International"][i])
    low = lambda: m.text("LABEL_LOW_RESOLUTION", module=m.decimal(module_px), pixels=pixels if pixels is not None else F.lit("?"), size=m.size(bounds))
    return F.concat(placed, issues(
        issue(~read, "LABEL_UNREADABLE", "Inconclusive", t(lambda: m.text("LABEL_UNREADABLE", problem=m.UNREAD))), issue(read & ~valid, "LABEL_NUMBER_INVALID", said=t(lambda: m.text("LABEL_NUMBER_INVALID", problem=m.number_problem(number)))),
        issue(read & valid & banned, "LABEL_TYPE_NOT_ALLOWED", said=t(lambda: m.text("LABEL_TYPE_NOT_ALLOWED", own=of(0), human=number["human"], other=of(1)))),
        issue(read & expected.isNotNull() & (number["normalized"] != expected), "LABEL_NUMBER_MISMATCH", said=t(lambda: m.text("LABEL_NUMBER_MISMATCH", number=number["normalized"], expected=expected))),
        issue(read & valid & (kind == "Domestic") & ~gs1, "LABEL_BARCODE_NOT_GS1", "Warning", t(lambda: m.text("LABEL_BARCODE_NOT_GS1"))), issue(read & (module_px < rules.min_module_px), "LABEL_LOW_RESOLUTION", "Warning", t(low)),
    ))


def window_outcome(found: Column, found_issues: Column) -> Column:
    """Invalid if nothing was found or there is an error, else Inconclusive if an issue is, else Valid."""
    has = lambda level: F.array_contains(found_issues["severity"], level)
    return F.when(~found | has("Error"), "Invalid").when(has("Inconclusive"), "Inconclusive").otherwise("Valid")


def document_outcomes(windows: DataFrame) -> DataFrame:
    """doc, outcome and counts over rows of doc, role, outcome and issues; a document is as bad as its worst window, Invalid before Inconclusive."""
    any_ = lambda o: F.bool_or(F.col("outcome") == o)
    level = lambda s: F.sum(F.size(F.filter("issues", lambda i: i["severity"] == s))).cast("bigint")
    return windows.groupBy("doc").agg(
        F.when(any_("Invalid"), "Invalid").when(any_("Inconclusive"), "Inconclusive").otherwise("Valid").alias("outcome"),
        F.count(F.lit(1)).alias("n_windows"), level("Error").alias("n_errors"), level("Warning").alias("n_warnings"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "outcome"))), lambda w: F.concat_ws(": ", w["role"], w["outcome"])), "; ").alias("summary"),
    )
