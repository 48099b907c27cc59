"""Steps whose cost must not grow faster than their input: how often rows are exchanged, and that both ways to one result agree."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenestra.functions import addresses as ad
from fenestra.functions import numbers
from fenestra.operators import barcode, glyphs, selection
from fenestra.operators.layouts import layout_windows, layouts
from fenestra.plans import page_queries
from fenestra.plans import queries as q
from fenestra.sources import derived

SMALL = "/root/testdata/sf0.001"
RECT = "struct<left:double,top:double,width:double,height:double>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", ["block_select_address", "block_select_expected", "label_select", "other_text_in_window", "unclaimed_blocks"])
def test_parts_are_exchanged_once(spark, name):
    text = plan(q.QUERIES[name](spark, SMALL))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


@pytest.mark.parametrize("name", ["label_geometry", "rect_measures", "window_overflow"])
def test_windows_not_parts_are_broadcast(spark, name):
    text = plan(q.QUERIES[name](spark, SMALL))
    assert "BuildRight" in text and "BuildLeft" not in text


@pytest.mark.parametrize("named", [False, True])
def test_few_and_many_windows_choose_alike(spark, monkeypatch, named):
    r = random.Random(7)
    box = lambda: (float(r.randrange(200)), float(r.randrange(120)), float(r.choice([0, 20, 60])), float(r.choice([4, 20])))
    parts = [(d, o, box(), r.randrange(1, 9), r.random() < 0.5, r.randrange(3), r.random() < 0.5, r.randrange(2), r.choice([None, 0, 1]), r.choice(["c65_two", "dl_two_left", "nowhere"])) for d in range(60) for o in range(r.randrange(1, 6))]
    b = spark.createDataFrame(parts, f"doc int, ord int, bounds {RECT}, n_lines int, address_like boolean, matched int, valid boolean, number int, expected int, layout string")
    b, w = b if named else b.drop("layout"), layout_windows(spark)

    def all_of():
        return [
            rows(selection.select_address(b, w), "doc", "layout", "role", "ord", "tier", "score"), rows(selection.select_expected(b, w), "doc", "layout", "role", "ord", "matched"),
            rows(selection.select_label(b, w), "doc", "layout", "role", "ord", "tier"), rows(selection.other_text(b, w), "doc", "layout", "role", "ord"), rows(selection.unclaimed(b, w), "layout", "doc", "ord"),
        ]

    few = all_of()
    monkeypatch.setattr(selection, "FEW", 0)
    assert few == all_of() and all(few)
    if not named:
        every = b.withColumn("layout", F.explode(F.array(*[F.lit(n) for n in sorted({n for n, *_ in layouts()})])))
        assert few[0] == rows(selection.select_address(every, w), "doc", "layout", "role", "ord", "tier", "score")


def test_levels_give_the_rows_and_lines_of_glyphs(spark):
    """Glyphs held in levels: the same rows, segments and texts as glyphs one by one; crosses that are near share a row."""
    r = random.Random(8)
    flat = []
    for doc in range(40):
        for i in range(r.randrange(1, 40)):
            at = r.uniform(0, 200)
            flat.append((doc, i, r.choice(["a", "bc", " ", "Ż"]), r.random() < 0.8, r.choice([2.0, 3.5]), r.choice([50.0, 50.5, 51.1, 54.2]), at, at + r.choice([-2.0, 2.0, 9.0])))
    d = spark.createDataFrame(flat, "doc bigint, ord bigint, text string, horizontal boolean, size double, cross double, along double, along_end double")
    levels = d.groupBy("doc", "horizontal", "cross").agg(F.min_by("size", "ord").alias("first_size"), F.max_by("size", "ord").alias("last_size"), F.collect_list(F.struct("ord", "text", "size", "cross", "along", "along_end")).alias("g"))
    found = glyphs.level_rows(levels).withColumn("glyphs", glyphs.in_order(F.flatten(F.transform("levels", lambda x: x["g"]))))
    columns = ["doc", "horizontal", "row", "segment", "text", "left", "right", "top", "bottom", "n_glyphs"]
    assert rows(glyphs.level_lines(found), *columns) == rows(glyphs.lines(glyphs.segments(glyphs.rows(d))), *columns)


@pytest.mark.parametrize("name", ["glyph_rows", "glyph_segments", "line_text", "line_blocks"])
def test_texts_are_exchanged_once(spark, name):
    text = plan(q.QUERIES[name](spark, SMALL))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_sums_before(spark, monkeypatch):
    monkeypatch.setattr(derived, "RUN", 4)
    for n in (1, 3, 4, 5, 16, 17, 50):
        got = spark.range(1).select(derived.before(F.array(*[F.lit(i % 7) for i in range(n)])).alias("s")).first().s
        assert got == [sum(i % 7 for i in range(k)) for k in range(n)]


def test_every_symbol_of_a_row_is_matched_at_once():
    """Long symbols, symbols that break off and noise: what matching one by one reads."""
    from fenestra.functions.code128 import MODULES

    def one_by_one(widths, first_dark):
        for i in range(0 if first_dark else 1, len(widths) - 12, 2):
            start = barcode._match(widths[i : i + 6], slice(103, 106))
            if not start or (i and widths[i - 1] < 3 * start[1]):
                continue
            found, units, at = [start[0]], [start[1]], i + 6
            while at + 6 <= len(widths) and len(found) <= 80:
                if at + 7 <= len(widths):
                    tail = widths[at : at + 7]
                    unit = tail.sum() / 13
                    if abs(unit - units[-1]) < 0.25 * units[-1] and np.abs(tail / unit - [2, 3, 3, 1, 1, 1, 2]).max() <= barcode.LARGEST_ERROR:
                        return [*found, 106], float(np.mean(units))
                nxt = barcode._match(widths[at : at + 6], slice(0, 103))
                if not nxt:
                    break
                found.append(nxt[0])
                units.append(nxt[1])
                at += 6
        return None

    r = random.Random(9)
    rng = np.random.default_rng(9)
    for n in [*range(1, 30), 78, 79, 80, 81, 82, 120]:
        bits = "".join(MODULES[x] for x in [r.choice([103, 104, 105]), *[r.randrange(103) for _ in range(n)], 106])
        for noise in (0, 6, 30):
            px = np.clip(barcode.raster(bits, r.choice([2, 3]))[0].astype(int) + rng.integers(-noise, noise + 1, 1), 0, 255).astype(np.uint8)
            px = px[: r.choice([len(px), len(px) * 2 // 3])]
            widths, dark = barcode.run_widths(px)
            widths = widths + rng.uniform(-noise / 20, noise / 20, len(widths))
            assert barcode.read_symbols(widths, dark) == one_by_one(widths, dark)


def test_pictures_keep_their_pixels():
    r = np.random.default_rng(3)
    drawn = barcode.raster("110100" * 20)
    for px in (drawn, r.integers(0, 256, (7, 31)).astype(np.uint8), drawn[:1]):
        assert (barcode.png_gray(barcode.gray_png(px)) == px).all()
    data = barcode.gray_png(drawn)
    at = data.index(b"IDAT")
    stored = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")]), np.uint8).reshape(len(drawn), -1)
    assert (stored[0, 1:] == drawn[0]).all() and (stored[1:, 0] == 2).all() and not stored[1:, 1:].any()


@pytest.mark.parametrize("name", ["inspect_page", "page_issue_counts"])
def test_verdicts_and_counts_write_no_messages(spark, name):
    df = q.QUERIES[name](spark, SMALL)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "message" not in text and "WINDOW_NOT_FOUND" in text


def test_counts_do_not_deal_issues_out_by_page(spark):
    text = plan(q.QUERIES["page_issue_counts"](spark, SMALL))
    assert not [x for x in text.split("\n") if "Exchange hashpartitioning(" in x and "code" in x and "doc" in x]


def test_folded_lines_match_alike(spark):
    """Lines normalized at once hold what lines normalized one by one are found to have."""
    texts = ["Łódź 1", "lodz 1", " ŁÓDŹ,1 ", "a\nb", "a b", "b", "", "?", "Σας", "ΣΑΣ", "é x", "e x", "e  X!", " Jan "]
    r = random.Random(4)
    data = [(i, r.choices(texts, k=r.randrange(6)), r.choices(texts, k=r.randrange(4))) for i in range(300)]
    d = spark.createDataFrame(data, "i int, a array<string>, e array<string>")
    have = ad.folded_lines(F.col("a"))
    hits = numbers.bind(have, lambda h: F.filter(ad.wanted_lines(F.col("e")), lambda x: h.contains(x["n"])))
    rest = numbers.bind(have, lambda h: F.transform(F.filter(ad.wanted_lines(F.col("e")), lambda x: ~h.contains(x["n"])), lambda x: x["e"]))
    got = d.select(F.size(hits).alias("n"), ad.matched_lines(F.col("a"), F.col("e")).alias("m"), rest.alias("r"), ad.missing_lines(F.col("a"), F.col("e")).alias("s")).collect()
    assert all(x.n == x.m and x.r == x.s for x in got) and any(x.n for x in got)


def test_pictures_read_at_once_are_read_alike(monkeypatch):
    """Many pictures at once give what each gives by itself; only those that aren't plain are read one by one."""
    from fenestra.functions.code128 import MODULES

    r, rng = random.Random(11), np.random.default_rng(11)

    def symbol(check=0):
        data = r.choice([[105, 102, *[r.randrange(100) for _ in range(10)]], [104, 50, 50, 99, 47, 31, 24, 82, 100, 25, 48, 44], [103, *[r.randrange(64) for _ in range(r.randrange(1, 90))]]])
        return "".join(MODULES[x] for x in [*data, (data[0] + sum(i * x for i, x in enumerate(data[1:], 1)) + check) % 103, 106])

    drawn = [barcode.raster(symbol(), r.choice([2, 3])) for _ in range(40)]
    gray = [np.clip(p.astype(int) // 2 + 40 + rng.integers(-3, 4, (1, p.shape[1])), 0, 255).astype(np.uint8) for p in drawn[:10]]
    odd = [drawn[0][:, ::-1], barcode.raster(symbol(1)), drawn[0][:, 30:], drawn[1][:, :-200], np.full((20, 300), 200, np.uint8), rng.integers(0, 256, (7, 90)).astype(np.uint8), drawn[2][:1], np.zeros((3, 1), np.uint8), 255 - drawn[3]]
    pictures = drawn + gray + odd
    got = barcode.read_pictures([*map(barcode.gray_png, pictures), None, b"nonsense"])
    for px, g in zip(pictures, got):
        one = barcode.decode(px)
        assert (g[:2], g[3], g[4]) == (one[:2], one[3], None) and abs(g[2] - one[2]) < 1e-9 if one else g == (None, None, None, None, "no_barcode")
    assert [g[4] for g in got[-2:]] == ["no_image", "not a PNG"] and sum(g[0] is not None for g in got) > 45

    def never(*_):
        raise AssertionError("read by itself")

    monkeypatch.setattr(barcode, "decode", never)
    of = [i for i, g in enumerate(got[:40]) if g[0] is not None]
    assert [barcode.read_pictures([barcode.gray_png(drawn[i])])[0] == got[i] for i in of] == [True] * len(of)


def test_equal_rows_are_packed_once():
    """A drawn label's file is a whole PNG with the pixels of the symbol."""
    for modules in ("110100" * 20, "1", "10" * 300):
        px = barcode.raster(modules)
        data = barcode.repeated_png(px[0].tobytes(), barcode.HEIGHT, 300)
        assert (barcode.png_gray(data) == px).all() and data[:54] == barcode.gray_png(px, 300)[:54]
        at = 8
        while at < len(data):
            n = int.from_bytes(data[at : at + 4], "big")
            assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
            at += n + 12


def test_texts_of_lines_tell_what_lines_tell(spark):
    """What is worked out on one text of lines is what is worked out line by line, odd white space, nulls and line ends in lines included."""
    texts = ["Jan", " Jan ", "", " ", " ", " Łódź\t", "00-940 Warszawa", "00940", "12", "-345 Gdańsk", "POLSKA", "Polska", "NIEMCY", "«Pole»", "«a", "b»", "{{x}} ~", "§ 1 €", "x" * 41, "y" * 61, "a\nb", "00\n-940", None, "a  b", "ul. Prosta\r1", "RÉPUBLIQUE FRANÇAISE", "\x85", "\u00a0x\u2003", "MERGEFIELD ~"]
    r = random.Random(5)
    data = [(i, r.choices(texts, k=r.randrange(9))) for i in range(600)] + [(600, ["c"] * 7 + ["00-940"]), (601, ["c"] * 7 + ["A B"]), (602, ["c"] * 7)]
    d = spark.createDataFrame(data, "i int, raw array<string>").withColumn("l", F.array_compact("raw"))
    d = d.withColumn("j", ad.joined(F.col("raw"))).withColumn("p", ad.is_plain(F.col("j"), F.col("raw"))).withColumn("t", F.when(F.col("p"), F.col("j")).otherwise(F.array_join(ad.without_breaks(F.col("raw")), "\n")))
    d = d.withColumns({"tidy": ad.tidy(F.col("t")), "own": F.array_remove(F.split(ad.own_text(F.col("t")), "\n"), "")}).withColumn("f", ad.filled(F.col("tidy")))
    lines, own, text = F.col("l"), F.col("own"), ad.own_text(F.col("t"))
    pairs = {
        "own": (own, ad.normalize_lines(lines)), "like": (ad.like_address(F.col("f"), ad.count_lines(F.col("f"))), ad.looks_like_address(lines)), "n": (ad.count_lines(F.col("f")), F.size(ad.non_empty_lines(lines))),
        "gap": (ad.has_gap(F.col("tidy")), ad.has_inner_empty(lines)), "snippet": (F.when(F.col("p"), ad.snippet_of(F.col("f"))), F.when(F.col("p"), ad.snippet(lines))), "field": (ad.has_merge_field_in(text), ad.has_merge_field(own)),
        "odd": (ad.unusual_characters_in(text), ad.unusual_characters(own)), "verdict": (ad.postal_verdict_of(own, text), ad.postal_verdict(own)), "home": (ad.postal_verdict_of(own, text, False), ad.postal_verdict(own, False)),
    }
    for x in d.select("raw", *[F.struct(a.alias("a"), b.alias("b")).alias(f"of_{k}") for k, (a, b) in pairs.items()]).collect():
        for k in pairs:
            assert x[f"of_{k}"].a == x[f"of_{k}"].b, (k, x.raw)


def test_numbers_as_columns_are_parsed_alike(spark):
    raws = ["00759007731512000621", "(00) 7 5900773 1 51200062 1", "00759007731512000622", "0075900773151200062", "01759007731512000621", "rr473124829pl", "RR473124820PL", "R1473124829PL", "", None, "ß"]
    d = numbers.with_number(spark.createDataFrame([(x,) for x in raws], "raw string"), "raw", "n")
    assert all(x.n == x.m for x in d.withColumn("m", numbers.parse_number(F.col("raw"))).collect()) and d.columns == ["raw", "n"]


@pytest.mark.parametrize("name", ["page_issue_counts", "page_json", "overlay_rows"])
def test_blocks_are_chosen_in_compiled_rows(spark, name):
    """No page's blocks or pictures are gathered before they are chosen."""
    text = plan(q.QUERIES[name](spark, SMALL))
    assert "ObjectHashAggregate" not in text and text.count("Window") >= 3
