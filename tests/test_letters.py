import random

import pytest
from pyspark.sql import functions as F

from fenestra.functions import addresses as ad
from fenestra.functions import geometry as g
from fenestra.functions import messages as m
from fenestra.sources import files
from fenestra.operators import glyphs, layouts, requests, rules, scans, selection


def lines(spark, value, f):
    return spark.createDataFrame([(value,)], "v array<string>").select(f(F.col("v")).alias("r")).first()["r"]


def test_c65_layout():
    by = {(n, r): x for n, r, *x in layouts.layouts()}
    assert by["c65_two", "recipient"] == [119, 54, 71, 30, 1] and by["c65_two", "sender"] == [28, 64, 51, 15, 1]
    with pytest.raises(ValueError):
        layouts.EnvelopeWindow(10, 10, from_left=1, from_right=1, from_top=1).on_envelope(100, 100)
    with pytest.raises(ValueError):
        layouts.on_page(layouts.EnvelopeWindow(20, 20, from_left=0, from_top=0), (229, 114))


@pytest.mark.parametrize("last,verdict", [("00-940 Warszawa", "ok"), ("NIEMCY", "ok"), ("POLSKA", "missing"), ("00940 Warszawa", "missing")])
def test_postal(spark, last, verdict):
    assert lines(spark, ["Jan", "ul. X 1", last], ad.postal_verdict) == verdict
    assert lines(spark, ["Jan", "00-940 Warszawa", last], ad.postal_verdict) == {"POLSKA": "ok", "00940 Warszawa": "text_after"}.get(last, "ok")


def test_matching_keeps_repeats(spark):
    row = spark.createDataFrame([(["Jan  KOWALSKI", "Łódź, Żółta 1"], ["jan kowalski", "JAN KOWALSKI", "lodz zolta 1", "brak", "brak"])], "a array<string>, e array<string>")
    r = row.select(ad.matched_lines(F.col("a"), F.col("e")).alias("n"), ad.missing_lines(F.col("a"), F.col("e")).alias("m")).first()
    assert (r.n, r.m) == (3, ["brak", "brak"])


def test_address_rules(spark):
    codes = lambda v: sorted(i.code for i in lines(spark, v, rules.address_issues))
    assert codes(["Jan", "ul. X 1", "00-940 Warszawa"]) == []
    assert codes([]) == ["ADDRESS_EMPTY"]
    assert codes(["x" * 41, "00-940 Warszawa"]) == ["LINE_TOO_LONG", "TOO_FEW_LINES"]
    assert codes(["«Pole»", "ul. X 1", "miasto @"]) == ["MERGE_FIELDS_PRESENT", "POSTAL_CODE_LINE_MISSING", "UNUSUAL_CHARACTERS"]


def test_lines(spark):
    assert lines(spark, [" a ", "", "b  c"], ad.normalize_lines) == ["a", "b c"]
    assert lines(spark, ["", "a", "", "b"], ad.has_inner_empty) is True and lines(spark, ["", "a", ""], ad.has_inner_empty) is False
    assert lines(spark, ["x" * 70], ad.snippet) == "x" * 59 + "…"


def test_unicode_text(spark):
    normal = lambda x: spark.createDataFrame([(x,)], "v string").select(ad.normalize_text(F.col("v")).alias("r")).first()["r"]
    assert [normal(x) for x in ("Nguyễn", "ŁÓDŹ  ul. Żółta", "Å B́", "ǖ", "straße")] == ["nguyen", "lodz ul zolta", "a b", "u", "straße"]
    assert lines(spark, ["Jan", "  ", "\u00a0ul. X\u2003"], ad.snippet) == "Jan / ul. X" and lines(spark, ["\u00a0a\u2003\u2003b "], ad.normalize_lines) == ["a b"]
    # a merge field that isn't closed on its line hides nothing on the next
    assert lines(spark, ["«a @", "b» #~"], ad.unusual_characters) == ["@", "~"]
    assert lines(spark, [], ad.postal_verdict) == "missing" and lines(spark, ["POLSKA"], ad.postal_verdict) == "missing"


def test_messages(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first()["r"]
    assert [one(m.pt(F.lit(x))) for x in (8.0, 10.5, 12.0)] == ["8 pt", "10,5 pt", "12 pt"] and one(m.mm(F.lit(3.25))) == "3,3 mm"
    assert [one(m.lines_word(F.lit(n))) for n in (1, 2, 5, 12, 22, 25)] == ["wiersz", "wiersze", "wierszy", "wierszy", "wiersze", "wierszy"]
    assert one(m.place(g.rect(1, 2.04, 3, 4.5))) == "[x=1.0, y=2.0, 3.0×4.5 mm]" and one(m.size(g.rect(0, 0, 51, 15))) == "51,0 × 15,0 mm"
    assert one(m.line_too_long(F.lit(2), F.lit("x" * 41), 40)).startswith("Wiersz 2 ma 41 znaków, dopuszczalne jest 40: „x")
    assert one(m.unusual(F.array(F.lit("@"), F.lit("~")))) == "Adres zawiera nietypowe znaki: „@” „~”. Mogą utrudnić odczyt maszynowy."


@pytest.mark.parametrize("rotation,want", [(0, (65 / 72, 781 / 72, 10 / 72, 20 / 72)), (90, (55 / 72, 772 / 72, 10 / 72, 20 / 72)), (-180, (72 / 72, 772 / 72, 10 / 72, 20 / 72)), (630, (72 / 72, 772 / 72, 10 / 72, 20 / 72))])
def test_turned_pages(spark, rotation, want):
    r = spark.range(1).select(g.page_rect(*(F.lit(float(x)) for x in (72, 50, 82, 70)), F.lit(7.0), F.lit(17.0 if rotation == 90 else 9.0), F.lit(rotation), F.lit(842.0)).alias("r")).first()["r"]
    assert tuple(r) == pytest.approx(tuple(25.4 * x for x in want))


def test_glyph_boxes(spark):
    box = lambda ch, x2, y2, turn: tuple(spark.range(1).select(g.glyph_box(F.lit(ch), F.lit(10.0), F.lit(100.0), F.lit(200.0), F.lit(x2), F.lit(y2), F.lit(turn)).alias("r")).first()["r"])
    assert box("a", 106.0, 200.0, 0) == pytest.approx((100, 197.8, 106, 208, 106, 200)) and box("Ż", 106.0, 200.0, 0)[3] == pytest.approx(209.2)
    assert box("a", 100.0, 205.0, 0) == pytest.approx((92, 200, 102.2, 205, 100, 205))
    assert box("a", 100.0, 200.0, 90)[4:] == (100, 205) and box("a", 100.0, 200.0, 180)[4:] == (95, 200)


def plain_blocks(page):
    """Lines by top, then left, each joined to the first block that fits: another way to the same blocks."""
    blocks = []
    for x in sorted(page, key=lambda r: (r[3], r[1], r[0])):
        for b in blocks:
            y = b[-1]
            own = y[4] - y[3]
            if -0.5 * own < x[3] - y[4] <= 0.6 * max(x[4] - x[3], own) and min(x[2], y[2]) > max(x[1], y[1]):
                b.append(x)
                break
        else:
            blocks.append([x])
    return sorted(sorted(x[0] for x in b) for b in blocks)


def test_blocks_of_many_pages(spark):
    r = random.Random(2)
    pages = {}
    for doc in range(200):
        pages[doc] = [(i, left := round(r.uniform(0, 150), 1), left + r.choice([8.0, 30.0, 60.0]), top := r.choice([50 + 4.2 * k for k in range(8)]), top + r.choice([2.5, 3.5, 7.0])) for i in range(r.randint(0, 14))]
    rows = [(doc, True, i, 0, "t", left, right, top, bottom, 1) for doc, page in pages.items() for i, left, right, top, bottom in page]
    found = glyphs.blocks(spark.createDataFrame(rows, "doc bigint, horizontal boolean, row bigint, segment bigint, text string, left double, right double, top double, bottom double, n_glyphs bigint")).collect()
    got = {}
    for x in found:
        got.setdefault(x.doc, {}).setdefault(x.block, []).append(x.row)
    assert {d: sorted(map(sorted, b.values())) for d, b in got.items()} == {d: plain_blocks(p) for d, p in pages.items() if p}


def test_overflow(spark):
    r = spark.range(1).select(g.overflow(g.rect(10, 10, 20, 10), g.rect(9.96, 7.75, 25, 5)).alias("o")).select("o", g.overflow_text(F.col("o")).alias("t")).first()
    assert (r.o.left, r.o.top, r.o.right, r.o.bottom) == (0.0, 2.2, 5.0, 0.0) and r.t == "z prawej o 5,0 mm, u góry o 2,2 mm"


def test_label_geometry(spark):
    w = g.rect(28, 64, 51, 15)
    f = lambda *b: spark.range(1).select(g.label_geometry(g.rect(*b), w, F.lit(1.0)).alias("r")).first()["r"]
    assert [f(29.5, 65.5, 48, 12), f(21, 59, 65, 25), f(29.5, 70, 48, 12), f(28.2, 65.5, 48, 12), f(150, 10, 20, 10)] == ["inside", "too_large", "outside", "too_close", "not_overlapping"]


def test_outcomes(spark):
    rows = [(1, "recipient", []), (1, "sender", [("X", "Inconclusive")]), (2, "recipient", [("Y", "Error")]), (2, "sender", [("X", "Inconclusive")]), (3, "recipient", [("W", "Warning")])]
    d = spark.createDataFrame(rows, "doc int, role string, issues array<struct<code:string,severity:string>>").withColumn("outcome", rules.window_outcome(F.lit(True), F.col("issues")))
    assert {r.doc: r.outcome for r in rules.document_outcomes(d).collect()} == {1: "Inconclusive", 2: "Invalid", 3: "Valid"}


def test_selection_prefers_address_in_window(spark):
    windows = spark.createDataFrame([("l", "r", (119.0, 54.0, 71.0, 30.0))], "layout string, role string, window struct<left:double,top:double,width:double,height:double>")
    parts = [(1, 1, (100.0, 60.0, 80.0, 5.0), 1, False), (1, 2, (121.0, 56.0, 40.0, 15.0), 3, True), (2, 1, (20.0, 20.0, 40.0, 15.0), 3, True), (3, 1, (121.0, 56.0, 40.0, 5.0), 1, False)]
    b = spark.createDataFrame(parts, "doc int, ord int, bounds struct<left:double,top:double,width:double,height:double>, n_lines int, address_like boolean").withColumn("layout", F.lit("l"))
    assert sorted((r.doc, r.ord, r.tier) for r in selection.select_address(b, windows).collect()) == [(1, 2, 1), (2, 1, 2), (3, 1, 3)]


def test_glyphs(spark):
    rows = [(1, 0, "Jan", 25.0, 30.0, 50.0), (1, 1, "K", 31.0, 33.0, 50.5), (1, 2, "far", 60.0, 66.0, 50.2), (1, 3, "next", 25.0, 31.0, 54.2)]
    d = spark.createDataFrame(rows, "doc bigint, ord bigint, text string, along double, along_end double, cross double").withColumns({"size": F.lit(3.5), "horizontal": F.lit(True)})
    found = glyphs.lines(glyphs.segments(glyphs.rows(d)))
    assert sorted(r.text for r in found.collect()) == ["Jan K", "far", "next"]
    assert {r.text: r.block for r in glyphs.blocks(found).collect()} == {"Jan K": 0, "far": 1, "next": 0}
    assert glyphs.blocks(found.where("false")).count() == 0


def test_requests(spark):
    r = spark.createDataFrame([("data:image/png;BASE64,QUJD",), ("%%%",), (None,)], "t string").select(requests.decode_base64(F.col("t")).alias("b")).collect()
    assert [x.b for x in r] == [bytearray(b"ABC"), None, None]
    o = [("Single", ["a", "b"], "x"), ("Double", ["a", "b"], "  "), ("Double", ["a", " "], "x"), ("Other", ["a", "b"], None)]
    d = requests.validate_orders(spark.createDataFrame(o, "envelope string, recipient_lines array<string>, registered_number string"))
    assert [(x.number, x.problem) for x in d.collect()] == [(None, None), (None, "number_missing"), ("x", "recipient_lines"), (None, "unknown_envelope")]
    ids = ["000000c8-4f89-11d3-9a0c-0305e82c3301", "00000000-0000-0000-0000-000000000000", "x"]
    assert [x[0] for x in spark.createDataFrame([(i,) for i in ids], "i string").select(requests.form_house_number(F.col("i"))).collect()] == [1, None, None]


def test_tiles_find_every_overlap_once(spark):
    """Thousands of windows: pairs from the grid are those of all comparisons."""
    r = random.Random(4)
    box = lambda: (round(r.uniform(-50, 300), 1), round(r.uniform(-50, 300), 1), r.choice([0.0, 1.0, 12.5, 140.0]), r.choice([0.0, 3.0, 70.0]))
    parts, windows = [(i, i % 3, box()) for i in range(150)], [(i, i % 3, box()) for i in range(2000)]
    kind = "struct<left:double,top:double,width:double,height:double>"
    found = selection.overlapping(spark.createDataFrame(parts, f"p int, k int, bounds {kind}"), spark.createDataFrame(windows, f"w int, k int, window {kind}"), ["k"], 20.0)
    got = [(x.p, x.w) for x in found.select("p", "w").collect()]
    over = lambda a, b: min(a[0] + a[2], b[0] + b[2]) > max(a[0], b[0]) and min(a[1] + a[3], b[1] + b[3]) > max(a[1], b[1])
    want = {(p, w) for p, k, a in parts for w, j, b in windows if k == j and a[2] * a[3] * b[2] * b[3] > 0 and over(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_cross_ranges(spark):
    """Ranges without rows between, ties and single rows: the same as over the whole sequence."""
    r = random.Random(5)
    rows = [(k, float(r.choice([0, 1, 2, 250, 251, 900, 5000])) + r.randrange(3), i, r.randrange(9)) for k in range(4) for i in range(r.choice([1, 30]))]
    d = spark.createDataFrame(rows, "k int, x double, i int, v int")
    got = scans.carried(d, ["k"], F.floor(F.col("x") / 100), [F.col("x"), F.col("i")], {"pv": F.col("v")})
    got = scans.counted(got, ["k"], F.floor(F.col("x") / 100), [F.col("x"), F.col("i")], F.coalesce((F.col("v") > F.col("pv")).cast("int"), F.lit(0)), "n").collect()
    assert len(got) == len(rows)
    by = {(x.k, x.i): x for x in got}
    for k in range(4):
        before, n = None, 0
        for _, x, i, v in sorted((y for y in rows if y[0] == k), key=lambda y: (y[1], y[2])):
            n += before is not None and v > before
            assert (by[k, i].pv, by[k, i].n) == (before, n)
            before = v


def test_one_long_row_of_glyphs(spark, monkeypatch):
    """A document of one line is scanned by ranges; many directions and crosses stay apart."""
    monkeypatch.setattr(glyphs, "SEGMENT_RANGE", 30.0)
    monkeypatch.setattr(glyphs, "ROW_RANGE", 5.0)
    r = random.Random(6)
    rows, x = [], 0.0
    for i in range(400):
        x += r.choice([2.0, 2.0, 3.5, 20.0])
        rows.append((1, i, r.choice(["a", "b", " "]), x, x + 2.0, 50.0 + r.choice([0, 0, 0.4]), True))
        rows.append((1, 1000 + i, "c", 10.0, 12.0, 7.0 * i, False))
    d = spark.createDataFrame(rows, "doc bigint, ord bigint, text string, along double, along_end double, cross double, horizontal boolean").withColumn("size", F.lit(3.5))
    found = glyphs.lines(glyphs.segments(glyphs.rows(d))).collect()
    assert sum(not y.horizontal for y in found) == 400 == len({y.row for y in found if not y.horizontal})
    want, before = [[]], None
    for y in sorted((y for y in rows if y[6]), key=lambda y: (y[3], y[1])):
        if before and y[3] - before[4] > 3 * 3.5:
            want.append([])
        elif before and y[3] - before[4] > 0.25 * 3.5 and y[2].strip() and before[2].strip():
            want[-1].append(" ")
        want[-1].append(y[2])
        before = y
    assert ["".join(w) for w in want] == [y.text for y in sorted((y for y in found if y.horizontal), key=lambda y: y.segment)]


def test_a_render_serves_one_document(spark):
    docs = [(1, b"a", "x"), (2, b"a", "y"), (3, b"a", "x"), (4, b"b", None), (5, None, "x"), (6, b"c", "none"), (7, b"a", "none")]
    renders = [(20, "a", None, "second"), (10, "a", "y", "first"), (30, "z", "x", "by name"), (40, "z", "x", "later"), (50, None, None, "nothing")]
    r = spark.createDataFrame(renders, "ord bigint, c string, file_name string, pdf string").withColumn("sha256", F.sha2(F.col("c").cast("binary"), 256)).drop("c")
    got = requests.with_rendered(spark.createDataFrame(docs, "ord bigint, content binary, file_name string"), r).collect()
    assert {x.ord: x.pdf for x in got} == {1: "first", 2: "second", 3: "by name", 4: None, 5: "by name", 6: None, 7: None} and len(got) == 7


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("b.pdf", b"%PDF-1.7 x"), ("sub/a.pdf", b"%PDF-1.4 yy"), ("c.pdf", b"no document"), ("d.pdf", b""), ("e.pdf", b"%PDF-" + b"z" * 500), ("f.txt", b"%PDF-1.7")):
        (tmp_path / name).write_bytes(body)
    found = files.read_documents(spark, str(tmp_path), largest=100)
    got = {x.path.rsplit("/", 1)[1]: (x.problem, None if x.content is None else bytes(x.content)) for x in found.collect()}
    assert got == {"b.pdf": (None, b"%PDF-1.7 x"), "a.pdf": (None, b"%PDF-1.4 yy"), "c.pdf": ("unreadable", b"no document"), "e.pdf": ("too_large", None)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan and "GreaterThan(length,100)" in plan
    order = [(x.path.rsplit("/", 1)[1], x.mode) for x in files.each_mode(found).collect()]
    assert order[:2] == [("b.pdf", "Single"), ("b.pdf", "Double")] and order[-1] == ("a.pdf", "Double") and len(order) == 8
