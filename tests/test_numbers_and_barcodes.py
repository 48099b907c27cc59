import numpy as np
import pytest
from pyspark.sql import functions as F

from fenestra.functions import code128 as c
from fenestra.functions import numbers as n
from fenestra.operators import barcode


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("body,digit", [("75900773151200062", 1), ("75900773151200063", 8), ("75900773151200064", 5), ("1", None)])
def test_gs1_check_digit(spark, body, digit):
    assert one(spark, body, n.gs1_check_digit) == digit


@pytest.mark.parametrize("serial,digit", [("47312482", 9), ("47312485", 0), ("47312488", 5), ("x", None)])
def test_s10_check_digit(spark, serial, digit):
    assert one(spark, serial, n.s10_check_digit) == digit


@pytest.mark.parametrize("raw", ["00759007731512000621", "(00) 7 5900773 1 51200062 1", "00-7590-0773-1-5120-0062-1"])
def test_domestic(spark, raw):
    p = one(spark, raw, n.parse_number)
    assert (p.type, p.normalized, p.human, p.is_valid) == ("Domestic", "00759007731512000621", "(00)75900773 1 51200062 1", True)


@pytest.mark.parametrize("raw", ["RR473124829PL", "rr473124829pl", "RR 473 124 829 PL"])
def test_international(spark, raw):
    p = one(spark, raw, n.parse_number)
    assert (p.type, p.human, p.is_valid) == ("International", "RR 473 124 829 PL", True)


@pytest.mark.parametrize("raw,problem", [("00759007731512000622", "wrong_check_digit"), ("0075900773151200062", "not_a_number"), ("01759007731512000621", "wrong_prefix"), ("R1473124829PL", "not_a_number"), ("", "empty"), (None, "empty"), ("ß", "empty")])
def test_problems(spark, raw, problem):
    assert one(spark, raw, n.parse_number).problem == problem


def test_pattern_table():
    assert len(c.PATTERNS) == 107 == len(set(c.PATTERNS)) and c.PATTERNS[106] == "2331112"
    assert all(sum(map(int, p)) == 11 and sum(map(int, p[::2])) % 2 == 0 for p in c.PATTERNS[:106])


def test_symbols(spark):
    assert one(spark, "PJJ123C", lambda x: c.with_check(c.text_symbols(x))) == [104, 48, 42, 42, 17, 18, 19, 35, 55, 106]
    for f in (c.s10_symbols, c.text_symbols):
        assert one(spark, "RR473124829PL", f) == [104, 50, 50, 99, 47, 31, 24, 82, 100, 25, 48, 44]
    bits = one(spark, "00759007731512000621", lambda x: c.bits(c.with_check(c.gs1_symbols(x))))
    assert len(bits) == 156 and bits.startswith(c.MODULES[105] + c.MODULES[102]) and bits.endswith(c.MODULES[106])
    assert one(spark, "123", c.gs1_symbols) is None and one(spark, "ł", c.text_symbols) is None


@pytest.mark.parametrize("text", ["RR473124829PL", "PJJ123C", "12", "123", "A1234567B", "x 12345 y"])
def test_round_trip(spark, text):
    bits = one(spark, text, lambda x: c.bits(c.with_check(c.text_symbols(x))))
    px = barcode.raster(bits)
    assert barcode.decode(px)[:2] == (text, False)
    assert barcode.decode(px[:, ::-1])[0] == text
    noisy = np.clip(px.astype(int) + np.random.default_rng(1).integers(-30, 30, px.shape), 0, 255).astype(np.uint8)
    assert barcode.decode(noisy)[0] == text


def test_damage_is_not_read():
    assert barcode.decode(np.full((20, 300), 200, np.uint8)) is None


def test_png(spark):
    px = np.random.default_rng(2).integers(0, 255, (5, 9)).astype(np.uint8)
    data = barcode.gray_png(px, 300)
    assert (barcode.png_gray(data) == px).all() and data[33:54] == b"\x00\x00\x00\x09pHYs\x00\x00\x2e\x23\x00\x00\x2e\x23\x01" + data[50:54]
    r = spark.createDataFrame([(b"nonsense",), (None,)], "b binary").select(barcode.read_label(F.col("b")).alias("r")).collect()
    assert [x.r.problem for x in r] == ["not a PNG", "no_image"]
