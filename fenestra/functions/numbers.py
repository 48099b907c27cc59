"""Registered-mail numbers: domestic (GS1 SSCC, 20 digits) and international (UPU S10, 13 characters), as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the S10 standard: weights of the eight digits.
S10_WEIGHTS = (8, 6, 4, 2, 3, 5, 9, 7)


def normalize_number(raw: Column) -> Column:
    """Upper-case ASCII letters and digits only. Stripped before upper(), which would turn one letter outside ASCII into two inside."""
    return F.upper(F.regexp_replace(raw, "[^A-Za-z0-9]", ""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once for a row and hand it to `body`; else an expression is evaluated again wherever it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def apart(c: Column) -> Column:
    """The column itself, which should be cheap, in a form that keeps its projection out of Spark's whole-stage code.

    That is one method a stage, and HotSpot compiles none of more than 8,000 bytes of code, which would be interpreted for every row; a projection of its own is split into small methods.
    """
    return F.get(F.transform(F.array(c), lambda x: x), 0)


def _digits(s: Column, n: int) -> list[Column]:
    """The n digits of a string, as numbers. Plain columns: a lambda's body is interpreted, also where all around it is compiled."""
    return [F.substring(s, i + 1, 1).try_cast("int") for i in range(n)]


def gs1_check_digit(body: Column) -> Column:
    """The check digit of 17 digits, weighted 3 and 1 in turn from the right; null for anything else."""
    total = lambda d: sum((x * (1 if i % 2 else 3) for i, x in enumerate(d)), F.lit(0))
    return F.when(body.rlike("^[0-9]{17}$"), ((10 - total(_digits(body, 17)) % 10) % 10).cast("int"))


def s10_check_digit(serial: Column) -> Column:
    """The check digit of 8 digits; null for anything else."""

    # of what is left of 11, 10 becomes 0 and 11 becomes 5; `rest` is 0 to 10
    rest = sum((x * w for x, w in zip(_digits(serial, 8), S10_WEIGHTS)), F.lit(0)) % 11
    return F.when(serial.rlike("^[0-9]{8}$"), F.element_at(F.array(*[F.lit(d) for d in (5, 0, 9, 8, 7, 6, 5, 4, 3, 2, 1)]), (rest + 1).cast("int")))


DOMESTIC, FOREIGN = "^[0-9]{20}$", "^[A-Z]{2}[0-9]{9}[A-Z]{2}$"


def _printed(n: Column, domestic: Column, foreign: Column) -> Column:
    sub = lambda a, k: F.substring(n, a, k)
    own = F.concat(F.lit("(00)"), sub(3, 8), F.lit(" "), sub(11, 1), F.lit(" "), sub(12, 8), F.lit(" "), sub(20, 1))
    return F.when(domestic & n.startswith("00"), own).when(foreign, F.concat_ws(" ", sub(1, 2), sub(3, 3), sub(6, 3), sub(9, 3), sub(12, 2)))


def human_readable(n: Column) -> Column:
    """A normalized number as printed; null if it has neither form."""
    return bind(n, lambda x: _printed(x, x.rlike(DOMESTIC), x.rlike(FOREIGN)))


def _wrong(n: Column, d: Column, f: Column, check: bool) -> Column:
    """What is wrong with a normal form that has the domestic form (d), the foreign one (f), or neither; null for nothing."""
    last = lambda i: F.substring(n, i, 1).cast("int")
    wrong = F.when(d, gs1_check_digit(F.substring(n, 3, 17)) != last(20)).when(f, s10_check_digit(F.substring(n, 3, 8)) != last(11)) if check else F.lit(False)
    return F.when(apart(n == ""), "empty").when(~d & ~f, "not_a_number").when(d & ~n.startswith("00"), "wrong_prefix").when(wrong, "wrong_check_digit")


def _parsed(n: Column, d: Column, f: Column, problem: Column) -> Column:
    return F.struct(F.when(d, "Domestic").when(f, "International").alias("type"), n.alias("normalized"), _printed(n, d, f).alias("human"), apart(problem.isNull()).alias("is_valid"), problem.alias("problem"))


def parse_number(raw: Column, check: bool = True) -> Column:
    """type, normalized, human, is_valid and problem of a number, its form told by itself.

    problem is null for a valid number, else one of empty, not_a_number, wrong_prefix, wrong_check_digit. With `check` false, check digits
    aren't compared. A null number is an empty one. The normal form, then the kind, then the check are evaluated once each.
    """

    def kinds(n: Column) -> Column:
        return bind(F.struct(n.alias("n"), n.rlike(DOMESTIC).alias("d"), n.rlike(FOREIGN).alias("f")), parsed)

    def parsed(x: Column) -> Column:
        n, d, f = x["n"], x["d"], x["f"]
        return bind(_wrong(n, d, f, check), lambda p: _parsed(n, d, f, p))

    return bind(normalize_number(F.coalesce(raw, F.lit(""))), kinds)


def with_number(df: DataFrame, raw: str, name: str) -> DataFrame:
    """df with parse_number() of its column `raw` as the column `name`. What it goes through are columns, which Spark compiles, while the body of a bind() is interpreted."""
    n, d, f, p = (f"_{name}_{x}" for x in "ndfp")
    x = df.withColumn(n, normalize_number(F.coalesce(F.col(raw), F.lit(""))))
    x = x.withColumns({d: F.col(n).rlike(DOMESTIC), f: F.col(n).rlike(FOREIGN)})
    x = x.withColumn(p, _wrong(F.col(n), F.col(d), F.col(f), True))
    return x.withColumn(name, _parsed(F.col(n), F.col(d), F.col(f), F.col(p))).drop(n, d, f, p)


def parse_typed(raw: Column, kind: Column, check: bool = True) -> Column:
    """parse_number() of a number whose kind is stated; another kind is the problem wrong_type."""

    def typed(p: Column) -> Column:
        other = p["type"].isNotNull() & (p["type"] != kind)
        return F.struct(p["type"].alias("type"), p["normalized"].alias("normalized"), p["human"].alias("human"), (p["is_valid"] & ~other).alias("is_valid"), F.when(other, "wrong_type").otherwise(p["problem"]).alias("problem"))

    return bind(parse_number(raw, check), typed)
