"""Code 128 symbols and modules, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the Code 128 standard: widths of bars and spaces in modules, by symbol value; 103 to 105 start sets A, B, C, 106 stops.
PATTERNS = """
212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221 223211 221132
221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321 232121 111323 131123 131321 112313 132113 132311 211313
231113 231311 112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131 311123 311321 331121 312113 312311 332111
314111 221411 431111 111224 111422 121124 121421 141122 141221 112214 112412 122114 122411 142112 142211 241211 221114 413111 241112 134111
111242 121142 121241 114212 124112 124211 411212 421112 421211 212141 214121 412121 111143 111341 131141 114113 114311 411113 411311 113141
114131 311141 411131 211412 211214 211232 2331112
""".split()
START_B, START_C, FNC1, TO_B, TO_C, STOP = 104, 105, 102, 100, 99, 106

#: Each pattern as modules, 1 for a bar.
MODULES = ["".join(("1" if i % 2 == 0 else "0") * int(w) for i, w in enumerate(p)) for p in PATTERNS]


def _pairs(digits: Column, first: int, count: int) -> list[Column]:
    return [F.substring(digits, first + 2 * i, 2).cast("int") for i in range(count)]


def gs1_symbols(digits: Column) -> Column:
    """Start C, FNC1 and the pairs of an even, non-empty run of digits, without check and stop; null for anything else."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda i: F.substr(digits, i, F.lit(2)).cast("int"))
    return F.when(digits.rlike("^([0-9]{2})+$"), F.concat(F.array(F.lit(START_C), F.lit(FNC1)), pairs))


def s10_symbols(number: Column) -> Column:
    """The symbols of an S10 number: letters in set B, four pairs in set C, the ninth digit and the country in B; null for anything else."""
    letter = lambda i: F.ascii(F.substring(number, i, 1)) - 32
    parts = [F.lit(START_B), letter(1), letter(2), F.lit(TO_C), *_pairs(number, 3, 4), F.lit(TO_B), letter(11), letter(12), letter(13)]
    return F.when(number.rlike("^[A-Z]{2}[0-9]{9}[A-Z]{2}$"), F.array(*parts))


def text_symbols(text: Column) -> Column:
    """Set B symbols of printable ASCII (32 to 126); null for anything else, or nothing.

    The general encoder: runs of four and more digits go to set C, an odd last digit of such a run to set B; a text that is all
    digits does so from two on.
    """
    pieces = F.regexp_extract_all(text, F.lit("[0-9]{4,}|[0-9]{1,3}|[^0-9]+"), F.lit(0))
    pieces = F.when(text.rlike("^[0-9]{2,3}$"), F.array(text)).otherwise(pieces)
    dense = lambda p: (F.length(p) >= 4) & p.rlike("^[0-9]+$") | text.rlike("^[0-9]{2,3}$")

    def plain(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: F.ascii(F.substr(p, i, F.lit(1))) - 32)

    def pairs(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(p) - 1, F.lit(2)), lambda i: F.substr(p, i, F.lit(2)).cast("int"))

    def add(a: Column, p: Column) -> Column:
        # the set in use: 1 for B, 2 for C, 0 for none yet
        to_c = F.when(a["set"] == 0, F.array(F.lit(START_C))).when(a["set"] == 1, F.array(F.lit(TO_C))).otherwise(F.array().cast("array<int>"))
        to_b = F.when(a["set"] == 0, F.array(F.lit(START_B))).when(a["set"] == 2, F.array(F.lit(TO_B))).otherwise(F.array().cast("array<int>"))
        odd = F.length(p) % 2 == 1
        tail = F.when(odd, F.array(F.lit(TO_B), F.ascii(F.right(p, F.lit(1))) - 32)).otherwise(F.array().cast("array<int>"))
        in_c = F.struct(F.when(odd, 1).otherwise(2).alias("set"), F.concat(a["out"], to_c, pairs(p), tail).alias("out"))
        in_b = F.struct(F.lit(1).alias("set"), F.concat(a["out"], to_b, plain(p)).alias("out"))
        return F.when(dense(p), in_c).otherwise(in_b)

    first = F.struct(F.lit(0).alias("set"), F.array().cast("array<int>").alias("out"))
    return F.when(text.rlike("^[ -~]+$"), F.aggregate(pieces, first, add)["out"])


def checksum(symbols: Column) -> Column:
    """The weighted sum of start and data symbols, modulo 103."""
    return F.aggregate(F.transform(symbols, lambda s, i: s * F.greatest(i, F.lit(1))), F.lit(0), lambda a, x: a + x) % 103


def with_check(symbols: Column) -> Column:
    return F.concat(symbols, F.array(checksum(symbols), F.lit(STOP)))


def bits(symbols: Column) -> Column:
    """The modules of a whole symbol (check and stop included) as a string of 1 (bar) and 0."""
    table = F.array(*map(F.lit, MODULES))
    return F.array_join(F.transform(symbols, lambda s: F.element_at(table, s + 1)), "")
