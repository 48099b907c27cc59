"""Text of address blocks: normal forms, matching and rules, as Columns over arrays of lines."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from fenestra.functions.numbers import bind

# The patterns of a postal code at the beginning of a line, of one anywhere, of that alone, of a country's line, of merge fields, and the
# characters that are usual in an address. White space is Unicode's.
POSTAL_LINE = r"^\p{Nd}{2}-\p{Nd}{3}(?U:\s)+\p{L}"
POSTAL_LIKE = r"(?<!\p{Nd})(\p{Nd}{2}(?U:\s)*[-–](?U:\s)*\p{Nd}{3}|\p{Nd}{5})(?!\p{Nd})"
POSTAL_CODE = r"^\p{Nd}{2}-\p{Nd}{3}$"
COUNTRY_LINE = r"^[\p{Lu}][\p{Lu}\s\u0085\p{Z}\-]{1,39}$"
MERGE_FIELD = r"«[^»]*»|MERGEFIELD|\{\{[^}]*\}\}"
UNUSUAL = r"""[^\p{L}\p{M}\p{N}\s\u0085\p{Z}.,\-–/'""„”&()«»:;#{}]"""
SPACES = r"[\s\u0085\p{Z}]+"
#: The characters of SPACES.
SPACE = "\t\n\x0b\f\r\x85" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c)[0] == "Z")
#: White space inside a line, and the patterns above for one text of many lines, where a match ends with its line.
_INSIDE = r"[\s\u0085\p{Z}&&[^\n]]"
_WITHIN = lambda rx: rx.replace(r"(?U:\s)", r"(?U:[\s&&[^\n]])").replace(r"\p{Lu}\s\u0085\p{Z}\-", r"\p{Lu}\-[\s\u0085\p{Z}&&[^\n]]").replace("[^»]", "[^»\n]").replace("[^}]", "[^}\n]")
_ANY_POSTAL, _ANY_LIKE, _ANY_FIELD = "(?md)" + _WITHIN(POSTAL_LINE), f"(?md){_WITHIN(POSTAL_LIKE)}|{_WITHIN(COUNTRY_LINE)}", _WITHIN(MERGE_FIELD)
#: The home country's names.
HOME = ("POLSKA", "POLAND")
LONGEST = 40


def _plain_letters() -> tuple[str, str]:
    """Characters whose full decomposition is one character and marks, and that character; and the one without a decomposition."""
    pairs = {}
    for c in map(chr, range(0xC0, 0x30000)):
        if unicodedata.decomposition(c)[:1] not in ("", "<"):
            d = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
            if len(d) == 1 and d[0] != c:
                pairs[c] = d[0]
    pairs |= {"ł": "l", "Ł": "L"}
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _plain_letters()


def normalize_text(c: Column) -> Column:
    """Without marks, runs of other than letters and digits as one space, lower case. Plain ASCII has no marks; a class of ASCII ranges would find its letters far more slowly than Unicode's."""
    bare = F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(F.regexp_replace(c, r"\p{Mn}", ""), ACCENTED, PLAIN))
    return F.lower(F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " ")))


def trim(c: Column) -> Column:
    """Without white space at both ends, Unicode's included. Most lines begin and end with a visible ASCII character, which is seen without comparing each end with every kind of space."""
    visible = lambda x: F.ascii(x).between(33, 126)
    return F.when(visible(c) & visible(F.substring(c, -1, 1)), c).otherwise(F.trim(c, F.lit(SPACE)))


def non_empty_lines(lines: Column) -> Column:
    return F.filter(F.transform(lines, trim), lambda x: x != "")


def normalize_lines(lines: Column) -> Column:
    """Lines with white space collapsed, empty ones gone."""
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, SPACES, " "))), lambda x: x != "")


def has_inner_empty(lines: Column) -> Column:
    """Whether an empty line stands between lines that aren't."""
    flags = F.array_join(F.transform(lines, lambda x: F.when(trim(x) == "", "0").otherwise("1")), "")
    return flags.rlike("10+1")


def looks_like_address(lines: Column) -> Column:
    """2 to 8 lines of 60 characters at most; 7 and 8 only with a line like a postal code or a country."""

    def like(own: Column) -> Column:
        n = F.size(own)
        return n.between(2, 8) & F.forall(own, lambda x: F.length(x) <= 60) & ((n <= 6) | F.exists(own, lambda x: x.rlike(POSTAL_LIKE) | x.rlike(COUNTRY_LINE)))

    return bind(non_empty_lines(lines), like)


def _normal(lines: Column) -> Column:
    return F.transform(non_empty_lines(lines), normalize_text)


def matched_lines(lines: Column, expected: Column) -> Column:
    """How many expected lines the block has, by normal form; repeated ones count each time."""
    return bind(_normal(lines), lambda have: F.size(F.filter(F.transform(expected, normalize_text), lambda e: (e != "") & F.array_contains(have, e))))


def wanted_lines(expected: Column) -> Column:
    """The expected lines as structs of e, the line as given, and n, its normal form between line ends; those without a letter or digit are left out."""
    named = F.transform(expected, lambda e: F.struct(e.alias("e"), normalize_text(e).alias("n")))
    return F.transform(F.filter(named, lambda x: x["n"] != ""), lambda x: F.struct(x["e"].alias("e"), F.concat(F.lit("\n"), x["n"], F.lit("\n")).alias("n")))


def joined(lines: Column) -> Column:
    """Lines as one text; a null is two line ends more or less visible (see is_plain())."""
    return F.array_join(lines, "\n", "\n")


def is_plain(text: Column, lines: Column) -> Column:
    """Whether joined() lines can be told from their text: none is null or holds a line end."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) == F.greatest(F.size(lines) - 1, F.lit(0))


def without_breaks(lines: Column) -> Column:
    """The lines that aren't null, line ends in them as spaces."""
    return F.transform(F.array_compact(lines), lambda x: F.translate(x, "\n", " "))


def folded(text: Column) -> Column:
    """The normal forms of a text's lines in one text, with a line end before and behind each: what holds the n of wanted_lines(). The lines are normalized at once, not one by one."""
    c = F.concat(F.lit("\n"), text, F.lit("\n"))
    bare = F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(F.regexp_replace(c, r"\p{Mn}", ""), ACCENTED, PLAIN))
    found = F.regexp_replace(bare, r"[^\p{L}\p{N}\n]+", " ")
    return F.lower(F.replace(F.replace(found, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))


def folded_lines(lines: Column) -> Column:
    """folded() of lines."""
    return bind(F.array_join(without_breaks(lines), "\n"), folded)


def tidy(text: Column) -> Column:
    """A text of lines, each without white space at both ends."""
    return F.regexp_replace(text, f"(?md)^{_INSIDE}+|{_INSIDE}+$", "")


def filled(tidied: Column) -> Column:
    """A tidy() text without its empty lines."""
    return F.trim(F.regexp_replace(tidied, r"\n{2,}", "\n"), F.lit("\n"))


def count_lines(text: Column) -> Column:
    """How many lines a filled() text has."""
    return F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def like_address(text: Column, n: Column) -> Column:
    """looks_like_address() of a filled() text of n lines."""
    return n.between(2, 8) & ~text.rlike("[^\n]{61}") & ((n <= 6) | text.rlike(_ANY_LIKE))


def has_gap(tidied: Column) -> Column:
    """has_inner_empty() of a tidy() text."""
    return F.trim(tidied, F.lit("\n")).contains("\n\n")


def own_text(text: Column) -> Column:
    """A text of lines with white space collapsed: between its line ends stand normalize_lines(), and empty ones."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"{_INSIDE}+", " "), " ?\n ?", "\n"))


def has_merge_field_in(text: Column) -> Column:
    return text.rlike(_ANY_FIELD)


def unusual_characters_in(text: Column) -> Column:
    """unusual_characters() of a text of lines."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, _ANY_FIELD, ""), F.lit(UNUSUAL), F.lit(0)))


def missing_lines(lines: Column, expected: Column) -> Column:
    """The expected lines that the block lacks, as they were given and in their order."""
    named = F.transform(expected, lambda e: F.struct(e.alias("e"), normalize_text(e).alias("n")))
    return bind(_normal(lines), lambda have: F.transform(F.filter(named, lambda x: (x["n"] != "") & ~F.array_contains(have, x["n"])), lambda x: x["e"]))


def _short(text: Column) -> Column:
    return F.when(F.length(text) > 60, F.concat(F.substring(text, 1, 59), F.lit("…"))).otherwise(text)


def snippet(lines: Column) -> Column:
    """The block's lines that aren't empty in one, of 60 characters at most."""
    return bind(F.array_join(non_empty_lines(lines), " / "), _short)


def snippet_of(text: Column) -> Column:
    """snippet() of a filled() text."""
    return _short(F.replace(text, F.lit("\n"), F.lit(" / ")))


def has_merge_field(lines: Column) -> Column:
    return F.exists(lines, lambda x: x.rlike(MERGE_FIELD))


def unusual_characters(lines: Column) -> Column:
    """Distinct unusual characters outside merge fields, by first appearance; a field ends with its line."""
    each = F.transform(lines, lambda x: F.regexp_extract_all(F.regexp_replace(x, MERGE_FIELD, ""), F.lit(UNUSUAL), F.lit(0)))
    return F.array_distinct(F.flatten(each))


def _verdict(lines: Column, n: Column, last: Column, anywhere: Column, foreign: bool) -> Column:
    country, home = (n >= 2) & last.rlike(COUNTRY_LINE), F.upper(last).isin(*HOME)
    return (
        F.when(n == 0, "missing").when(last.rlike(POSTAL_LINE), "ok").when(F.lit(foreign) & ~home & country, "ok").when(home & country & F.get(lines, n - 2).rlike(POSTAL_LINE), "ok")
        .when(anywhere, "text_after").otherwise("missing")
    )


def postal_verdict(lines: Column, foreign: bool = True) -> Column:
    """ok, text_after, or missing: where the line with the postal code stands."""
    verdict = lambda x: _verdict(lines, x["n"], x["last"], F.exists(lines, lambda y: y.rlike(POSTAL_LINE)), foreign)
    return bind(F.struct(F.size(lines).alias("n"), F.get(lines, F.size(lines) - 1).alias("last")), verdict)


def postal_verdict_of(lines: Column, text: Column, foreign: bool = True) -> Column:
    """postal_verdict() of lines that are also given as one text."""
    return _verdict(lines, F.size(lines), F.get(lines, F.size(lines) - 1), text.rlike(_ANY_POSTAL), foreign)
