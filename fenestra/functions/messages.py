"""What an issue says, in Polish, as Columns. Texts and number formats are fixed values that readers of reports know."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fenestra.functions.addresses import POSTAL_CODE, POSTAL_LIKE
from fenestra.functions.numbers import bind, gs1_check_digit, s10_check_digit


def decimal(value: Column) -> Column:
    """One decimal after a comma."""
    return F.replace(F.format_string("%.1f", value.cast("double")), F.lit("."), F.lit(","))


def mm(value: Column) -> Column:
    return F.concat(decimal(value), F.lit(" mm"))


def pt(value: Column) -> Column:
    """At most one decimal, none if it is 0."""
    return F.concat(F.regexp_replace(decimal(value), ",0$", ""), F.lit(" pt"))


def size(r: Column) -> Column:
    return F.concat(decimal(r["width"]), F.lit(" × "), mm(r["height"]))


def place(r: Column) -> Column:
    """A rectangle: [x=1.0, y=2.0, 3.0×4.0 mm]."""
    return F.format_string("[x=%.1f, y=%.1f, %.1f×%.1f mm]", r["left"], r["top"], r["width"], r["height"])


def lines_word(n: Column) -> Column:
    """The plural of a count of lines."""
    return F.when(n == 1, "wiersz").when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), "wiersze").otherwise("wierszy")


def quoted(text: Column) -> Column:
    return F.concat(F.lit("„"), text, F.lit("”"))


def said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# What each issue says, by code; a second text of a code has a name behind a slash.
TEMPLATES = {
    "INVALID_DOCUMENT": "Nie udało się odczytać pliku PDF.",
    "NO_TEXT_LAYER": "Strona nie zawiera warstwy tekstowej (skan albo tekst zamieniony na krzywe). Nie da się sprawdzić położenia adresu.",
    "UNEXPECTED_PAGE_FORMAT": "Strona ma {width} × {height}, a układ „{layout}” zakłada A4 w pionie. Położenie okien może się nie zgadzać.",
    "WINDOW_NOT_FOUND": "Nie znaleziono obszaru adresowego: w {name} {window} na pierwszej stronie nie ma tekstu.",
    "ADDRESS_NOT_FOUND": "Na pierwszej stronie nie ma adresu odbiorcy „{expected}”: żaden blok tekstu nie zawiera jego wierszy.",
    "ADDRESS_MISMATCH": "Adres w dokumencie różni się od danych odbiorcy. Brakuje wierszy: {missing}.",
    "TEXT_ROTATED": "Tekst adresu w {name} jest obrócony lub pionowy. Adres musi być poziomy, równoległy do dłuższego boku koperty.",
    "ADDRESS_OUTSIDE_WINDOW": "Tekst adresu wychodzi poza {name} ({over}). Okno: {window}, tekst: {bounds}.",
    "ADDRESS_OUTSIDE_WINDOW/away": "Adres leży w całości {where}: {bounds}, a {name} to {window}.",
    "ADDRESS_TOO_CLOSE_TO_EDGE": "Tekst adresu jest za blisko krawędzi: {name} wymaga {clearance} odstępu, brakuje: {over}. Kartka przesuwa się w kopercie i tekst może zostać zasłonięty.",
    "OTHER_TEXT_IN_WINDOW": "W {name} widać także inny tekst: „{snippet}”.",
    "OTHER_TEXT_IN_WINDOW/label": "Obok nalepki R {name} pokazuje także tekst: „{snippet}”.",
    "EMPTY_LINE_INSIDE": "Adres zawiera pusty wiersz. Wiersze adresu powinny następować bezpośrednio po sobie.",
    "ADDRESS_EMPTY": "Blok adresowy jest pusty.",
    "MERGE_FIELDS_PRESENT": "Adres zawiera pola korespondencji seryjnej. Długość wierszy i kod pocztowy sprawdzono tylko dla szablonu, zweryfikuj też dokumenty po scaleniu.",
    "TOO_FEW_LINES": "Adres ma {n} {lines}, wymagane są co najmniej {limit}.",
    "TOO_MANY_LINES": "Adres ma {n} {lines}, dopuszczalne jest najwyżej {limit}.",
    "LINE_TOO_LONG": "Wiersz {number} ma {n} znaków, dopuszczalne jest {limit}: „{line}”.",
    "TEXT_AFTER_POSTAL_CODE_LINE": "Wiersz z kodem pocztowym („{line}”) musi być ostatnim wierszem adresu (w adresie zagranicznym przedostatnim, przed nazwą kraju wielkimi literami).",
    "POSTAL_CODE_LINE_MISSING": "Ostatni wiersz adresu musi zawierać kod pocztowy w formacie NN-NNN i miejscowość (np. „00-940 Warszawa”){foreign}{hint}",
    "FONT_TOO_SMALL": "Czcionka adresu ma {size}, minimum to {limit}.",
    "FONT_TOO_LARGE": "Czcionka adresu ma {size}, zalecane maksimum to {limit}.",
    "DECORATED_TEXT": "Adres zawiera kursywę, co utrudnia odczyt maszynowy. Użyj zwykłego kroju.",
    "NON_LEFT_ALIGNMENT": "Adres powinien być wyrównany do lewej.",
    "UNUSUAL_CHARACTERS": "Adres zawiera nietypowe znaki: {characters}. Mogą utrudnić odczyt maszynowy.",
    "LABEL_NOT_FOUND": "Nie znaleziono nalepki R: {name} {window} na pierwszej stronie nie zawiera grafiki.{hint}",
    "LABEL_OUTSIDE_WINDOW": "Nalepka R wychodzi poza {name} ({over}). Okno: {window}, nalepka: {bounds}.",
    "LABEL_OUTSIDE_WINDOW/away": "Nalepka R leży w całości {where}: {bounds}, a {name} to {window}.",
    "LABEL_TOO_LARGE": "Nalepka R ma {size}, a {name} mieści najwyżej {room}{margin}. Zmniejsz nalepkę.",
    "LABEL_TOO_CLOSE_TO_EDGE": "Nalepka R jest za blisko krawędzi: {name} wymaga {clearance} odstępu, brakuje: {over}. Kartka przesuwa się w kopercie i nalepka może zostać zasłonięta.",
    "LABEL_UNREADABLE": "Nie udało się odczytać kodu kreskowego z grafiki w oknie: {problem}. Nalepka R musi być wstawiona jako obraz PNG z generatora nalepek, bez skalowania i bez kompresji obrazów w dokumencie.",
    "LABEL_NUMBER_INVALID": "Numer nadawczy na nalepce R jest niepoprawny: {problem}.",
    "LABEL_TYPE_NOT_ALLOWED": "Nalepka R ma numer {own} ({human}), a dla tej przesyłki dopuszczalny jest tylko numer {other}.",
    "LABEL_NUMBER_MISMATCH": "Na nalepce R jest numer {number}, a dla tej przesyłki oczekiwany jest {expected}.",
    "LABEL_BARCODE_NOT_GS1": "Numer krajowy jest zakodowany jako zwykły Code 128, bez znaku FNC1. Nalepka Poczty Polskiej używa GS1-128; skanery nie rozpoznają tego kodu jako SSCC.",
    "LABEL_LOW_RESOLUTION": "Obraz nalepki R ma niską rozdzielczość: najwęższa kreska kodu ma {module} px (obraz {pixels} px na {size}). Obraz został zmniejszony, najpewniej przy zapisie do PDF (Word zmniejsza obrazy do ok. 200 DPI); wydrukowany kod może być nieostry. Sprawdź odczyt skanerem na wydruku albo twórz PDF narzędziem, które nie zmniejsza obrazów.",
}
#: Parts of texts.
AWAY, ELSEWHERE = "poza oknem", ("w ", ", czyli w niewłaściwym oknie")
FOREIGN_HINT, NO_HINT = ", a w adresie zagranicznym nazwę kraju wielkimi literami.", "."
CODE_HINT, LIKE_HINT = (" Kod „", "” jest w adresie, ale nie na początku ostatniego wiersza."), (" Znaleziono „", "”; wymagany format to NN-NNN, potem spacja i miejscowość.")
TEXT_HINT = " W oknie jest tekst, ale nalepka R musi być wstawiona jako grafika."
KINDS = {"Domestic": ("krajowy", "zagraniczny"), "International": ("zagraniczny", "krajowy")}
UNREAD = "w obrazie nie ma czytelnego kodu Code 128"


def text(key: str, **values: Column | str) -> Column:
    """A template filled in. Values are put in once, so braces in them stay what they are; a null value makes the text null."""
    parts = re.split(r"\{(\w+)\}", TEMPLATES[key])
    return said(*[values[x] if i % 2 else x for i, x in enumerate(parts) if i % 2 or x])


def where_instead(neighbour: Column) -> Column:
    """Where something lies that the window doesn't show at all: in the neighbour, if one is given, which is the wrong window."""
    return F.coalesce(said(ELSEWHERE[0], neighbour, ELSEWHERE[1]), F.lit(AWAY))


def missing_lines(lines: Column) -> Column:
    return F.array_join(F.transform(lines, quoted), "; ")


def number_problem(number: Column) -> Column:
    """What is wrong with a number, the struct of numbers.parse_number()."""
    n, p = number["normalized"], number["problem"]
    digit = F.when(number["type"] == "Domestic", said("zła cyfra kontrolna: jest ", F.substring(n, 20, 1), ", powinna być ", gs1_check_digit(F.substring(n, 3, 17)))).otherwise(said("zła cyfra kontrolna: jest ", F.substring(n, 11, 1), ", powinna być ", s10_check_digit(F.substring(n, 3, 8))))
    return (
        F.when(p == "wrong_prefix", said("numer krajowy musi zaczynać się od identyfikatora GS1 „00”, a zaczyna się od ", quoted(F.substring(n, 1, 2)))).when(p == "wrong_check_digit", digit)
        .when(p == "empty", "kod kreskowy nie zawiera numeru").otherwise(said(quoted(n), " nie jest numerem nadawczym: krajowy ma 20 cyfr (np. 00759007731512000621), zagraniczny 13 znaków (np. RR473124829PL)"))
    )


def postal_hint(lines: Column) -> Column:
    """The first thing like a postal code in the lines, and what is wrong with it; empty without one."""
    first = F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, POSTAL_LIKE, 1)), lambda x: x != ""), 0)
    return bind(first, lambda x: F.when(x.isNull(), "").when(x.rlike(POSTAL_CODE), said(CODE_HINT[0], x, CODE_HINT[1])).otherwise(said(LIKE_HINT[0], x, LIKE_HINT[1])))


def line_count(n: Column, limit: int, few: bool) -> Column:
    return bind(n, lambda k: text("TOO_FEW_LINES" if few else "TOO_MANY_LINES", n=k, lines=lines_word(k), limit=str(limit)))


def line_too_long(number: Column, line: Column, limit: int) -> Column:
    return text("LINE_TOO_LONG", number=number, n=F.length(line), limit=str(limit), line=line)


def font(value: Column, limit: float, small: bool) -> Column:
    return text("FONT_TOO_SMALL" if small else "FONT_TOO_LARGE", size=pt(value), limit=pt(F.lit(limit)))


def unusual(characters: Column) -> Column:
    return text("UNUSUAL_CHARACTERS", characters=F.array_join(F.transform(characters, quoted), " "))


def mismatch(missing: Column) -> Column:
    return text("ADDRESS_MISMATCH", missing=missing_lines(missing))
