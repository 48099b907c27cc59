"""Queries over whole pages: choice, rules and roll-up in one chain, and the SQL that says what each returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.functions import addresses as ad
from fenestra.functions import geometry as g
from fenestra.functions import messages as m
from fenestra.functions import numbers as nb
from fenestra.operators import pages as pg
from fenestra.operators import rules
from fenestra.operators.layouts import layout_windows
from fenestra.plans.queries import _CL, _DX, _DY, _MF, _NORMAL, _PL, LAYOUTS, LETTERS, PARTS, _area, _fits, _gs1, _label, _over, _s10, query
from fenestra.sources import derived as dv

_LIKE = r"'(^|[^0-9])([0-9]{2}\s*[-–]\s*[0-9]{3}|[0-9]{5})([^0-9]|$)'"
_NOT_EMPTY = "list_filter(list_transform(blines, lambda x: trim(x)), lambda x: x <> '')"
_SNIPPET = f"(CASE WHEN length(array_to_string({_NOT_EMPTY}, ' / ')) > 60 THEN substr(array_to_string({_NOT_EMPTY}, ' / '), 1, 59) || '…' ELSE array_to_string({_NOT_EMPTY}, ' / ') END)"
_UNUSUAL = r"""'[^\p{L}\p{M}\p{N}\s.,\-–/''"„”&()«»:;#{}]'"""
_SCORE = f"(CASE WHEN w * h > 0 THEN {_area()} * ({_area()} / (w * h)) ELSE 0.0 END)"
_R1 = lambda v: f"printf('%.1f', {v})"
_COMMA = lambda v: f"replace(printf('%.1f', {v}), '.', ',')"
_MM = lambda v: f"({_COMMA(v)} || ' mm')"
_PT = lambda v: f"(regexp_replace({_COMMA(v)}, ',0$', '') || ' pt')"
_SIZE = lambda w, h: f"({_COMMA(w)} || ' × ' || {_MM(h)})"
_PLACE = lambda l, t, w, h: f"('[x=' || {_R1(l)} || ', y=' || {_R1(t)} || ', ' || {_R1(w)} || '×' || {_R1(h)} || ' mm]')"  # noqa: E731, E741
_OWN, _WIN = _PLACE("l", "t", "w", "h"), _PLACE("wl", "wt", "ww", "wh")
_INNER = ("(wl + clearance)", "(wt + clearance)", "greatest(0.0, ww - 2 * clearance)", "greatest(0.0, wh - 2 * clearance)")


def _over_text(wl: str = "wl", wt: str = "wt", ww: str = "ww", wh: str = "wh") -> str:
    """How far the rectangle l, t, w, h sticks out of another one, in words."""
    sides = ("z lewej", f"{wl} - l"), ("z prawej", f"(l + w) - ({wl} + {ww})"), ("u góry", f"{wt} - t"), ("u dołu", f"(t + h) - ({wt} + {wh})")
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {v} > 0.05 THEN '{word} o ' || replace(printf('%.1f', round_even({v}, 1)), '.', ',') || ' mm' END" for word, v in sides) + "], lambda x: x IS NOT NULL), ', ')"


_AWAY = lambda what: f"('{what} leży w całości ' || CASE WHEN nl IS NOT NULL AND {_area('l', 't', 'w', 'h', 'nl', 'nt', 'nw', 'nh')} > 0 THEN 'w ' || nname || ', czyli w niewłaściwym oknie' ELSE 'poza oknem' END || ': ' || {_OWN} || ', a ' || wname || ' to ' || {_WIN} || '.')"
_CLOSE = lambda what, it: f"('{what} jest za blisko krawędzi: ' || wname || ' wymaga ' || {_MM('clearance')} || ' odstępu, brakuje: ' || {_over_text(*_INNER)} || '. Kartka przesuwa się w kopercie i {it} może zostać zasłonięt{'y' if it == 'tekst' else 'a'}.')"
_LINES = "CASE WHEN n = 1 THEN 'wiersz' WHEN n % 10 BETWEEN 2 AND 4 AND NOT n % 100 BETWEEN 12 AND 14 THEN 'wiersze' ELSE 'wierszy' END"
_LIKE_CODE = f"list_filter(list_transform(lines, lambda x: regexp_extract(x, {_LIKE}, 2)), lambda x: x <> '')[1]"
_HUMAN = "CASE type WHEN 'Domestic' THEN '(00)' || substr(own_number, 3, 8) || ' ' || substr(own_number, 11, 1) || ' ' || substr(own_number, 12, 8) || ' ' || substr(own_number, 20, 1) ELSE substr(own_number, 1, 2) || ' ' || substr(own_number, 3, 3) || ' ' || substr(own_number, 6, 3) || ' ' || substr(own_number, 9, 3) || ' ' || substr(own_number, 12, 2) END"
_WRONG = f"'zła cyfra kontrolna: jest ' || CASE type WHEN 'Domestic' THEN substr(own_number, 20, 1) || ', powinna być ' || {_gs1('substr(own_number, 3, 17)')} ELSE substr(own_number, 11, 1) || ', powinna być ' || {_s10('substr(own_number, 3, 8)')} END"
_WNAME = lambda r: f"CASE WHEN {r}.role = 'sender' THEN 'okno nadawcy' WHEN {r}.layout IN ('dl_din_b', 'dl_two_left') THEN 'okno adresata (DIN 5008 B)' WHEN {r}.layout = 'dl_din_a' THEN 'okno adresata (DIN 5008 A)' ELSE 'okno adresata' END"
_LAYOUT_NAME = "CASE layout WHEN 'c65_single' THEN 'C65, jedno okienko' WHEN 'c65_two' THEN 'C65, dwa okienka' ELSE 'DL, dwa okienka (adresat po lewej)' END"
_LIKELY = f"len(nel) BETWEEN 2 AND 8 AND len(list_filter(nel, lambda x: length(x) > 60)) = 0 AND (len(nel) <= 6 OR len(list_filter(nel, lambda x: regexp_matches(x, {_LIKE}) OR regexp_matches(x, {_CL}))) > 0)"
_BEST = "tier, CASE tier WHEN 0 THEN -hits WHEN 2 THEN CASE WHEN len(nel) BETWEEN 3 AND 6 THEN -1 ELSE 0 END ELSE 0 END, CASE WHEN tier = 2 THEN distance ELSE -score END, ord"
_TIER = "CASE WHEN score > 0 AND likely THEN 1 WHEN likely THEN 2 WHEN score > 0 THEN 3 END"


def _windows(role: str, other: str, where: str = "true") -> str:
    return f"""SELECT u.*, r.wl, r.wt, r.ww, r.wh, r.clearance, {_WNAME("r")} AS wname, n.wl AS nl, n.wt AS nt, n.ww AS nw, n.wh AS nh, {_WNAME("n")} AS nname
  FROM usable u JOIN layout_window r ON r.layout = u.layout AND r.role = '{role}' LEFT JOIN layout_window n ON n.layout = u.layout AND n.role = '{other}' AND u.mode = 'Double' WHERE {where}"""


PAGES = f"""{LETTERS}, {PARTS}, {LAYOUTS},
pages0 AS (SELECT doc, CASE WHEN q % 59 = 0 THEN 'nowhere' WHEN q % 5 = 4 THEN 'dl_two_left' WHEN q % 11 = 0 THEN 'c65_single' ELSE 'c65_two' END AS layout, CASE WHEN q % 61 = 0 THEN 'Triple' WHEN q % 5 <> 4 AND q % 11 = 0 AND q % 53 <> 0 THEN 'Single' ELSE 'Double' END AS mode,
  CASE WHEN q % 6 = 1 THEN 'Address' ELSE 'RegisteredLabel' END AS content, q % 41 <> 0 AS readable, q % 37 <> 0 AS has_text, q % 43 = 0 AS wide, expected_lines, expected_number, number AS own_number, type, valid, ll, lt, lw, lh, module_px, q FROM letters),
pages_ AS (SELECT *, CASE WHEN mode = 'Triple' THEN 'unknown_mode' WHEN layout = 'nowhere' THEN 'unknown_layout' WHEN mode = 'Double' AND layout = 'c65_single' THEN 'no_sender_window' END AS problem FROM pages0),
usable AS (SELECT * FROM pages_ WHERE readable AND has_text AND problem IS NULL),
wholes AS (SELECT doc, CASE WHEN NOT readable THEN 'INVALID_DOCUMENT' WHEN NOT has_text THEN 'NO_TEXT_LAYER' ELSE 'UNEXPECTED_PAGE_FORMAT' END AS code, CASE WHEN readable AND has_text THEN 'Warning' ELSE 'Inconclusive' END AS severity,
  CASE WHEN NOT readable THEN 'Nie udało się odczytać pliku PDF.' WHEN NOT has_text THEN 'Strona nie zawiera warstwy tekstowej (skan albo tekst zamieniony na krzywe). Nie da się sprawdzić położenia adresu.'
  ELSE 'Strona ma 216,0 mm × 297,0 mm, a układ „' || {_LAYOUT_NAME} || '” zakłada A4 w pionie. Położenie okien może się nie zgadzać.' END AS message FROM pages_ WHERE problem IS NULL AND (NOT readable OR NOT has_text OR wide)),
bl AS (SELECT p.* EXCLUDE (expected), CASE WHEN matched = 0 AND number % 5 = 0 THEN [' '] WHEN matched = 3 THEN a.lines WHEN matched = 2 THEN [a.lines[1], ''] || a.lines[2:] WHEN matched = 1 THEN list_transform(range(1, n_lines + 1), lambda i: 'Dotyczy: pismo nr ' || ord || '/' || i)
  ELSE list_transform(range(1, n_lines + 1), lambda i: 'Szanowni Państwo, w załączeniu przesyłamy dokumenty do podpisu, pozycja ' || ord || '/' || i) END AS blines, number % 19 = 0 AS non_left FROM parts p JOIN orders ON o_orderkey = doc JOIN addr a ON a.k = o_custkey),
rw AS ({_windows("recipient", "sender")}),
sw AS ({_windows("sender", "recipient", "u.mode = 'Double'")}),
cand AS (SELECT *, {_SCORE} AS score, sqrt({_DX} * {_DX} + {_DY} * {_DY}) AS distance, {_NOT_EMPTY} AS nel FROM rw JOIN bl USING (doc)),
ranked AS (SELECT *, expected_lines IS NOT NULL AS asked, len(list_filter(expected_lines, lambda x: list_contains(list_transform(nel, lambda x: {_NORMAL}), {_NORMAL}))) AS hits, {_LIKELY} AS likely FROM cand),
tiered AS (SELECT *, CASE WHEN asked THEN CASE WHEN hits > 0 THEN 0 END ELSE {_TIER} END AS tier FROM ranked),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY {_BEST}) AS rn FROM tiered WHERE tier IS NOT NULL) WHERE rn = 1),
cand2 AS (SELECT *, {_SCORE} AS score, sqrt({_DX} * {_DX} + {_DY} * {_DY}) AS distance, {_NOT_EMPTY} AS nel, false AS asked, 0 AS hits FROM sw JOIN bl USING (doc) WHERE content = 'Address' AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.doc = bl.doc AND c.ord = bl.ord)),
tiered2 AS (SELECT *, {_TIER} AS tier FROM (SELECT *, {_LIKELY} AS likely FROM cand2)),
chosen2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY {_BEST}) AS rn FROM tiered2 WHERE tier IS NOT NULL) WHERE rn = 1),
beside AS (SELECT b.doc, 'recipient' AS role, rw.content, rw.wname, b.blines FROM rw JOIN bl b USING (doc) LEFT JOIN chosen c ON c.doc = b.doc AND c.ord = b.ord WHERE c.doc IS NULL AND {_area('b.l', 'b.t', 'b.w', 'b.h', 'rw.wl', 'rw.wt', 'rw.ww', 'rw.wh')} > 0
  UNION ALL SELECT b.doc, 'sender', sw.content, sw.wname, b.blines FROM sw JOIN bl b USING (doc) LEFT JOIN chosen c ON c.doc = b.doc AND c.ord = b.ord LEFT JOIN chosen2 d ON d.doc = b.doc AND d.ord = b.ord WHERE c.doc IS NULL AND d.doc IS NULL AND {_area('b.l', 'b.t', 'b.w', 'b.h', 'sw.wl', 'sw.wt', 'sw.ww', 'sw.wh')} > 0),
im AS (SELECT doc, 1 AS ord, ll AS l, lt + CASE WHEN q % 9 = 0 THEN 150 ELSE 0 END AS t, lw AS w, lh AS h, q % 23 <> 0 AS was_read FROM usable WHERE q % 6 <> 5
  UNION ALL SELECT doc, 2, 150.0, 20.0, 40.0, 10.0, q % 8 = 0 FROM usable WHERE q % 4 = 0),
icand AS (SELECT *, {_SCORE} AS score FROM sw JOIN im USING (doc) WHERE content <> 'Address'),
itier AS (SELECT *, CASE WHEN was_read AND valid AND (expected_number IS NULL OR own_number = expected_number) THEN 1 WHEN was_read AND valid THEN 2 WHEN score > 0 THEN 3 END AS tier FROM icand WHERE score > 0 OR (w >= 20 AND h >= 4 AND w / h BETWEEN 1.5 AND 10)),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY tier, -score, ord) AS rn FROM itier WHERE tier IS NOT NULL) WHERE rn = 1),
rc AS (SELECT *, list_filter(list_transform(blines, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS lines, CASE WHEN score <= 0 THEN 'outside' ELSE {_fits()} END AS place
  FROM (SELECT 'recipient' AS role, 3 AS least, 6 AS most, * FROM chosen UNION ALL BY NAME SELECT 'sender' AS role, 2 AS least, 5 AS most, * REPLACE (NULL AS expected_lines, NULL AS nl, NULL AS nt, NULL AS nw, NULL AS nh) FROM chosen2)),
rv AS (SELECT *, len(lines) AS n, CASE WHEN regexp_matches(lines[-1], {_PL}) THEN 'ok' WHEN len(lines) >= 2 AND regexp_matches(lines[-1], {_CL}) AND upper(lines[-1]) NOT IN ('POLSKA', 'POLAND') THEN 'ok'
  WHEN len(lines) >= 2 AND upper(lines[-1]) IN ('POLSKA', 'POLAND') AND regexp_matches(lines[-2], {_PL}) THEN 'ok' WHEN len(list_filter(lines, lambda x: regexp_matches(x, {_PL}))) > 0 THEN 'text_after' ELSE 'missing' END AS verdict,
  len(list_filter(lines, lambda x: regexp_matches(x, {_MF}))) > 0 AS fields, list_distinct(flatten(list_transform(lines, lambda x: regexp_extract_all(regexp_replace(x, {_MF}, '', 'g'), {_UNUSUAL})))) AS odd,
  list_filter(expected_lines, lambda x: NOT list_contains(list_transform(nel, lambda x: {_NORMAL}), {_NORMAL})) AS lacking FROM rc),
pl AS (SELECT *, {_label()} AS place FROM picked),
piss AS (
  SELECT doc, role, 'TEXT_ROTATED' AS code, 'Error' AS severity, 'Tekst adresu w ' || wname || ' jest obrócony lub pionowy. Adres musi być poziomy, równoległy do dłuższego boku koperty.' AS message FROM rv WHERE rotated
  UNION ALL SELECT doc, role, 'ADDRESS_OUTSIDE_WINDOW', 'Error', CASE WHEN score <= 0 THEN {_AWAY("Adres")} ELSE 'Tekst adresu wychodzi poza ' || wname || ' (' || {_over_text()} || '). Okno: ' || {_WIN} || ', tekst: ' || {_OWN} || '.' END FROM rv WHERE place = 'outside'
  UNION ALL SELECT doc, role, 'ADDRESS_TOO_CLOSE_TO_EDGE', 'Error', {_CLOSE("Tekst adresu", "tekst")} FROM rv WHERE place = 'too_close'
  UNION ALL SELECT doc, role, 'EMPTY_LINE_INSIDE', 'Warning', 'Adres zawiera pusty wiersz. Wiersze adresu powinny następować bezpośrednio po sobie.' FROM rv WHERE matched = 2
  UNION ALL SELECT doc, role, 'ADDRESS_EMPTY', 'Error', 'Blok adresowy jest pusty.' FROM rv WHERE n = 0
  UNION ALL SELECT doc, role, 'MERGE_FIELDS_PRESENT', 'Warning', 'Adres zawiera pola korespondencji seryjnej. Długość wierszy i kod pocztowy sprawdzono tylko dla szablonu, zweryfikuj też dokumenty po scaleniu.' FROM rv WHERE fields
  UNION ALL SELECT doc, role, 'TOO_FEW_LINES', 'Error', 'Adres ma ' || n || ' ' || {_LINES} || ', wymagane są co najmniej ' || least || '.' FROM rv WHERE n > 0 AND n < least
  UNION ALL SELECT doc, role, 'TOO_MANY_LINES', 'Error', 'Adres ma ' || n || ' ' || {_LINES} || ', dopuszczalne jest najwyżej ' || most || '.' FROM rv WHERE n > most
  UNION ALL SELECT doc, role, 'LINE_TOO_LONG', 'Error', 'Wiersz ' || i || ' ma ' || length(x) || ' znaków, dopuszczalne jest 40: „' || x || '”.' FROM (SELECT doc, role, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM rv) WHERE length(x) > 40
  UNION ALL SELECT doc, role, 'TEXT_AFTER_POSTAL_CODE_LINE', CASE WHEN fields THEN 'Warning' ELSE 'Error' END, 'Wiersz z kodem pocztowym („' || list_filter(lines, lambda x: regexp_matches(x, {_PL}))[1] || '”) musi być ostatnim wierszem adresu (w adresie zagranicznym przedostatnim, przed nazwą kraju wielkimi literami).' FROM rv WHERE n > 0 AND verdict = 'text_after'
  UNION ALL SELECT doc, role, 'POSTAL_CODE_LINE_MISSING', CASE WHEN fields THEN 'Warning' ELSE 'Error' END, 'Ostatni wiersz adresu musi zawierać kod pocztowy w formacie NN-NNN i miejscowość (np. „00-940 Warszawa”), a w adresie zagranicznym nazwę kraju wielkimi literami.'
    || CASE WHEN {_LIKE_CODE} IS NULL THEN '' WHEN regexp_matches({_LIKE_CODE}, '^[0-9]{{2}}-[0-9]{{3}}$') THEN ' Kod „' || {_LIKE_CODE} || '” jest w adresie, ale nie na początku ostatniego wiersza.' ELSE ' Znaleziono „' || {_LIKE_CODE} || '”; wymagany format to NN-NNN, potem spacja i miejscowość.' END FROM rv WHERE n > 0 AND verdict = 'missing'
  UNION ALL SELECT doc, role, 'UNUSUAL_CHARACTERS', 'Warning', 'Adres zawiera nietypowe znaki: ' || array_to_string(list_transform(odd, lambda x: '„' || x || '”'), ' ') || '. Mogą utrudnić odczyt maszynowy.' FROM rv WHERE len(odd) > 0
  UNION ALL SELECT doc, role, 'FONT_TOO_SMALL', 'Error', 'Czcionka adresu ma ' || {_PT("font")} || ', minimum to 8 pt.' FROM rv WHERE n > 0 AND font < 8
  UNION ALL SELECT doc, role, 'FONT_TOO_LARGE', 'Warning', 'Czcionka adresu ma ' || {_PT("font + n_lines % 3")} || ', zalecane maksimum to 14 pt.' FROM rv WHERE n > 0 AND font + n_lines % 3 > 14
  UNION ALL SELECT doc, role, 'DECORATED_TEXT', 'Warning', 'Adres zawiera kursywę, co utrudnia odczyt maszynowy. Użyj zwykłego kroju.' FROM rv WHERE n > 0 AND italic
  UNION ALL SELECT doc, role, 'NON_LEFT_ALIGNMENT', 'Warning', 'Adres powinien być wyrównany do lewej.' FROM rv WHERE n > 0 AND non_left
  UNION ALL SELECT doc, role, 'ADDRESS_MISMATCH', 'Error', 'Adres w dokumencie różni się od danych odbiorcy. Brakuje wierszy: ' || array_to_string(list_transform(lacking, lambda x: '„' || x || '”'), '; ') || '.' FROM rv WHERE asked AND len(lacking) > 0
  UNION ALL SELECT doc, role, 'OTHER_TEXT_IN_WINDOW', 'Warning', 'W ' || wname || ' widać także inny tekst: „' || {_SNIPPET} || '”.' FROM beside b WHERE (role = 'recipient' AND doc IN (SELECT doc FROM chosen)) OR (role = 'sender' AND doc IN (SELECT doc FROM chosen2))
  UNION ALL SELECT doc, role, 'OTHER_TEXT_IN_WINDOW', 'Warning', 'Obok nalepki R ' || wname || ' pokazuje także tekst: „' || {_SNIPPET} || '”.' FROM beside b WHERE role = 'sender' AND doc IN (SELECT doc FROM picked)
  UNION ALL SELECT doc, 'recipient', 'ADDRESS_NOT_FOUND', 'Error', 'Na pierwszej stronie nie ma adresu odbiorcy „' || array_to_string(expected_lines, ' / ') || '”: żaden blok tekstu nie zawiera jego wierszy.' FROM rw WHERE expected_lines IS NOT NULL AND doc NOT IN (SELECT doc FROM chosen)
  UNION ALL SELECT doc, role, 'WINDOW_NOT_FOUND', 'Error', 'Nie znaleziono obszaru adresowego: w ' || wname || ' ' || {_WIN} || ' na pierwszej stronie nie ma tekstu.'
    FROM (SELECT *, 'recipient' AS role FROM rw WHERE expected_lines IS NULL AND doc NOT IN (SELECT doc FROM chosen) UNION ALL SELECT *, 'sender' FROM sw WHERE content = 'Address' AND doc NOT IN (SELECT doc FROM chosen2))
  UNION ALL SELECT doc, 'sender', 'LABEL_NOT_FOUND', 'Error', 'Nie znaleziono nalepki R: ' || wname || ' ' || {_WIN} || ' na pierwszej stronie nie zawiera grafiki.' || CASE WHEN EXISTS (SELECT 1 FROM beside b WHERE b.doc = sw.doc AND b.role = 'sender') THEN ' W oknie jest tekst, ale nalepka R musi być wstawiona jako grafika.' ELSE '' END
    FROM sw WHERE content <> 'Address' AND doc NOT IN (SELECT doc FROM picked)
  UNION ALL SELECT doc, 'sender', 'LABEL_OUTSIDE_WINDOW', 'Error', CASE place WHEN 'outside' THEN 'Nalepka R wychodzi poza ' || wname || ' (' || {_over_text()} || '). Okno: ' || {_WIN} || ', nalepka: ' || {_OWN} || '.' ELSE {_AWAY("Nalepka R")} END FROM pl WHERE place IN ('outside', 'not_overlapping')
  UNION ALL SELECT doc, 'sender', 'LABEL_TOO_LARGE', 'Error', 'Nalepka R ma ' || {_SIZE("w", "h")} || ', a ' || wname || ' mieści najwyżej ' || {_SIZE(_INNER[2], _INNER[3])} || ' (z odstępem ' || {_MM("clearance")} || ' od krawędzi). Zmniejsz nalepkę.' FROM pl WHERE place = 'too_large'
  UNION ALL SELECT doc, 'sender', 'LABEL_TOO_CLOSE_TO_EDGE', 'Error', {_CLOSE("Nalepka R", "nalepka")} FROM pl WHERE place = 'too_close'
  UNION ALL SELECT doc, 'sender', 'LABEL_UNREADABLE', 'Inconclusive', 'Nie udało się odczytać kodu kreskowego z grafiki w oknie: w obrazie nie ma czytelnego kodu Code 128. Nalepka R musi być wstawiona jako obraz PNG z generatora nalepek, bez skalowania i bez kompresji obrazów w dokumencie.' FROM pl WHERE NOT was_read
  UNION ALL SELECT doc, 'sender', 'LABEL_NUMBER_INVALID', 'Error', 'Numer nadawczy na nalepce R jest niepoprawny: ' || {_WRONG} || '.' FROM pl WHERE was_read AND NOT valid
  UNION ALL SELECT doc, 'sender', 'LABEL_TYPE_NOT_ALLOWED', 'Error', 'Nalepka R ma numer zagraniczny (' || {_HUMAN} || '), a dla tej przesyłki dopuszczalny jest tylko numer krajowy.' FROM pl WHERE was_read AND valid AND type = 'International'
  UNION ALL SELECT doc, 'sender', 'LABEL_NUMBER_MISMATCH', 'Error', 'Na nalepce R jest numer ' || own_number || ', a dla tej przesyłki oczekiwany jest ' || expected_number || '.' FROM pl WHERE was_read AND own_number <> expected_number
  UNION ALL SELECT doc, 'sender', 'LABEL_BARCODE_NOT_GS1', 'Warning', 'Numer krajowy jest zakodowany jako zwykły Code 128, bez znaku FNC1. Nalepka Poczty Polskiej używa GS1-128; skanery nie rozpoznają tego kodu jako SSCC.' FROM pl WHERE was_read AND valid AND type = 'Domestic' AND q % 29 = 0
  UNION ALL SELECT doc, 'sender', 'LABEL_LOW_RESOLUTION', 'Warning', 'Obraz nalepki R ma niską rozdzielczość: najwęższa kreska kodu ma ' || {_COMMA("module_px")} || ' px (obraz ' || CAST(w * 8 AS INTEGER) || '×' || CAST(h * 8 AS INTEGER) || ' px na ' || {_SIZE("w", "h")} || '). Obraz został zmniejszony, najpewniej przy zapisie do PDF (Word zmniejsza obrazy do ok. 200 DPI); wydrukowany kod może być nieostry. Sprawdź odczyt skanerem na wydruku albo twórz PDF narzędziem, które nie zmniejsza obrazów.' FROM pl WHERE was_read AND module_px < 2.5),
pwin AS (SELECT d.doc, d.role, d.found, count(code) FILTER (WHERE severity = 'Error') AS e, count(code) FILTER (WHERE severity = 'Inconclusive') AS i, count(code) FILTER (WHERE severity = 'Warning') AS w
  FROM (SELECT doc, 'recipient' AS role, doc IN (SELECT doc FROM chosen) AS found FROM rw UNION ALL SELECT doc, 'sender', doc IN (SELECT doc FROM picked) OR doc IN (SELECT doc FROM chosen2) FROM sw) d LEFT JOIN piss ON piss.doc = d.doc AND piss.role = d.role GROUP BY ALL),
pout AS (SELECT *, CASE WHEN NOT found OR e > 0 THEN 'Invalid' WHEN i > 0 THEN 'Inconclusive' ELSE 'Valid' END AS outcome FROM pwin),
verdicts AS (SELECT p.doc, p.problem, count(o.doc) AS n_windows, CAST(coalesce(sum(e), 0) AS BIGINT) AS n_errors, CAST(coalesce(sum(w), 0) + coalesce(max(CASE WHEN x.severity = 'Warning' THEN 1 END), 0) AS BIGINT) AS n_warnings,
  CASE WHEN p.problem IS NULL THEN CASE WHEN coalesce(bool_or(o.outcome = 'Invalid'), false) OR coalesce(sum(e), 0) > 0 THEN 'Invalid' WHEN count(o.doc) = 0 OR coalesce(sum(i), 0) > 0 OR coalesce(bool_or(x.severity = 'Inconclusive'), false) THEN 'Inconclusive' ELSE 'Valid' END END AS outcome
  FROM pages_ p LEFT JOIN pout o ON o.doc = p.doc LEFT JOIN wholes x ON x.doc = p.doc GROUP BY p.doc, p.problem)"""


def _inspected(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """Every page, where only domestic numbers are allowed; with what the issues say, or without."""
    return pg.inspect(dv.pages(spark, sf_dir), dv.page_blocks(spark, sf_dir), dv.page_images(spark, sf_dir), layout_windows(spark), label=rules.LabelRules(international=False), texts=texts)


@query(f"WITH {PAGES} SELECT doc, role, code, severity, message FROM piss UNION ALL SELECT doc, 'document', code, severity, message FROM wholes")
def page_issues(spark, sf_dir):
    """Every issue of every page with its message, found by choosing blocks and labels among all of the page's."""
    return pg.each_issue(_inspected(spark, sf_dir))


@query(f"WITH {PAGES} SELECT doc, role, found, outcome, CAST(e + i + w AS INTEGER) AS n_issues FROM pout")
def page_windows(spark, sf_dir):
    return pg.each_window(_inspected(spark, sf_dir, texts=False)).drop("content")


@query(f"WITH {PAGES} SELECT doc, problem, outcome, coalesce(outcome = 'Valid', false) AS is_valid, n_windows, n_errors, n_warnings FROM verdicts")
def inspect_page(spark, sf_dir):
    """The flagship: the verdict on every page, whether its windows could be inspected or not."""
    return pg.outcomes(_inspected(spark, sf_dir, texts=False))


_ABOUT_PLACES = "code IN ('ADDRESS_NOT_FOUND', 'WINDOW_NOT_FOUND', 'LABEL_NOT_FOUND', 'OTHER_TEXT_IN_WINDOW') OR code IN ('ADDRESS_OUTSIDE_WINDOW', 'LABEL_OUTSIDE_WINDOW') AND contains(message, ' leży w całości ')"


@query(f"WITH {PAGES} SELECT doc, role, message AS text FROM piss WHERE {_ABOUT_PLACES}")
def page_texts(spark, sf_dir):
    """What the issues about places and other text say."""
    return pg.each_issue(_inspected(spark, sf_dir)).where(_ABOUT_PLACES).select("doc", "role", F.col("message").alias("text"))


@query(f"WITH {PAGES} SELECT code, severity, count(*) AS n, count(DISTINCT doc) AS pages FROM (SELECT doc, code, severity FROM piss UNION ALL SELECT doc, code, severity FROM wholes) GROUP BY ALL")
def page_issue_counts(spark, sf_dir):
    """How often each issue occurs, over all pages."""
    return pg.issue_counts(_inspected(spark, sf_dir, texts=False))


@query(f"""WITH {LETTERS}, x AS (SELECT *, lines AS ls FROM lv) SELECT doc, text FROM (
  SELECT doc, 'Adres ma ' || len(ls) || ' ' || CASE WHEN len(ls) = 1 THEN 'wiersz' WHEN len(ls) % 10 BETWEEN 2 AND 4 AND NOT len(ls) % 100 BETWEEN 12 AND 14 THEN 'wiersze' ELSE 'wierszy' END || ', dopuszczalne jest najwyżej 6.' AS text FROM x WHERE len(ls) > 6
  UNION ALL SELECT doc, 'Czcionka adresu ma ' || font_min || ' pt, minimum to 8 pt.' FROM x WHERE font_min < 8 UNION ALL SELECT doc, 'Czcionka adresu ma ' || font_max || ' pt, zalecane maksimum to 14 pt.' FROM x WHERE font_max > 14
  UNION ALL SELECT doc, 'Adres w dokumencie różni się od danych odbiorcy. Brakuje wierszy: ' || array_to_string(list_transform(list_filter(expected_lines, lambda x: NOT list_contains(list_transform(ls, lambda x: {_NORMAL}), {_NORMAL})), lambda x: '„' || x || '”'), '; ') || '.' FROM x WHERE mismatch)""")
def letter_texts(spark, sf_dir):
    """What some issues of a letter's text say, with counts, sizes and lines filled in."""
    x = dv.letters(spark, sf_dir).withColumn("own", ad.normalize_lines(F.col("lines"))).withColumn("missing", F.coalesce(ad.missing_lines(F.col("lines"), F.col("expected_lines")), F.array().cast("array<string>")))
    n, limits = F.size("own"), rules.RECIPIENT
    said = [F.when(n > limits.max_lines, m.line_count(n, limits.max_lines, False)), F.when(F.col("font_min") < limits.min_font, m.font(F.col("font_min"), limits.min_font, True)),
            F.when(F.col("font_max") > limits.max_font, m.font(F.col("font_max"), limits.max_font, False)), F.when(F.size("missing") > 0, m.mismatch(F.col("missing")))]
    return x.select("doc", F.explode(F.array_compact(F.array(*said))).alias("text"))


@query("""SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 7 = 6 THEN 'unknown_mode' WHEN o_orderkey % 5 = 4 THEN 'unknown_layout' WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 IN (0, 2, 3) THEN 'no_sender_window' END AS problem,
  CASE WHEN o_orderkey % 4 = 0 THEN 'page_number' WHEN o_orderkey % 700 NOT BETWEEN 36 AND 600 THEN 'preview_dpi' END AS option_problem FROM orders""")
def settings_check(spark, sf_dir):
    """Layouts joined by name, modes and options: bad ones are rows with a problem."""
    k = F.col("o_orderkey")
    layout = F.element_at(F.array(*map(F.lit, ("c65_single", "c65_two", "dl_din_b", "dl_din_a", "unknown"))), (k % 5 + 1).cast("int"))
    o = dv.table(spark, sf_dir, "orders").select(k.alias("doc"), layout.alias("layout"), F.when(k % 7 == 6, "Triple").when(k % 2 == 0, "Double").otherwise("Single").alias("mode"))
    return pg.layout_problem(o, layout_windows(spark)).select("doc", "problem", pg.option_problem(F.col("doc") % 4, F.col("doc") % 700).alias("option_problem"))


SHOWN = f"""{PAGES},
shown AS (SELECT o.doc, o.role, o.found, o.outcome, 'Address' AS content, w.wname AS name, w.wl, w.wt, w.ww, w.wh, c.l, c.t, c.w, c.h, NULL AS num, NULL AS human, NULL AS kind, c.lines, CASE WHEN w.expected_lines IS NULL THEN 'NotChecked' WHEN c.doc IS NULL THEN NULL WHEN len(c.lacking) > 0 THEN 'Mismatch' ELSE 'Matched' END AS match
    FROM pout o JOIN rw w ON w.doc = o.doc LEFT JOIN rv c ON c.doc = o.doc AND c.role = 'recipient' WHERE o.role = 'recipient'
  UNION ALL SELECT o.doc, o.role, o.found, o.outcome, 'Address', w.wname, w.wl, w.wt, w.ww, w.wh, c.l, c.t, c.w, c.h, NULL, NULL, NULL, c.lines, 'NotChecked' FROM pout o JOIN sw w ON w.doc = o.doc AND w.content = 'Address' LEFT JOIN rv c ON c.doc = o.doc AND c.role = 'sender' WHERE o.role = 'sender'
  UNION ALL SELECT o.doc, o.role, o.found, o.outcome, 'RegisteredLabel', w.wname, w.wl, w.wt, w.ww, w.wh, c.l, c.t, c.w, c.h, CASE WHEN c.was_read THEN c.own_number END, CASE WHEN c.was_read THEN {_HUMAN.replace("own_number", "c.own_number").replace("CASE type", "CASE c.type")} END, CASE WHEN c.was_read THEN c.type END, NULL, NULL
    FROM pout o JOIN sw w ON w.doc = o.doc AND w.content <> 'Address' LEFT JOIN picked c ON c.doc = o.doc WHERE o.role = 'sender'),
told AS (SELECT *, CASE WHEN found THEN {_over_text()} ELSE '' END AS over_text FROM shown),
sentences AS (SELECT doc, string_agg(CASE WHEN found THEN name || ': ' || CASE outcome WHEN 'Valid' THEN 'OK' WHEN 'Inconclusive' THEN 'nierozstrzygnięte' ELSE 'błąd' END || CASE WHEN over_text <> '' THEN ' (wystaje ' || over_text || ')' ELSE '' END
  WHEN content = 'RegisteredLabel' THEN name || ': nie znaleziono nalepki R' ELSE name || ': nie znaleziono adresu' END, '; ' ORDER BY role) AS summary FROM told GROUP BY doc)"""


@query(f"""WITH {SHOWN}, x AS (SELECT *, CASE WHEN content = 'RegisteredLabel' THEN 'nalepka R' || coalesce(' ' || num, '') ELSE 'adres' END AS what FROM told)
SELECT doc, role, 'window' AS kind, CASE outcome WHEN 'Valid' THEN 'ok' WHEN 'Inconclusive' THEN 'unsure' ELSE 'error' END AS colour, wl AS "left", wt AS "top", wl + ww AS "right", wt + wh AS "bottom", false AS sticks_out,
  name || ': ' || CASE WHEN found THEN CASE outcome WHEN 'Valid' THEN 'OK' WHEN 'Inconclusive' THEN 'NIEROZSTRZYGNIĘTE' ELSE 'BŁĄD' END WHEN content = 'RegisteredLabel' THEN 'BRAK NALEPKI R' ELSE 'BRAK ADRESU' END AS caption FROM x
UNION ALL SELECT doc, role, 'content', CASE WHEN over_text <> '' THEN 'error' ELSE 'content' END, l, t, l + w, t + h, over_text <> '', CASE WHEN over_text <> '' THEN what || ' wystaje: ' || over_text ELSE what END FROM x WHERE found""")
def overlay_rows(spark, sf_dir):
    return pg.overlays(_inspected(spark, sf_dir))


@query(f"WITH {SHOWN} SELECT p.doc, coalesce(summary, x.message) AS summary FROM pages_ p LEFT JOIN sentences s ON s.doc = p.doc LEFT JOIN wholes x ON x.doc = p.doc")
def page_summary(spark, sf_dir):
    return pg.summaries(_inspected(spark, sf_dir))


_MM1 = lambda *v: "{" + ", ".join(f"'{k}': round_even({x}, 1)" for k, x in zip(("left", "top", "width", "height"), v)) + "}"
_OVER1 = "{" + ", ".join(f"'{k}': {_over()[k]}" for k in ("left", "top", "right", "bottom")) + "}"


@query(f"""WITH {SHOWN}, i AS (SELECT doc, role, list({{'code': code, 'severity': severity, 'message': message}} ORDER BY code, severity, message) AS issues FROM piss GROUP BY ALL),
w AS (SELECT s.doc, list({{'role': s.role, 'content': s.content, 'outcome': outcome, 'found': found, 'name': name, 'area': {_MM1("wl", "wt", "ww", "wh")}, 'contentArea': CASE WHEN found THEN {_MM1("l", "t", "w", "h")} END, 'overflow': CASE WHEN found THEN {_OVER1} END,
    'lines': s.lines, 'number': num, 'numberHumanReadable': human, 'numberType': kind, 'recipientMatch': match, 'issues': coalesce(i.issues, [])}} ORDER BY s.role) AS windows
  FROM shown s LEFT JOIN i ON i.doc = s.doc AND i.role = s.role GROUP BY s.doc)
SELECT o.doc, CAST(to_json({{'doc': o.doc, 'problem': o.problem, 'outcome': o.outcome, 'isValid': coalesce(o.outcome = 'Valid', false), 'summary': coalesce(summary, x.message), 'documentIssues': CASE WHEN x.code IS NULL THEN [] ELSE [{{'code': x.code, 'severity': x.severity, 'message': x.message}}] END, 'windows': coalesce(w.windows, [])}}) AS VARCHAR) AS json
FROM verdicts o LEFT JOIN w ON w.doc = o.doc LEFT JOIN wholes x ON x.doc = o.doc LEFT JOIN sentences s ON s.doc = o.doc""")
def page_json(spark, sf_dir):
    return pg.responses(_inspected(spark, sf_dir))


@query("""SELECT page_id AS doc, mode, CASE WHEN mode = 'Double' AND page_id % 3 = 0 THEN 'no_sender_window' END AS problem FROM pages CROSS JOIN (VALUES ('Single'), ('Double')) x(mode)""")
def pages_in_modes(spark, sf_dir):
    """A folder's documents in both modes."""
    p = dv.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.when(F.col("page_id") % 3 == 0, "c65_single").otherwise("c65_two").alias("layout"))
    return pg.layout_problem(pg.in_modes(p), layout_windows(spark)).select("doc", "mode", "problem")


_GLYPH = """g AS (SELECT l_orderkey AS doc, l_linenumber AS n, CASE WHEN l_partkey % 9 = 0 THEN 'Ż' ELSE 'x' END AS ch, CAST(6 + l_linenumber AS DOUBLE) AS size, CAST(l_partkey % 500 AS DOUBLE) AS x1, CAST(l_suppkey % 700 AS DOUBLE) AS y1,
  CASE WHEN l_suppkey % 5 = 0 THEN 0.0 WHEN l_suppkey % 2 = 0 THEN CAST(6 AS DOUBLE) ELSE 0.0 END AS dx, CASE WHEN l_suppkey % 5 = 0 THEN 0.0 WHEN l_suppkey % 2 = 0 THEN 0.0 ELSE CAST(5 AS DOUBLE) END AS dy, (l_partkey % 4) * 90 AS turn, (l_suppkey % 4) * 90 AS rot FROM lineitem),
e AS (SELECT *, dx = 0 AND dy = 0 AS flat FROM g),
f AS (SELECT *, CASE WHEN flat THEN CASE turn WHEN 0 THEN 1.0 WHEN 180 THEN -1.0 ELSE 0.0 END * size * 0.5 ELSE dx END AS ex, CASE WHEN flat THEN CASE turn WHEN 90 THEN 1.0 WHEN 270 THEN -1.0 ELSE 0.0 END * size * 0.5 ELSE dy END AS ey FROM e),
h AS (SELECT *, sqrt(ex * ex + ey * ey) AS len, size * CASE ch WHEN 'Ż' THEN 0.92 ELSE 0.8 END AS up, size * 0.22 AS down FROM f),
k AS (SELECT *, -ey / len AS nx, ex / len AS ny FROM h),
m AS (SELECT *, least(x1 - nx * down, x1 + nx * up, x1 + ex - nx * down, x1 + ex + nx * up) AS lo_x, greatest(x1 - nx * down, x1 + nx * up, x1 + ex - nx * down, x1 + ex + nx * up) AS hi_x,
  least(y1 - ny * down, y1 + ny * up, y1 + ey - ny * down, y1 + ey + ny * up) AS lo_y, greatest(y1 - ny * down, y1 + ny * up, y1 + ey - ny * down, y1 + ey + ny * up) AS hi_y,
  CASE rot WHEN 0 THEN 7.0 WHEN 90 THEN 11.0 ELSE 0.0 END AS ox, CASE rot WHEN 0 THEN 11.0 ELSE 0.0 END AS oy FROM k)"""


@query(f"""WITH {_GLYPH} SELECT doc, n, round((lo_x - ox) * 25.4 / 72, 6) AS "left", round((842 - (hi_y - oy)) * 25.4 / 72, 6) AS "top", round((hi_x - lo_x) * 25.4 / 72, 6) AS width, round((hi_y - lo_y) * 25.4 / 72, 6) AS height, abs(ex) >= abs(ey) AS horizontal FROM m""")
def glyph_boxes(spark, sf_dir):
    """Letters on turned pages and baselines, as boxes on the page."""
    k = lambda c, n: F.col(c) % n
    d = lambda x: F.lit(x).cast("double")
    still, flat = k("l_suppkey", 5) == 0, k("l_suppkey", 2) == 0
    x = dv.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), F.when(k("l_partkey", 9) == 0, "Ż").otherwise("x").alias("ch"), (F.col("l_linenumber") + 6).cast("double").alias("size"),
        k("l_partkey", 500).cast("double").alias("x1"), k("l_suppkey", 700).cast("double").alias("y1"), F.when(still, 0.0).when(flat, 6.0).otherwise(0.0).alias("dx"), F.when(still | flat, 0.0).otherwise(5.0).alias("dy"),
        (k("l_partkey", 4) * 90).alias("turn"), (k("l_suppkey", 4) * 90).alias("rot"),
    )
    x = x.withColumn("b", g.glyph_box(F.col("ch"), F.col("size"), F.col("x1"), F.col("y1"), F.col("x1") + F.col("dx"), F.col("y1") + F.col("dy"), F.col("turn")))
    r = x.withColumn("r", g.page_rect(*(F.col(f"b.{s}") for s in ("left", "bottom", "right", "top")), d(7), d(11), F.col("rot"), d(842)))
    across = F.abs(F.col("b.x2") - F.col("x1")) >= F.abs(F.col("b.y2") - F.col("y1"))
    return r.select("doc", "n", *(F.round(F.col(f"r.{s}"), 6).alias(s) for s in ("left", "top", "width", "height")), across.alias("horizontal"))


@query(f"""WITH {LETTERS} SELECT doc, regexp_replace(array_to_string(lines, ' '), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS file_name, CASE WHEN regexp_matches(number, '\\p{{L}}') THEN 'International' ELSE 'Domestic' END AS kind FROM letters""".replace("\\\\", "\\"))
def letter_names(spark, sf_dir):
    """File names from addresses, and the kind of mail that a number suggests."""
    from fenestra.operators import requests

    return dv.letters(spark, sf_dir).select("doc", requests.letters_and_digits(F.array_join("lines", " ")).alias("file_name"), requests.mail_kind(F.col("raw")).alias("kind"))
