"""Requests for inspections: orders, forms, documents; bad ones become rows with a problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenestra.functions.addresses import normalize_lines, trim
from fenestra.operators.scans import counted

LARGEST = 20 * 1024 * 1024


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def recipient_lines(lines: Column) -> Column:
    """White space collapsed, empty lines gone."""
    return normalize_lines(lines)


def validate_orders(orders: DataFrame) -> DataFrame:
    """Adds lines, number and problem to rows of envelope (Single, Double), recipient_lines and registered_number.

    A Single order drops its number, a Double one needs it; 2 to 6 lines are needed.
    """
    lines, number = recipient_lines(F.col("recipient_lines")), blank_to_null(F.col("registered_number"))
    n = F.size(lines)
    problem = F.when(~F.col("envelope").isin("Single", "Double"), "unknown_envelope").when(~n.between(2, 6), "recipient_lines").when((F.col("envelope") == "Double") & number.isNull(), "number_missing")
    return orders.withColumns({"lines": lines, "number": F.when(F.col("envelope") == "Double", number), "problem": problem})


def form_house_number(form_id: Column) -> Column:
    """The house number of a form's letter: the low byte of the id's first group, modulo 200, plus 1; null for an id that isn't one, or all zeros."""
    ok = form_id.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") & form_id.rlike("[1-9a-fA-F]")
    return F.when(ok, (F.conv(F.substring(form_id, 7, 2), 16, 10).cast("int") % 200 + 1))


def strip_data_uri(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "(?i)^data:[^,]*,", "")


def decode_base64(c: Column) -> Column:
    """Bytes of base64 text with or without a data URI's head; null if it isn't base64."""
    return F.try_to_binary(strip_data_uri(c), F.lit("base64"))


def data_uri(content: Column, mime: str) -> Column:
    """A data URI; base64() breaks lines, which a URI must not."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def is_pdf(content: Column) -> Column:
    """Whether the mark of a PDF stands in the first 1024 bytes."""
    return F.contains(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), F.lit("%PDF-"))


def is_docx(content: Column) -> Column:
    """Whether the content is a zip with the part that every Word document has; its name stands plainly in the zip's directory."""
    return (F.hex(F.substring(content, 1, 4)) == "504B0304") & F.contains(F.lower(F.decode(content, "ISO-8859-1")), F.lit("word/document.xml"))


def safe_file_name(c: Column) -> Column:
    return F.substring(F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1), 1, 255)


def letters_and_digits(c: Column) -> Column:
    """A name of letters and digits only."""
    return F.regexp_replace(c, r"[^\p{L}\p{Nd}]", "")


def mail_kind(number: Column) -> Column:
    """International if a number has any letter, else Domestic."""
    return F.when(number.rlike(r"\p{L}"), "International").otherwise("Domestic")


def problem_status(problem: Column) -> Column:
    """The HTTP status of a problem; null for none."""
    return F.when(problem.isNull(), F.lit(None).cast("int")).when(problem == "unreadable", 422).when(problem == "conversion_failed", 502).when(problem == "conversion_disabled", 503).when(problem == "internal", 500).otherwise(400)


#: Documents whose ord lies in one range are numbered together.
ORD_RANGE = 100_000


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds _n: the place of a row among those with its sha256, by ord; in two levels, as one content can be that of very many rows."""
    return counted(rows, ["sha256"], F.floor(F.col("ord") / ORD_RANGE), [F.col("ord")], F.lit(1), "_n")


def with_rendered(documents: DataFrame, renders: DataFrame) -> DataFrame:
    """`documents` (ord, content, file_name) with pdf from `renders` (ord, sha256, file_name, pdf): by content first, then by file name.

    A render by content serves one document: of equal contents, the first document takes the first render and so on, by ord (unique). Documents that are left take the first render of their file
    name, which isn't used up. Every document stays one row; null contents and names match nothing.
    """
    own = documents.withColumn("sha256", F.sha2("content", 256))
    known = own.where("sha256 IS NOT NULL").select("ord", "sha256")
    taken = _numbered(known).join(_numbered(renders.where("sha256 IS NOT NULL").select("ord", "sha256", "pdf")).select("sha256", "_n", F.struct("pdf").alias("_by_hash")), ["sha256", "_n"]).select("ord", "_by_hash")
    named = renders.where("file_name IS NOT NULL").groupBy("file_name").agg(F.min_by(F.struct("pdf"), "ord").alias("_by_name"))
    found = own.drop("sha256").join(taken, "ord", "left").join(named, "file_name", "left")
    return found.select(*documents.columns, F.coalesce("_by_hash", "_by_name")["pdf"].alias("pdf"))
