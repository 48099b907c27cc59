import io
import zipfile

from fenestra.streaming import drop_folder


def zipped(name):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, "<w:document/>")
    return out.getvalue()


def test_drop_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.pdf", b"x%PDF-1.4 ..."), ("b.docx", zipped("Word/Document.xml")), ("c.txt", b"text"), ("d.docx", zipped("other.xml")), ("e.docx", b"PK\x03\x04zip")):
        (tmp_path / "in" / name).write_bytes(body)
    q = drop_folder.documents(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("dropped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.file_name: (r.is_pdf, r.problem) for r in spark.table("dropped").collect()}
    assert got == {"a.pdf": (True, None), "b.docx": (False, None), "c.txt": (False, "unknown_format"), "d.docx": (False, "unknown_format"), "e.docx": (False, "unknown_format")}


def test_empty_document(spark):
    # Spark's file sources leave files of no bytes out; other rows may be empty
    d = spark.createDataFrame([("x/d.pdf", 0, b"")], "path string, length bigint, content binary")
    assert drop_folder.intake(d).first().problem == "empty"
