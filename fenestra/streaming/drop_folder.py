"""A folder that documents are dropped into, as a stream of intake rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.operators import requests

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def documents(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """One row for each new file: file_name, length, is_pdf, sha256 and problem (empty, too_large, unknown_format).

    Spark's file sources leave files of no bytes out.
    """
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).load(folder)
    return intake(files)


def intake(files: DataFrame) -> DataFrame:
    """The same for any rows of path, length and content, streamed or not; a bad file is a row, never a failure."""
    pdf = requests.is_pdf(F.col("content"))
    word = requests.is_docx(F.col("content"))
    problem = F.when(F.col("length") == 0, "empty").when(F.col("length") > requests.LARGEST, "too_large").when(~pdf & ~word, "unknown_format")
    return files.select(requests.safe_file_name(F.col("path")).alias("file_name"), "length", pdf.alias("is_pdf"), F.sha2("content", 256).alias("sha256"), problem.alias("problem"))
