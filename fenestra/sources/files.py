"""Documents from folders, as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.operators.pages import in_modes
from fenestra.operators.requests import LARGEST, is_docx, is_pdf


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf", largest: int = LARGEST) -> DataFrame:
    """path, length, content and problem (too_large, unreadable, or null) of the files of a folder and those below it.

    Names and lengths are filtered by the reader: files of other names aren't listed, and those that are too large aren't opened, so they have no content. Spark lists no empty files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    fine = files.where(F.col("length") <= largest)
    odd = files.where(F.col("length") > largest).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("problem"))
    unreadable = F.when(~is_pdf(F.col("content")) & ~is_docx(F.col("content")), "unreadable")
    return fine.select("path", "length", "content", unreadable.alias("problem")).unionByName(odd)


def each_mode(documents: DataFrame) -> DataFrame:
    """Every document in both modes, in the order of paths, Single first."""
    return in_modes(documents).orderBy("path", F.desc("mode"))
