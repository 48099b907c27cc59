"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"

#: A side of a join is broadcast only when it has been counted and, in memory, takes no more bytes than this.
BROADCAST_BYTES = 64_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the checkpoint directory that all machines share.

    The cluster names it in spark.checkpoint.dir. Where that is unset, a temporary folder takes its place if all runs on one machine, as in tests;
    else there is no folder that all machines see, and this fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small or reused result by writing it, as Parquet, to the shared folder."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast if the table of fixed-width columns, counted here unless `rows` is given, is within BROADCAST_BYTES; else a shuffle join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * (32 + 8 * len(df.columns)) <= BROADCAST_BYTES else df.hint("merge")


def look_up(df: DataFrame, table: DataFrame, on: list[str], by: str, hot: int = 50_000) -> DataFrame:
    """df.join(table, on, "left") where `table` has one row a key and some keys are those of very many rows of `df`.

    The `hot` rows of `table` with the largest `by` are broadcast, if `table` has more at all; only rows that these don't match are shuffled.
    Both sides are read several times, so they should be tables that are written.
    """
    known = [c for c in table.columns if c not in on]
    top = cut(table.orderBy(F.col(by).desc(), *on).limit(hot))
    first = df.join(F.broadcast(top.select(*on, F.struct(*known).alias("known"))), on, "left")
    met = first.where(F.col("known").isNotNull()).select(*df.columns, *[F.col("known")[c].alias(c) for c in known])
    rest = first.where(F.col("known").isNull()).select(*df.columns).join(table.join(F.broadcast(top.select(*on)), on, "left_anti"), on, "left")
    return met.unionByName(rest.select(*df.columns, *known))


def apart(docs: DataFrame, own: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work() on the columns `own` of `docs`, with all others put aside in one, so that their names can't meet those that work() makes up for itself.

    The result has the columns of `docs` in their order, then those that work() adds; of equal names, work()'s stays.
    """
    kept = f"rest_{uuid.uuid4().hex}"
    rest = [c for c in docs.columns if c not in own]
    done = work(docs.select(*own, F.struct(*([F.col(f"`{c}`") for c in rest] or [F.lit(0)])).alias(kept)))
    new = [c for c in done.columns if c != kept and c not in own]
    old = [F.col(f"`{c}`") if c in own else F.col(kept)[c].alias(c) for c in docs.columns if (c in own and c in done.columns) or (c in rest and c not in new)]
    return done.select(*old, *new)
