"""Mixing sources to target weights by capped water-filling.

Sources share the words of the mix by weight, but none may give more than `max_epochs` times what it has: a source that
would is clamped there, and what it leaves is shared again among the others by weight until none is above. Sorted by
cap / weight, the clamped sources are a prefix, so the water level follows from running sums over one row a source.

Inside a source, every document is repeated floor(target / size of the source) times, and the words still missing
are taken by one more repetition of documents in a seeded order (md5 of seed and doc_id) until the target is met; the last
of them gives a part. The order is summed in two steps, over fixed ranges of the md5 and within one, so a source with a third
of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.llm.common import cut, read, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Leading hexadecimal digits of the md5 that make a range: 4096 ranges a source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets for `sizes`, one row a source with source and source_size (long).

    Sources in code point order, null last, take the weights in turn. Returns source, source_size, target (double). The windows
    without a key are over one row a source. A mix of no words has targets of 0.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place")
    w = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    d = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  products of a cap and a sum of weights can pass 2**63
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
        .withColumn("words_left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("clamped", d("cap") * d("weight_left") <= d("w") * d("words_left"))
    )
    level = F.min(F.when(~F.col("clamped"), F.struct("ratio", "place", "words_left", "weight_left"))).over(Window.partitionBy())
    share = (F.col("w") * F.col("level.words_left")).cast("double") / F.col("level.weight_left").cast("double")
    return ranked.withColumn("level", level).select("source", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of `docs` (doc_id, source and others) with what the mix takes of each.

    Adds size (words; `size` or those of `text`), source_size (long), target (double, of the source), whole (long, full repetitions) and extra (long,
    words of one more repetition; all, some or none of the text). Columns of these names in the input are replaced.
    A null text has 0 words; null sources are one source, the last; a null doc_id is ordered as the text "null". Repeated rows are separate documents that follow
    each other in the order. An empty table gives an empty result.
    """
    size = size if size is not None else F.size(words(F.col("text"))).cast("bigint")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = docs.withColumn("size", size).withColumn("_key", key).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    ranges = sized.groupBy("source", "_range").agg(F.sum("size").alias("n"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = ranges.withColumn("_before", before).withColumnRenamed("source", "_source").withColumnRenamed("_range", "_r").drop("n")
    goals = targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    goals = goals.withColumn("_part", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("bigint"))
    plan = plan.join(goals.withColumnRenamed("source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    mine = sized.drop("source_size", "target", "whole", "extra").withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = mine.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_part") - F.col("_before") - F.col("_in"))).cast("bigint")
    return out.withColumn("extra", extra).withColumnRenamed("_whole", "whole").drop("_key", "_range", "_in", "_source", "_r", "_before", "_part")


def materialize(docs: DataFrame, mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: one row for each repetition, with the columns of `docs`.

    `mixed` is mix(docs). Whole repetitions have the text unchanged; a partial one, of at most one document a source,
    is a run of words from a seeded place, joined by spaces. n_chars, if there, follows the text.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.greatest(F.lit(1), F.col("size") - F.col("extra") + 1)) + 1
    part = F.array_join(F.slice(words(F.col("text")), place.cast("int"), F.col("extra").cast("int")), " ")
    n = (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")
    rows = mixed.where(n > 0).withColumn("_turn", F.explode(F.sequence(F.lit(1), n)))
    rows = rows.withColumn("_cut", (F.col("_turn") > F.col("whole")) & (F.col("extra") < F.col("size")))
    rows = rows.withColumn("text", F.when(F.col("_cut"), part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, size, source_size, target and taken, by mix(); nulls and repeats as there."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"))
    return mix(cut(docs), F.col("size")).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), p AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place, source_size * {MAX_EPOCHS} AS cap FROM s
), q AS (
  SELECT *, CASE place % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS w FROM p
), r AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM q
), v AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS words_left,
         CAST(sum(w) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS weight_left FROM r
), l AS (
  SELECT words_left, weight_left FROM v WHERE NOT cap * weight_left <= w * words_left ORDER BY ratio, place LIMIT 1
), t AS (
  SELECT v.source, v.source_size, CASE WHEN v.cap * v.weight_left <= v.w * v.words_left THEN CAST(v.cap AS DOUBLE)
         ELSE CAST(v.w * l.words_left AS DOUBLE) / CAST(l.weight_left AS DOUBLE) END AS target FROM v LEFT JOIN l ON true
), g AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t
), e AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, CAST(round(g.target - g.whole * g.source_size) AS BIGINT) AS part,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, part - bef)) AS BIGINT) AS taken FROM e
"""
