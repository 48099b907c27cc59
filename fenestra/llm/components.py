"""Connected components of links between integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenestra.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id that can be reached) for every id in `links` (a, b).

    Each round takes the smallest label among the neighbours and then the label's own label, so long chains shorten by halves. Rounds are
    written to the shared folder. Ids without links don't appear; repeated, reversed or looped links do no harm.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = cut(both.distinct())
    now = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")))
    while True:
        near = both.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = now.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = now.select(F.col("id").alias("to"), F.col("component").alias("then"))
        after = cut(step.join(jump, "to", "left").select("id", "was", F.least("to", F.coalesce("then", "to")).alias("component")))
        if after.where(F.col("was") != F.col("component")).isEmpty():
            return after.select("id", "component")
        now = after.select("id", "component")


def merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of the ids in `labels` (id, component, from earlier links) and in `links` together."""
    if labels is None:
        return components(links)
    name = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"_{end}"))
    lifted = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    new = components(lifted.where(F.col("a") != F.col("b")))
    up = new.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    known = labels.join(up, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    return cut(known.union(new.join(labels.select("id"), "id", "left_anti")))
