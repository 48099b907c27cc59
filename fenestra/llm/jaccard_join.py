"""N-gram Jaccard join by adaptive multi-match prefixes.

Shingles have one global order: rare ones first, by hash, then those that a sketch of fixed size knows as frequent. If two sets overlap enough to
link, their first |set| - needed + m shingles share m at least. Each document chooses m by estimated cost: a longer prefix is read more, but demands more
common shingles before a pair is verified. A pair is a candidate if it shares the smaller of both m.

Groups of near copies never become all pairs. Documents with equal sets are one node. Then a bucket (the nodes with
one prefix shingle) offers each node a few leaders; verified links merge nodes into components. Nodes that are still in different components are a pair
only if enough of both prefixes lies behind the place where they meet; those pairs are verified one by one, which makes the components exact.
"""

from __future__ import annotations

import zlib
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.llm.batches import map_batches
from fenestra.llm.common import cut, read, sized
from fenestra.llm.components import merge
from fenestra.llm.shingles import WordHashes, meets, repeated, shingle_sets

WIDTH = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Cells of the frequency sketch (4 bytes each), in blocks that are summed apart. Its size doesn't depend on the data; a fuller sketch only orders less well.
CELLS, BLOCKS = 1 << 20, 64
#: What verifying a pair costs, in reads of a bucket's row.
VERIFY = 20.0
#: Random leaders offered to a node that its first leader didn't link.
LEADERS = 6
#: Pairs of one node that are verified in one place.
GROUP = 500


def _matches(n: int) -> int:
    """The least m of a set of n shingles: a power of two that grows with it. A document may choose 2, 4, ... times as many."""
    return 1 << max(0, (n // 16).bit_length() - 1)


def _sets_and_sketch(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a row for each document, and each task's part of the sketch in blocks."""

    def run(batches):
        import pyarrow as pa

        hashes, cells, held, waiting = WordHashes(), np.zeros(CELLS, np.int64), [], 0
        for batch in batches:
            n, keys = [], []
            for _, s in shingle_sets(batch.column(1), hashes, WIDTH):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                held.append((s % np.uint64(CELLS)).astype(np.int64))
                waiting += len(s)
                if waiting > 500_000:
                    cells += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, waiting = [], 0
            empty = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), empty.cast(pa.int32()), empty.cast(pa.binary())], ["doc_id", "n", "key", "block", "cells"])
        if held:
            cells += np.bincount(np.concatenate(held), minlength=CELLS)
        packed = [zlib.compress(part.astype("<i4").tobytes(), 1) for part in np.split(cells, BLOCKS)]
        empty = pa.nulls(BLOCKS)
        yield pa.RecordBatch.from_arrays([empty.cast(pa.int64()), empty.cast(pa.int64()), empty.cast(pa.binary()), pa.array(range(BLOCKS), pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "n", "key", "block", "cells"])

    return map_batches(docs, run, "doc_id bigint, n bigint, key binary, block int, cells binary")


def _sum_sketch(parts: DataFrame) -> np.ndarray:
    """The sketch of all tasks: blocks are summed in groups of 256 parts, then by block. The driver gets CELLS counts."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // BLOCKS, np.int64)
        for c in pdf["cells"]:
            total += np.frombuffer(zlib.decompress(c), "<i4")
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "cells": [zlib.compress(np.minimum(total, 2**31 - 1).astype("<i4").tobytes(), 1)]})

    some = parts.select("block", "cells").withColumn("some", F.floor(F.spark_partition_id() / 256))
    once = some.groupBy("block", "some").applyInPandas(lambda pdf: add(pdf), "block int, cells binary")
    rows = once.groupBy("block").applyInPandas(lambda pdf: add(pdf), "block int, cells binary").collect()
    out = np.zeros(CELLS, np.int32)
    for r in rows:
        out[r.block * (CELLS // BLOCKS) : (r.block + 1) * (CELLS // BLOCKS)] = np.frombuffer(zlib.decompress(r.cells), "<i4")
    return out


def _prefixes(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """shingle, doc_id, n, m, least (of any m that a set may have which links to this one) and typical (how frequent the document's shingles are)
    for every shingle of the chosen prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # CELLS counts
    mean = float(sketch.mean())
    floor = mean + 4 * mean**0.5 + 1

    def run(batches):
        import pyarrow as pa

        hashes, cells, names = WordHashes(), shared.value, ["shingle", "doc_id", "n", "m", "least", "typical"]
        held, rows = [], 0

        def batch_of(held):
            cols = [np.concatenate(c) for c in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1]), *(pa.array(c.astype(np.int32)) for c in cols[2:])], names)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, s in shingle_sets(batch.column(1), hashes, WIDTH):
                n = len(s)
                if not n:
                    continue
                seen = cells[(s % np.uint64(CELLS)).astype(np.int64)].astype(np.float64)
                over = np.where(seen > floor, seen - mean, 0.0)
                s = s[order := np.lexsort((s, over))]
                reads = np.cumsum(1 + over[order])
                needed = -(-PERCENT * n // 100)
                choices = [m for m in (_matches(n) << k for k in range(5)) if m <= needed]
                m = min(choices, key=lambda x: reads[n - needed + x - 1] * (1 + VERIFY / x**2))
                s = s[: n - needed + m]
                k = len(s)
                held.append((s, np.full(k, ids[i]), np.full(k, n), np.full(k, m), np.full(k, _matches(needed)), np.full(k, int(100 * np.log2(1 + over).mean()))))
                rows += k
                if rows >= 100_000:
                    yield batch_of(held)
                    held, rows = [], 0
        if held:
            yield batch_of(held)

    return map_batches(docs, run, "shingle bigint, doc_id bigint, n int, m int, least int, typical int")


def _in_buckets(prefixes: DataFrame) -> DataFrame:
    """The rows of `prefixes` but for shingles that one document has alone; a few of those stay, which a later join drops."""
    shared = prefixes.sparkSession.sparkContext.broadcast(repeated(prefixes.select(F.col("shingle").alias("hash"), "doc_id")))

    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            yield batch.filter(meets(h, shared.value))

    return map_batches(prefixes, run, prefixes.schema)


def _linkable(prefixes: DataFrame, rounds: int = 2) -> DataFrame:
    """The prefix rows of nodes that may link, in buckets of several nodes, with own: how many of them the node has.

    A link shares at least the smaller m of both, hence `least` of either, so a node with fewer such rows has none. Dropping it thins out
    buckets; a second round drops more.
    """
    rows = prefixes
    for _ in range(rounds):
        several = rows.groupBy("shingle").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("shingle")
        rows = rows.drop("own").join(cut(several).hint("merge"), "shingle", "left_semi")
        mine = rows.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("own"), F.min("least").alias("_least")).where("own >= _least").select("doc_id", "own")
        rows = cut(rows.join(cut(mine).hint("merge"), "doc_id"))
    return rows


def _may_link(a: str, b: str, common: Column | None = None) -> Column:
    """Whether 100 * common >= PERCENT * union is possible, `common` being shared prefix rows (at most the smaller own).

    Up to where the first of both prefixes ends, all that is common has been counted; behind it, no more than the rest of that set can be.
    """
    c = lambda x, end: F.col(f"{x}_{end}").cast("bigint")
    rest = lambda end: F.ceil(c("n", end) * PERCENT / 100) - c("m", end)
    most = (F.least(c("own", a), c("own", b)) if common is None else common) + F.greatest(rest(a), rest(b))
    return (100 + PERCENT) * most >= PERCENT * (c("n", a) + c("n", b))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and s (its distinct shingles, 8 bytes each, ascending) of the documents in `ids` (doc_id)."""
    texts = docs.join(sized(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            ids, held, waiting, first = batch.column(0), [], 0, 0
            for i, s in shingle_sets(batch.column(1), hashes, WIDTH):
                held.append(s.tobytes())
                waiting += len(s)
                if waiting > 500_000 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, i + 1 - first), pa.array(held, pa.binary())], ["doc_id", "s"])
                    held, waiting, first = [], 0, i + 1

    return map_batches(texts.select("doc_id", "text"), run, "doc_id bigint, s binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) that link, by the exact intersection of their sets.

    A node's set travels once for each pair as b, and once for every GROUP pairs as a; rows of a group follow their a, so a task holds two sets.
    """
    pairs = cut(pairs)
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("a", F.ceil(F.col("n") / GROUP).alias("groups"))
    dealt = pairs.join(sized(cut(hot)), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "groups"), F.lit(0)).alias("g"))
    dealt = cut(dealt)
    lead = dealt.select("a", "g").distinct().join(sets.withColumnRenamed("doc_id", "a").hint("merge"), "a").select("a", "g", F.lit(None).cast("bigint").alias("b"), "s")
    follow = dealt.join(sets.withColumnRenamed("doc_id", "b").hint("merge"), "b").select("a", "g", "b", "s")
    ordered = lead.union(follow).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        x = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                y = np.frombuffer(s.as_buffer(), np.uint64)
                if b is None:
                    x = y.copy()
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common = int((x[at] == y).sum())
                if 100 * common >= PERCENT * (len(x) + len(y) - common):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return cut(map_batches(ordered.select("a", "b", "s"), run, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles (long) and component_id for each row of `docs` (doc_id, text).

    Texts without words, and null ones, have an empty set and are linked with nothing. Rows with one doc_id are one document, in one component;
    a row with a null doc_id links nothing and has a null component_id. An empty table gives an empty result. Other columns are not read. Shingles are compared
    by 64-bit hashes of their words' 64-bit hashes, whole sets by 128 bits.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    found = cut(_sets_and_sketch(docs))
    sets = found.where(F.col("block").isNull()).select("doc_id", "n", "key")
    named = sets.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    same = cut(named.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") != F.col("last")).drop("last"))
    copies = cut(named.join(same, "key").where(F.col("doc_id") != F.col("first")).select("doc_id", "first").distinct())
    nodes = docs.where(F.col("doc_id").isNotNull()).join(sized(copies.select("doc_id")), "doc_id", "left_anti")

    prefixes = cut(_in_buckets(cut(_prefixes(nodes, _sum_sketch(found.where(F.col("block").isNotNull()))))))
    rows = _linkable(prefixes)
    leaders = rows.groupBy("shingle").agg(F.max(F.struct("typical", (-F.col("doc_id")).alias("id"))).alias("top"))
    leaders = cut(leaders.select("shingle", (-F.col("top.id")).alias("leader")))
    rows = cut(rows.drop("typical").join(leaders.hint("merge"), "shingle"))

    sets_of = cut(_sets(nodes, cut(rows.select("doc_id").distinct())))
    offers = rows.where(F.col("doc_id") != F.col("leader")).groupBy("doc_id", "leader").agg(F.count(F.lit(1)).alias("shared"), F.min("m").alias("m"))
    # one leader for each node, if it leads enough of the node's buckets to make a link likely
    best = offers.where(F.col("shared") >= F.col("m")).groupBy("doc_id").agg(F.max_by("leader", F.struct("shared", -F.col("leader"))).alias("leader"))
    labels = merge(None, _verified(best.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")), sets_of))

    # a node alone, beside a component: a few of that bucket's nodes, another for each shingle
    mixed = _mixed(rows, labels)
    chance = F.xxhash64("shingle", "doc_id")
    pick = mixed.groupBy("shingle").agg(F.max(F.struct("grown", chance.alias("chance"), "doc_id", "component", "n", "m", "own")).alias("pick")).select("shingle", "pick.*")
    pick = cut(pick.where("grown").select("shingle", F.col("doc_id").alias("a"), F.col("component").alias("_c"), *(F.col(c).alias(f"{c}_a") for c in ("n", "m", "own"))))
    met = mixed.withColumnsRenamed({"doc_id": "b", "n": "n_b", "m": "m_b", "own": "own_b"}).join(pick.hint("merge"), "shingle").where((F.col("component") != F.col("_c")) & _may_link("a", "b"))
    met = met.withColumn("near", F.count(F.lit(1)).over(Window.partitionBy("b", "_c"))).where(F.col("near") >= F.col("least"))
    few = Window.partitionBy("b").orderBy(F.desc("shared"), F.xxhash64("a", "b"), "a")
    tries = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).withColumn("place", F.row_number().over(few))
    tries = tries.where(F.col("place") <= LEADERS).select("a", "b")
    labels = merge(labels, _verified(tries, sets_of))

    labels = merge(labels, _verified(_pairs_left(_mixed(rows, labels)), sets_of))

    out = sets.join(copies, "doc_id", "left").withColumn("id", F.coalesce("first", "doc_id")).join(labels, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _pairs_left(mixed: DataFrame) -> DataFrame:
    """a, b: every pair of nodes of different components that the prefixes allow to link.

    A pair that links shares some number of rows at least. Both have their rows in one order, those of small buckets first, so their first shared row has so many rows less one
    behind it on either side. That excludes nearly all meetings in large buckets, which come last.
    """
    sizes = cut(mixed.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")))
    order = Window.partitionBy("doc_id").orderBy("size", "shingle")
    ranked = cut(mixed.join(sizes.hint("merge"), "shingle").withColumn("behind", F.col("own") - F.row_number().over(order) + 1))
    side = lambda x: ranked.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "m", "behind", "component")))
    left, right = side("a"), side("b")
    c = lambda name: F.col(name).cast("bigint")
    fits = (F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("component_a") != F.col("component_b"))
    fits &= (100 * c("n_a") >= PERCENT * c("n_b")) & (100 * c("n_b") >= PERCENT * c("n_a"))
    fits &= (F.least("behind_a", "behind_b") >= F.least("m_a", "m_b")) & _may_link("a", "b", F.least(c("behind_a"), c("behind_b")))
    met = left.join(right.hint("merge"), (left["shingle"] == right["shingle"]) & fits)
    return met.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def _mixed(rows: DataFrame, labels: DataFrame, rounds: int = 2) -> DataFrame:
    """The rows of buckets that hold more than one component, with component and grown (not a single node).

    What a node shares with one of another component lies in such buckets, so only their rows count as its own, and a node with fewer than
    `least` of them has no link left to find.
    """
    known = rows.drop("leader").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    known = known.withColumns({"grown": F.col("component").isNotNull(), "component": F.coalesce("component", "doc_id")})
    for _ in range(rounds):
        several = known.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("shingle")
        known = known.drop("own").join(cut(several).hint("merge"), "shingle", "left_semi")
        mine = known.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("own"), F.min("least").alias("_least")).where("own >= _least").select("doc_id", "own")
        known = cut(known.join(cut(mine).hint("merge"), "doc_id"))
    return known


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component, the document with the smallest doc_id, once."""
    found = near_duplicates(docs)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(sized(cut(gone)), "doc_id", "left_anti")
    # rows that share an id are one document; ids that occur once are not moved
    again = cut(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"))
    twice = kept.join(sized(again), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(sized(again), "doc_id", "left_anti").unionByName(twice).select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles, component_id, by near_duplicates(); nulls, ties and repeats as there."""
    return near_duplicates(read(spark, sf_dir, "documents"))


OP9_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+{WIDTH - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WIDTH - 2}, 2))) AS i FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1, 2
"""
