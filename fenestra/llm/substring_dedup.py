"""Substring dedup by De Bruijn compaction over token k-mers.

Every window of K words is an edge of a De Bruijn graph, from the node of its first K - 1 words to that of its last. Only edges that several documents have
matter, and few are, so the texts are read for a thin sample first: each window names its least run of ANCHOR words (a minimizer).
Windows whose anchor occurs in one document only can't be repeated; the anchors of the others go into a bitmap of fixed size, and only windows
that meet it become edges. A false hit costs a row, never a result.

Each repeated edge keeps the place of its first source. Degrees of the nodes between repeated edges are counted; where one edge leads in and one leads out,
and the source goes on there, nothing branches, and the out-edge points to the in-edge. Pointers are doubled by joins until every edge knows the head of its path.
Runs of a path in a document are then compared, word by word, with the source at its coordinates before anything is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.llm.batches import map_batches, map_rows
from fenestra.llm.common import cut, read, sized
from fenestra.llm.shingles import WordHashes, inside, meets, repeated, runs, texts_hashed

K, ANCHOR = 13, 5
#: A place is part << 32 | word: parts tell the texts of one doc_id apart.
PART = 32
#: Spans of one text that are compared in one row.
SPANS = 5_000
#: Places whose joints are the bits of one number.
BLOCK = 64


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # bytes.split(): at ASCII white space


def _anchors(h: np.ndarray) -> np.ndarray:
    """The least hash of ANCHOR words in each window of K words."""
    short = runs(h, ANCHOR)
    n = len(h) - K + 1
    least = short[:n].copy()
    for k in range(1, K - ANCHOR + 1):
        np.minimum(least, short[k : k + n], out=least)
    return least


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _sampled(docs: DataFrame) -> DataFrame:
    """hash (of an anchor) and doc_id, for every stretch of windows in a document that share their anchor."""

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, sizes, h in texts_hashed(batch.column(1), hashes):
                n = len(h) - K + 1
                if n <= 0:
                    continue
                a, row = _anchors(h), np.repeat(np.arange(len(sizes)), sizes)[:n]
                new = np.ones(n, bool)
                new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(new & inside(sizes, K, n))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(a[at])), pa.array(ids[start + row[at]])], ["hash", "doc_id"])

    return map_batches(docs.select("doc_id", "text"), run, "hash bigint, doc_id bigint")


def _edges(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """u and v (64 bits of a window's first and last K - 1 words), doc_id and place (of its first word) of the windows that may be repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # a bitmap of fixed size

    def run(batches):
        import pyarrow as pa

        hashes, bits = WordHashes(), shared.value
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start, sizes, h in texts_hashed(batch.column(2), hashes):
                n = len(h) - K + 1
                if n <= 0:
                    continue
                at = np.flatnonzero(meets(_anchors(h), bits) & inside(sizes, K, n))
                if not len(at):
                    continue
                nodes, row, first = runs(h, K - 1), np.repeat(np.arange(len(sizes)), sizes)[at], np.cumsum(sizes) - sizes
                place = parts[start + row] << PART | (at - first[row])
                yield pa.RecordBatch.from_arrays([pa.array(_signed(nodes[at])), pa.array(_signed(nodes[at + 1])), pa.array(ids[start + row]), pa.array(place)], ["u", "v", "doc_id", "place"])

    return map_batches(docs.select("doc_id", "part", "text"), run, "u bigint, v bigint, doc_id bigint, place bigint")


def repeated_edges(edges: DataFrame) -> DataFrame:
    """u, v, from_doc and from_place (its place in the smallest doc_id that has it) of the edges that several documents have."""
    sources = edges.groupBy("u", "v").agg(F.min("doc_id").alias("from_doc"), F.min_by("place", "doc_id").alias("from_place"), F.max("doc_id").alias("last"))
    return sources.where(F.col("from_doc") < F.col("last")).drop("last")


def _highest(x: Column) -> Column:
    """The place of the highest bit of a long other than 0."""
    return F.length(F.bin(x)) - 1


def compacted(graph: DataFrame) -> DataFrame:
    """`graph` (u, v, from_doc, from_place) with head: the place of the first edge of the edge's path.

    A node with one edge in and one out joins them if the second follows the first in the source. As joined edges have neighbouring places, BLOCK of them are first
    folded into the bits of a number, which tells heads within a block. Blocks that are joined throughout point to the block before; these pointers double in each
    round of joins until all have left such blocks.
    """
    n = lambda c: F.lit(c).cast("int")
    no = F.lit(None).cast("bigint")
    ends = graph.select(F.col("v").alias("node"), n(1).alias("into"), n(0).alias("out"), F.col("from_doc").alias("in_doc"), F.col("from_place").alias("in_place"), no.alias("out_doc"), no.alias("out_place"))
    ends = ends.union(graph.select("u", n(0), n(1), no, no, "from_doc", "from_place"))
    nodes = ends.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("into", "out")), *(F.max(c).alias(c) for c in ("in_doc", "in_place", "out_doc", "out_place")))
    joined = nodes.where("into = 1 AND out = 1 AND in_doc = out_doc AND in_place + 1 = out_place")
    block, bit = (lambda c: F.floor(F.col(c) / BLOCK).cast("bigint")), (lambda c: F.pmod(F.col(c), F.lit(BLOCK)).cast("int"))
    one = F.expr(f"shiftleft(1L, int(pmod(out_place, {BLOCK})))")
    blocks = cut(joined.groupBy(F.col("out_doc").alias("from_doc"), block("out_place").alias("block")).agg(F.bit_or(one).alias("mask")))

    # what the last edge of a block is joined to: a head in the block, or, if the block is joined throughout, what the last edge of an earlier one is
    last = F.col("block") * BLOCK + F.coalesce(F.when(F.col("mask") != -1, _highest(F.bitwise_not("mask"))), F.lit(0))
    full = blocks.where("mask = -1").select("from_doc", "block", (F.col("block") - 1).alias("to"))
    ended = None
    while not full.isEmpty():
        full = cut(full)
        step = full.select("from_doc", F.col("block").alias("to"), F.col("to").alias("then"))
        met = cut(full.join(step.hint("merge"), ["from_doc", "to"], "left"))
        out = met.where("then IS NULL").select("from_doc", "block", "to")
        ended, full = out if ended is None else ended.union(out), met.where("then IS NOT NULL").select("from_doc", "block", F.col("then").alias("to"))
        if ended is not None:  # pointers to blocks that have ended go where those went
            known = cut(ended).select("from_doc", F.col("block").alias("to"), F.col("to").alias("went"))
            full = full.join(known.hint("merge"), ["from_doc", "to"], "left").select("from_doc", "block", F.coalesce("went", "to").alias("to"))
    heads = blocks.where("mask <> -1").select("from_doc", "block", last.alias("last"))
    if ended is not None:
        to = heads.withColumnRenamed("block", "to")
        heads = heads.union(ended.join(to.hint("merge"), ["from_doc", "to"], "left").select("from_doc", "block", F.coalesce("last", F.col("to") * BLOCK + BLOCK - 1)))
    before = heads.select("from_doc", (F.col("block") + 1).alias("block"), "last")
    known = cut(blocks.join(before.hint("merge"), ["from_doc", "block"], "left").select("from_doc", "block", "mask", F.coalesce("last", F.col("block") * BLOCK - 1).alias("carried")))
    edges = graph.withColumn("block", block("from_place")).join(known.hint("merge"), ["from_doc", "block"], "left")
    zeros = F.bitwise_not(F.coalesce("mask", F.lit(0))).bitwiseAND(F.expr(f"shiftrightunsigned(-1L, int({BLOCK - 1} - pmod(from_place, {BLOCK})))"))
    head = F.when(zeros != 0, F.col("block") * BLOCK + _highest(zeros)).otherwise(F.col("carried"))
    return edges.select("u", "v", "from_doc", "from_place", head.cast("bigint").alias("head"))


def path_runs(edges: DataFrame) -> DataFrame:
    """Runs of compacted paths: doc_id, place, n (edges), from_doc, from_place; the source is a place in a smaller doc_id."""
    graph = cut(repeated_edges(edges))
    heads = cut(compacted(graph))
    met = edges.join(heads.hint("merge"), ["u", "v"]).where(F.col("doc_id") > F.col("from_doc"))
    along = Window.partitionBy("doc_id", "from_doc", "head", "shift").orderBy("place")
    step = met.select("doc_id", "place", "from_doc", "head", (F.col("from_place") - F.col("place")).alias("shift"))
    run = step.withColumn("run", F.col("place") - F.dense_rank().over(along))  # repeated rows have one rank
    made = run.groupBy("doc_id", "from_doc", "head", "shift", "run").agg(F.min("place").alias("place"), (F.max("place") - F.min("place") + 1).cast("int").alias("n"))
    return made.select("doc_id", "place", "n", "from_doc", (F.col("place") + F.col("shift")).alias("from_place"))


def _digests(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, place, n and digest (of the words there) for `wanted` (doc_id, place, n). Only texts of its documents are moved, SPANS places at a time."""
    part = F.shiftright("place", PART).cast("bigint")
    each = wanted.distinct().withColumn("part", part)
    some = F.floor((F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("place", "n")) - 1) / SPANS)
    lists = cut(each.withColumn("some", some).groupBy("doc_id", "part", "some").agg(F.collect_list(F.struct("place", "n")).alias("spans")))
    ids = lists.select("doc_id").distinct()
    texts = docs.join(sized(cut(ids)), "doc_id", "left_semi").dropDuplicates(["doc_id", "part"]).join(lists.hint("merge"), ["doc_id", "part"])

    def work():
        def each(doc_id, text, spans):
            w = _words(text)
            for s in spans:
                at = s["place"] & ((1 << PART) - 1)
                yield doc_id, s["place"], s["n"], xxhash.xxh3_128_digest(b" ".join(w[at : at + s["n"] + K - 1]))

        return each

    return map_rows(texts.select("doc_id", "text", "spans"), work, "doc_id bigint, place bigint, n int, digest binary")


def with_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` (doc_id, text) with part, and doc_id and part of the rows whose text equals that of a smaller doc_id.

    part numbers the different texts of one doc_id from 0; nearly always there is one. All windows of a copied text are repeated, and none is a source.
    """
    key = F.unhex(F.md5("text"))
    keyed = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", key.alias("key"))
    first = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last"))
    several = cut(keyed.groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("doc_id"))
    copies = keyed.join(first.hint("merge"), "key").where(F.col("doc_id") > F.col("first")).select("doc_id", "key").distinct()
    n = several.count()
    if not n:
        return docs.withColumn("part", F.lit(0).cast("bigint")), copies.select("doc_id", F.lit(0).cast("bigint").alias("part"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("key")).cast("bigint")
    parts = cut(keyed.join(sized(several, n), "doc_id", "left_semi").distinct().withColumn("part", number))
    known = sized(parts)
    numbered = docs.withColumn("key", key).join(known, ["doc_id", "key"], "left").withColumn("part", F.coalesce("part", F.lit(0))).select("doc_id", "text", "part")
    return numbered, copies.join(known, ["doc_id", "key"], "left").select("doc_id", F.coalesce("part", F.lit(0)).alias("part"))


def _repeated_runs(docs: DataFrame) -> DataFrame:
    """Verified runs of repeated paths in `docs` (doc_id, part, text)."""
    docs = docs.where(F.col("doc_id").isNotNull())
    edges = cut(_edges(docs, repeated(_sampled(docs))))
    found = cut(path_runs(edges))
    here = _digests(docs, found.select("doc_id", "place", "n"))
    there = _digests(docs, found.select(F.col("from_doc").alias("doc_id"), F.col("from_place").alias("place"), "n"))
    met = found.join(here.hint("merge"), ["doc_id", "place", "n"])
    there = there.select(F.col("doc_id").alias("from_doc"), F.col("place").alias("from_place"), "n", F.col("digest").alias("source"))
    return met.join(there.hint("merge"), ["from_doc", "from_place", "n"]).where("digest = source").drop("digest", "source")


def repeated_paths(docs: DataFrame) -> DataFrame:
    """Verified runs of repeated paths for `docs` (doc_id, text): doc_id, start (word), n (windows), from_doc, from_at.

    A run covers n + K - 1 words of the document that also stand in from_doc, a smaller doc_id, from word from_at on. Every window of a document whose words also
    start in a document with a smaller doc_id is in one, unless the whole text equals that of a smaller doc_id. Rows with a null doc_id take no part. Where a doc_id has several
    texts, start and from_at are words of one of them.
    """
    docs, copies = with_parts(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    word = lambda c: F.col(c).bitwiseAND(F.lit((1 << PART) - 1)).cast("int")
    found = _repeated_runs(docs.join(sized(cut(copies)), ["doc_id", "part"], "left_anti"))
    return found.select("doc_id", word("place").alias("start"), "n", "from_doc", word("from_place").alias("from_at"))


def remove_repeats(docs: DataFrame, keep: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed (long), kept_sha256 and kept (the words left, joined by spaces) for each row of `docs` (doc_id, text).

    A word goes if a window of K words that covers it also starts in a document with a smaller doc_id, judged on the input. A null text has no words;
    texts of fewer than K words lose none. A row with a null doc_id loses none and takes none away. Repeated rows are treated alike, and texts of one doc_id take nothing
    from each other; an empty table gives an empty result; other columns are not read. With `keep` false, kept is null.
    """
    docs, copies = with_parts(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    copies = cut(copies)
    found = _repeated_runs(docs.join(sized(copies), ["doc_id", "part"], "left_anti"))
    start = F.col("place").bitwiseAND(F.lit((1 << PART) - 1)).cast("int").alias("start")
    spans = found.select("doc_id", F.shiftright("place", PART).cast("bigint").alias("part"), start, "n").groupBy("doc_id", "part").agg(F.collect_set(F.struct("start", "n")).alias("spans"))  # of one text
    spans = cut(spans.union(copies.select("doc_id", "part", F.expr("array(struct(0 AS start, 2000000000 AS n))"))))
    count = spans.count()
    # documents that lose words are few or many: their ids alone decide which texts move
    names = ["doc_id", "part"]
    some, ids = docs.join(sized(spans.select(*names), count), names, "left_semi").join(spans.hint("merge"), names), spans.select(*names)
    rest = docs.join(sized(ids, count), names, "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))

    def work():
        def each(doc_id, text, spans):
            w = _words(text)
            n = len(w)
            if spans and n >= K:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, [s["start"] for s in spans], 1)
                np.add.at(edge, [min(n, s["start"] + s["n"] + K - 1) for s in spans], -1)
                w = [w[i] for i in np.flatnonzero(np.cumsum(edge)[:n] == 0)]
            kept = b" ".join(w)
            yield doc_id, n, n - len(w), hashlib.sha256(kept).hexdigest(), kept.decode() if keep else None

        return each

    return map_rows(rest.select("doc_id", "text", "spans").union(some.select("doc_id", "text", "spans")), work, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_removed, kept_sha256, by remove_repeats(); nulls, ties and repeats as there."""
    return remove_repeats(read(spark, sf_dir, "documents"), keep=False).drop("kept")


OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), e AS (
  SELECT rid, doc_id, i, array_to_string(ws[i:i+{K - 1}], ' ') AS g FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - {K - 2})) AS i FROM d WHERE len(ws) >= {K})
), m AS (SELECT rid, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS again FROM e
), c AS (SELECT DISTINCT rid, i + j AS p FROM m, range({K}) t(j) WHERE again
), w AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d
), k AS (
  SELECT w.rid, count(c.p) AS gone, string_agg(w.w, ' ' ORDER BY w.p) FILTER (WHERE c.p IS NULL) AS kept FROM w LEFT JOIN c ON c.rid = w.rid AND c.p = w.p GROUP BY w.rid
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
