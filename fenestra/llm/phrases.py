"""Phrase collocations from sorted suffixes.

A suffix is the words from one place of a piece on, four at most: no longer phrase is counted. Tasks turn texts into suffixes, add equal ones
up, and Spark deals them out by ranges of their leading words. In its range, a task sorts pointers to suffixes by multikey three-way quicksort: one word
decides at a time, those with an equal word go on to the next one, and the size of such an equal partition is the count of the phrase that its words spell.
A partition of fewer occurrences than a candidate needs is abandoned, unsorted, since no phrase in it can have enough; only those that hold a task's
first or last suffix may go on in a neighbouring range, so these hand on what they have, and the parts are added.

Ranges cut through the most frequent leading words, so none of them fills a task. Before that, suffixes end where a word is too rare for any
candidate, by a bitmap of the words that aren't: false hits cost work, never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.llm.batches import map_batches
from fenestra.llm.common import cut, read
from fenestra.llm.shingles import bitmap, meets

#: Words of a phrase at most; occurrences at least; the share (in percent) of a phrase that a longer one must have to stand for it; phrases of a language.
LONGEST, LEAST, COVERED, TOP = 4, 30, 80, 2_000
#: Bytes of text that make a chunk, suffixes that a range has, about.
CHUNK, RANGE_ROWS = 4_000_000, 1_000_000
#: Parts of a language whose best phrases are found first.
DEALT = 64

#: A byte that no UTF-8 text has stands for all that ends a piece.
BREAK = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)
#: Words never hold a space, so it can change places with the least byte: then the suffixes that a phrase begins stand side by side in the order of bytes.
_SWAP, _END = bytes.maketrans(b"\0 ", b" \0"), b"\0"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """For chunks of one language's texts: the language, codes of words and breaks in order, and what the codes stand for."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def coded(lang: str):
        sizes.pop(lang)
        joined = BREAK.join(held.pop(lang)).replace(BREAK, b" " + BREAK + b" ")
        every = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").values.dictionary_encode()
        codes, known = every.indices.to_numpy(), every.dictionary.cast(pa.binary())
        empty = pc.index(known, pa.scalar(b"", pa.binary())).as_py()
        if empty >= 0:  # between two spaces
            codes = codes[codes != empty]
        return lang, codes, known

    for batch in batches:
        for lang, text in zip(*batch.columns):
            text, lang, at = (text.as_py() or b"").translate(_FOLD), lang.as_py(), 0
            while at < len(text):
                end = len(text) if len(text) - at <= CHUNK else text.find(BREAK, at + CHUNK)  # a long text is cut where a piece ends
                end = len(text) if end < 0 else end
                held.setdefault(lang, []).append(text[at:end])
                sizes[lang] = sizes.get(lang, 0) + end - at
                at = end + 1
                if sizes[lang] >= CHUNK or sum(sizes.values()) >= 4 * CHUNK:
                    yield coded(max(sizes, key=sizes.get))
    for lang in list(held):
        yield coded(lang)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f (long): all occurrences of every word."""

    def run(batches):
        for lang, codes, known in _chunks(batches):
            f = np.bincount(codes, minlength=len(known))
            kept = np.flatnonzero((f > 0) & np.array(pc.not_equal(known, pa.scalar(BREAK, pa.binary()))))
            for k in range(0, len(kept), 50_000):
                part = kept[k : k + 50_000]
                yield pa.record_batch([pa.array([lang] * len(part), pa.string()), known.take(pa.array(part)).cast(pa.string()), pa.array(f[part], pa.int64())], ["lang", "word", "f"])

    return map_batches(_texts(docs), run, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def suffixes(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """lang, suffix (binary), f: suffixes of two to LONGEST words of `frequent` (lang, word), one row for each chunk of texts that has one."""
    cells = docs.sparkSession.sparkContext.broadcast(bitmap(frequent.select(F.xxhash64("lang", "word").alias("hash"))))  # of a fixed size

    def run(batches):
        for lang, codes, known in _chunks(batches):
            seed = xxhash.xxh64_intdigest(lang.encode(), 42)
            words = known.to_pylist()
            ok = meets(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)), cells.value) & np.array([w != BREAK for w in words], bool)
            kept = sorted(np.flatnonzero(ok).tolist(), key=words.__getitem__)  # so that suffixes come in the order of their bytes, which compresses well
            place = np.zeros(len(words), np.int64)
            place[kept] = np.arange(1, len(kept) + 1)
            kept = pa.array([words[i].translate(_SWAP) for i in kept], pa.binary())
            for columns, f in _equal_added(place[codes], int(ok.sum()) + 1):
                taken = [kept.take(pa.array(c - 1, mask=c == 0)) for c in columns]
                rows = pc.binary_join_element_wise(*taken, pa.scalar(_END, pa.binary()), null_handling="skip")
                yield pa.record_batch([pa.array([lang] * len(f), pa.string()), rows, pa.array(f, pa.int64())], ["lang", "suffix", "f"])

    return map_batches(_texts(docs), run, "lang string, suffix binary, f bigint")


def _equal_added(code: np.ndarray, n: int, rows: int = 100_000):
    """Distinct runs of two to LONGEST nonzero codes below n, as columns (0: ended), with how often each is the longest at a place; `rows` at a time."""
    padded = np.concatenate([code, np.zeros(LONGEST - 1, code.dtype)]).astype(np.uint64)
    at = np.flatnonzero((padded[:-1] > 0) & (padded[1:] > 0))
    key, alive, bits = padded[at], np.ones(len(at), bool), max(1, int(n).bit_length())
    columns = [key]
    for k in range(1, LONGEST):
        alive = alive & (padded[at + k] > 0)
        columns.append(np.where(alive, padded[at + k], 0))
    if bits * LONGEST <= 64:
        for c in columns[1:]:
            key = key << np.uint64(bits) | c
        key, f = np.unique(key, return_counts=True)
        columns = [key >> np.uint64(bits * (LONGEST - 1 - k)) & np.uint64((1 << bits) - 1) for k in range(LONGEST)]
    else:
        whole, f = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        columns = list(whole.T)
    for k in range(0, len(f), rows):
        yield [c[k : k + rows].astype(np.int64) for c in columns], f[k : k + rows]


def quicksort(columns: list[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Sort pointers to rows by one column after the other (-1: none) and yield, for partitions of equal rows, a row, columns compared, and weight.

    Partitions of less weight than `least` are abandoned, but for those with the first or last row in order: they may go on outside.
    """
    m = len(weights)
    pointer, todo = np.arange(m), [(0, m, 0)] if m else []
    while todo:
        lo, hi, depth = todo.pop()
        part = pointer[lo:hi]
        value = columns[depth][part]
        pivot = np.partition(sample := value[:: -(-len(value) // 9)], len(sample) // 2)[len(sample) // 2] if len(value) > 1000 else value[len(value) // 2]
        below, same = value < pivot, value == pivot
        begin = lo
        for side, rows in ((-1, part[below]), (0, part[same]), (1, part[~(below | same)])):
            end = begin + len(rows)
            if end > begin:
                pointer[begin:end] = rows
                total = int(np.add.reduce(weights[rows]))
                if total >= least or begin == 0 or end == m:
                    if side:
                        todo.append((begin, end, depth))
                    elif pivot >= 0:
                        yield int(rows[0]), depth + 1, total
                        if depth + 1 < len(columns):
                            todo.append((begin, end, depth + 1))
            begin = end


def phrase_counts(suffixed: DataFrame, rows: int, least: int = LEAST) -> DataFrame:
    """lang, phrase, f of all phrases of two to LONGEST words with `least` occurrences, from suffixes of which there are `rows`."""
    spark = suffixed.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["lang", "suffix"]).aggregate([("f", "sum")]).rename_columns(["lang", "suffix", "f"]).combine_chunks()

    def run(batches):
        held, fresh, whole = [], 0, None
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            fresh += batch.num_rows
            if fresh >= RANGE_ROWS:  # many chunks have the same suffix: their rows become one
                held, fresh = [added(held)], 0
        if not held:
            return
        whole = added(held)
        lang = whole["lang"].combine_chunks()
        suffix = whole["suffix"].combine_chunks()
        weights = whole["f"].to_numpy()
        split = pc.split_pattern(suffix, _END)
        words = split.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        rank = np.empty(len(names), np.int64)
        rank[np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)] = np.arange(len(names))
        code, starts = rank[words.indices.to_numpy()], split.offsets.to_numpy()
        starts, sizes = starts[:-1] - starts[0], np.diff(starts)
        every = lang.dictionary_encode()
        langs = every.dictionary.to_pylist()
        order = np.empty(len(langs), np.int64)
        order[np.array(sorted(range(len(langs)), key=lambda k: langs[k].encode()))] = np.arange(len(langs))
        columns = [order[every.indices.to_numpy()].astype(np.int32)]
        for k in range(LONGEST):
            columns.append(np.where(sizes > k, code[np.minimum(starts + k, len(code) - 1)], -1).astype(np.int32))
        out = []
        for row, depth, f in quicksort(columns, weights, least):
            if depth > 2:  # the language and two words
                out.append((lang[row].as_py(), b" ".join(w.translate(_SWAP) for w in suffix[row].as_py().split(_END)[: depth - 1]).decode(), f))
        for k in range(0, len(out), 10_000):
            a, b, c = zip(*out[k : k + 10_000])
            yield pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], ["lang", "phrase", "f"])

    routed = suffixed.repartitionByRange(parts, "lang", "suffix")
    return map_batches(routed, run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every candidate, cut where it scores lowest; a candidate's parts are frequent themselves."""
    f = words.select("lang", F.col("word").alias("part"), "f").unionByName(phrases.select("lang", F.col("phrase").alias("part"), "f"))
    split = F.split("phrase", " ")
    cuts = (
        phrases.select("lang", "phrase", F.col("f").alias("a"), split.alias("ws"), F.explode(F.sequence(F.lit(1), F.size(split) - 1)).alias("k"))
        .select("lang", "phrase", "a", "k", F.array_join(F.slice("ws", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")), " ").alias("rest"))
    )
    met = cuts.join(f.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(f.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    return met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def covered(phrases: DataFrame) -> DataFrame:
    """lang, phrase, most: what the most frequent longer candidate has, for all phrases of two words or more that lie in one."""
    inner = F.expr(
        "flatten(transform(sequence(2, size(ws) - 1), n -> transform(sequence(1, size(ws) - n + 1), i -> array_join(slice(ws, i, n), ' '))))"
    )
    longer = phrases.select("lang", "f", F.split("phrase", " ").alias("ws")).where(F.size("ws") > 2)
    return longer.select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, covered_percent: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score (long): the `top` phrases of each language of `docs` (lang, text).

    A null language is `und`. Null, empty and blank texts have no words; repeated rows count again; other columns are not read, and an empty table gives no rows. Ties in score go to the more frequent phrase,
    then to the lesser one in the order of UTF-8 bytes. Counts are exact.
    """
    counts = cut(word_counts(docs))
    frequent = counts.where(F.col("f") >= least)
    suffixed = cut(suffixes(docs, frequent))
    phrases = cut(phrase_counts(suffixed, suffixed.count(), least))
    hidden = covered(phrases).where(F.col("most").isNotNull())
    kept = (
        scored(phrases, frequent).join(hidden, ["lang", "phrase"], "left")
        .where(F.col("most").isNull() | (F.col("most").cast("decimal(22,0)") * 100 < F.col("a").cast("decimal(22,0)") * covered_percent))
    )
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    for key in (["lang", F.pmod(F.hash("phrase"), F.lit(DEALT))], ["lang"]):  # a language's last task gets DEALT times `top` rows at most
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= top)
    n = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    return kept.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language of documents, by collocations()."""
    return collocations(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, piece AS body
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)
),
split AS (SELECT lang, list_filter(regexp_split_to_array(body, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
f AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)
  GROUP BY ALL
),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
met AS (
  SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1 : cut], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[cut + 1 : cuts.k], ' ')
),
lowest AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda s: list_transform(range(1, k - s + 2), lambda i: array_to_string(ws[i : i + s - 1], ' '))))) AS phrase FROM c WHERE k > 2)
  GROUP BY ALL
),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000
"""
