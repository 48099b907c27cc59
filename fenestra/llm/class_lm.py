"""Language-model scoring by a Brown class-based bigram model.

Words are assigned to classes by exchange: a unit moves to the class in which the class transitions of the corpus gain most likelihood, pass
after pass. A text's probability is the product, over its words and one end, of the class transition and the word's emission.

Texts are split into words once. Each task writes chunks: the words of some texts as numbers into the chunk's own dictionary. The dictionaries alone
make the corpus's word counts, and get every word's count and unit back by a join; after that a text is a row of unit numbers, and counting
contexts and scoring are array operations on these.

The most frequent words are units of their own, all others belong to units by spelling (length, characters, ending), so the tables of units and
classes have a fixed size. Word counts, and what they say about each word in its unit, are exact for all words of the corpus; words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fenestra.llm.batches import map_batches
from fenestra.llm.common import cut, read
from fenestra.llm.shingles import WordHashes

#: Units that are words of their own, with the end; units by spelling, for all other words.
OWN_UNITS, SPELLINGS = 8_192, 1_024
UNITS = OWN_UNITS + SPELLINGS
#: Classes; passes of the exchange; the most frequent units, whose moves the others among them see at once.
CLASSES, PASSES, LIVE = 64, 10, 1_024
#: Sets of units that move unaware of each other in early passes.
PARTS = 12
#: Blocks of units in which the tables of tasks are added up.
BLOCKS = 16
#: A chunk is closed after so many tokens.
CHUNK = 3_000_000
#: Weight of the class unigram in a transition, and of a unit without count in an emission.
ALPHA, BETA = 20.0, 0.1
#: The end of a text, as a word; no word is empty. Its unit is 0, and its class, which no other unit has, is 0.
END = b""
MEMO, MEMO_BYTES = 300_000, 64


def tokens(text: bytes | None) -> list[bytes]:
    """Words, A-Z lower-cased, then the end."""
    return [*(text or b"").lower().split(), END]  # bytes.split(): at ASCII white space


def spelling(word: bytes) -> int:
    """The unit of a word by its spelling, counted from 0."""
    kind = bytes([min(len(word), 12) // 3, any(48 <= c < 58 for c in word), word[-1:].isalnum() or word[-1:] >= b"\x80"])
    return zlib.crc32(kind + word[-3:]) % SPELLINGS


class _Spellings(dict):
    def __missing__(self, word: bytes) -> int:
        s = spelling(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = s
        return s


def trains(doc_id: Column) -> Column:
    """Documents to learn from: crc32 of doc_id as text leaves another remainder by 7 than 2. A null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


_CHUNK_SCHEMA = "chunk bigint, doc_ids array<bigint>, learn array<boolean>, sizes array<int>, at binary, words array<bigint>, spelled array<int>, counts array<bigint>"
#: The place of a unit in a number that also has a word's place in its chunk.
UNIT_BITS = 14


def chunked(docs: DataFrame, learn: Column) -> DataFrame:
    """Chunks of `docs` (doc_id, text): for some texts, what their words are in the chunk's dictionary, and how often texts to `learn` from have each.

    A null text is an empty one and has its end only.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("at", pa.binary()), ("words", pa.list_(pa.int64())), ("spelled", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
        spellings, hashes, task, made = _Spellings(), WordHashes(), TaskContext.get().partitionId(), 0

        def fresh():
            local: defaultdict[bytes, int] = defaultdict()
            local.default_factory = local.__len__
            return local, [], [], []

        def row():
            sizes = [len(a) for a in at]
            n = np.bincount(np.concatenate([a for a, l in zip(at, learned) if l] or [np.zeros(0, np.int32)]), minlength=len(local))
            spelled = np.fromiter(map(spellings.__getitem__, local), np.int32, len(local))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((task << 32 | made, ids, learned, sizes, np.concatenate(at).tobytes(), hashes.of(local).view(np.int64), spelled, n), schema)], schema=schema)

        local, ids, learned, at = fresh()
        waiting = 0
        for batch in batches:
            for doc_id, learns, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = tokens(text.as_py())
                at.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                learned.append(learns)
                waiting += len(words)
                if waiting >= CHUNK:
                    yield row()
                    made += 1
                    local, ids, learned, at = fresh()
                    waiting = 0
        if ids:
            yield row()

    return map_batches(docs.select("doc_id", learn.alias("learn"), F.col("text").cast("binary").alias("text")), run, _CHUNK_SCHEMA)


def _hash(word: bytes) -> int:
    return int(WordHashes().of([word]).view(np.int64)[0])


@dataclass
class Vocabulary:
    """Counts of a corpus: `lexicon` (word, a hash; n; unit) has all its words; tables by unit have a fixed size."""

    lexicon: DataFrame
    n: int
    v: int
    tokens: np.ndarray  # in a unit
    kinds: np.ndarray  # distinct words in a unit
    discount: float

    @property
    def unseen(self) -> np.ndarray:
        """What a spelling unit leaves to unknown words, times its tokens. A unit never seen leaves all."""
        return np.where(self.tokens > 0, self.discount * self.kinds, 1.0)


def vocabulary(chunks: DataFrame) -> Vocabulary:
    """The words of the texts to learn from. The most frequent ones, by count and then by hash, are units of their own."""
    each = chunks.select(F.explode(F.arrays_zip("words", "counts", "spelled")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("n"), F.col("w.spelled").alias("spelled"))
    counts = cut(each.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"), F.first("spelled").alias("spelled")))
    end = F.col("word") == _hash(END)
    top = counts.where(~end).orderBy(F.desc("n"), "word").limit(OWN_UNITS - 1)
    own = top.select("word", F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("own"))
    known = counts.join(F.broadcast(cut(own)), "word", "left")  # OWN_UNITS rows at most
    unit = F.when(end, 0).otherwise(F.coalesce("own", F.lit(OWN_UNITS) + F.col("spelled")))
    lexicon = cut(known.select("word", "n", unit.cast("int").alias("unit")))
    once, twice = (F.sum((F.col("n") == k).cast("bigint")).alias(name) for k, name in ((1, "once"), (2, "twice")))
    n, kinds, once_, twice_ = np.zeros(UNITS), np.zeros(UNITS), 0, 0
    for r in lexicon.groupBy("unit").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), once, twice).collect():  # UNITS rows at most
        n[r["unit"]], kinds[r["unit"]] = r["n"], r["kinds"]
        once_, twice_ = once_ + r["once"], twice_ + r["twice"]
    discount = min(0.9, max(0.1, once_ / (once_ + 2 * twice_) if once_ else 0.5))
    return Vocabulary(lexicon, int(n.sum()), int(kinds.sum()), n, kinds, discount)


def coded(chunks: DataFrame, known: Vocabulary) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, base_score, fixed (the part of the score that classes don't touch) and units (2 bytes a token) for each text.

    Each chunk's dictionary gets counts and units by a join over words; a word of the corpus comes once a chunk, however often texts have it.
    """
    entry = F.posexplode(F.arrays_zip("words", "spelled")).alias("i", "w")
    here = lambda unit: F.shiftleft(F.col("i").cast("bigint"), UNIT_BITS).bitwiseOR(unit.cast("bigint"))
    words = chunks.select("chunk", entry).select("chunk", F.col("w.words").alias("word"), here(F.col("w.spelled")).alias("at"))
    met = words.join(known.lexicon.hint("merge"), "word", "left")
    low = F.lit((1 << UNIT_BITS) - 1)
    unit = F.coalesce("unit", F.when(F.col("word") == _hash(END), 0).otherwise(F.lit(OWN_UNITS) + F.col("at").bitwiseAND(low)))
    packed = (F.col("at") - F.col("at").bitwiseAND(low) + unit).alias("of")
    lists = met.select("chunk", packed, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).groupBy("chunk").agg(F.collect_list("of").alias("of"), F.collect_list("n").alias("n"))  # a chunk's dictionary
    both = chunks.select("chunk", "doc_ids", "learn", "sizes", "at").join(lists.hint("merge"), "chunk").select("doc_ids", "learn", "sizes", "at", "of", "n")
    tables = (known.n, known.v, known.tokens, known.unseen, known.discount)

    def run(batches):
        import pyarrow as pa

        n_all, v, in_unit, unseen, discount = tables
        names = ["doc_id", "learn", "n_tokens", "n_known", "base_score", "fixed", "units"]
        for batch in batches:
            for k in range(batch.num_rows):
                ids, learn, sizes, at, of, n = (c[k] for c in batch.columns)
                of = of.values.to_numpy()
                order = of >> UNIT_BITS
                units, counts = np.zeros(len(order), np.int16), np.zeros(len(order), np.int64)
                units[order], counts[order] = of & ((1 << UNIT_BITS) - 1), n.values.to_numpy()
                # by word of the dictionary, then by token
                base = np.log10((counts + 1) / (n_all + v + 1))
                fixed = np.zeros(len(order))
                s = units >= OWN_UNITS
                fixed[s] = np.log10(np.where(counts[s] > 0, counts[s] - discount, unseen[units[s]])) - np.log10(np.maximum(in_unit[units[s]], 1))
                at = np.frombuffer(at.as_py(), np.int32)
                sizes = sizes.values.to_numpy().astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                total = lambda x: np.add.reduceat(x[at], starts)  # noqa: B023, E731  each text has its end at least
                bytes_ = units[at].astype("<i2").tobytes()
                offsets = np.concatenate([[0], np.cumsum(sizes) * 2]).astype(np.int64)
                codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids.values, learn.values, pa.array(sizes), pa.array(total((counts > 0).astype(np.int64))), pa.array(total(base)), pa.array(total(fixed)), codes], names)

    return map_batches(both, run, "doc_id bigint, learn boolean, n_tokens bigint, n_known bigint, base_score double, fixed double, units binary")


def _units_of(batch) -> np.ndarray:
    """All units of a batch in one array; every text ends with unit 0, which is also what comes before a text's first word."""
    column = batch.column(batch.num_columns - 1)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.int8)[ends[0] : ends[-1]].view("<i2")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _added(texts: DataFrame, count, rows: int, width: int) -> np.ndarray:
    """The sum, over all `texts` (units), of the tables (rows, width) that `count(before, units)` makes of their units and what stands before them.

    Tasks count into a table of a fixed size; these are added up in blocks of rows. Sums of whole numbers, so neither order nor partitioning matters.
    """

    def pack(part: np.ndarray) -> bytes:
        return zlib.compress(part.astype("<u4").tobytes() + (part >> 32).astype("<u4").tobytes(), 1)

    def unpack(cells: bytes) -> np.ndarray:
        low, high = np.frombuffer(zlib.decompress(cells), "<u4").reshape(2, -1).astype(np.int64)
        return low + (high << 32)

    def run(batches):
        import pyarrow as pa

        table = np.zeros((rows, width), np.int64)
        for batch in batches:
            u = _units_of(batch).astype(np.int32)
            if len(u):
                table += count(np.concatenate([np.zeros(1, np.int32), u[:-1]]), u)
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([pack(part) for part in np.split(table, BLOCKS)], pa.binary())], ["block", "cells"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "cells": [pack(sum(map(unpack, pdf["cells"])))]})

    parts = map_batches(texts.select("units"), run, "block int, cells binary").withColumn("some", F.floor(F.spark_partition_id() / 256))
    once = parts.groupBy("block", "some").applyInPandas(lambda pdf: add(pdf), "block int, cells binary")
    out = np.zeros((BLOCKS, rows * width // BLOCKS), np.int64)
    for r in once.groupBy("block").applyInPandas(lambda pdf: add(pdf), "block int, cells binary").collect():  # BLOCKS rows of a fixed size
        out[r["block"]] = unpack(r["cells"])
    return out.reshape(rows, width)


def contexts(texts: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often a class comes before each unit, how often after it, and how often the unit after itself, by `classes` of all units."""
    state = texts.sparkSession.sparkContext.broadcast(classes.astype(np.int32))

    def count(first: np.ndarray, u: np.ndarray) -> np.ndarray:
        cls = state.value
        sides = [np.bincount(a * CLASSES + cls[b], minlength=UNITS * CLASSES).reshape(UNITS, CLASSES) for a, b in ((u, first), (first, u))]
        return np.hstack([*sides, np.bincount(u[u == first], minlength=UNITS)[:, None]])

    found = _added(texts, count, UNITS, 2 * CLASSES + 1)
    return found[:, :CLASSES], found[:, CLASSES:-1], found[:, -1]


def neighbours(texts: DataFrame) -> np.ndarray:
    """How often each of the first LIVE units comes before each of them."""

    def count(first: np.ndarray, u: np.ndarray) -> np.ndarray:
        both = (first < LIVE) & (u < LIVE)
        return np.bincount(first[both] * LIVE + u[both], minlength=LIVE * LIVE).reshape(LIVE, LIVE)

    return _added(texts, count, LIVE, LIVE)


def likelihood(table: np.ndarray) -> float:
    """What the exchange raises: the log likelihood of class transitions, and of units in their classes but for a constant."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum())


def moved(classes: np.ndarray, before: np.ndarray, after: np.ndarray, itself: np.ndarray, pairs: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Classes after the `chosen` units have moved in order of their numbers, each to the class that gains most.

    Transitions of classes follow every move, and so do the contexts of the first LIVE units among themselves, by their `pairs`; other contexts are
    those by `classes`. Only tables of a fixed size are involved.
    """
    cls, t = classes.copy(), np.zeros((CLASSES, CLASSES))
    before, after, pairs = before.astype(np.float64), after.astype(np.float64), pairs.astype(np.float64)
    np.add.at(t, classes, after)
    mass = t.sum(axis=0)
    totals = before.sum(axis=1)
    for unit in np.flatnonzero((totals > 0) & chosen):
        if not unit:
            continue
        own, c, total = float(itself[unit]), int(cls[unit]), float(totals[unit])
        x, y = before[unit].copy(), after[unit].copy()
        x[c] -= own
        y[c] -= own
        t[:, c] -= x
        t[c] -= y
        t[c, c] -= own
        mass[c] -= total
        i, j, d = np.flatnonzero(x), np.flatnonzero(y), t.diagonal()
        into, out = t[i].T, t[:, j]
        gain = (_xlogx(into + x[i]) - _xlogx(into)).sum(axis=1) + (_xlogx(out + y[j]) - _xlogx(out)).sum(axis=1) - 2 * (_xlogx(mass + total) - _xlogx(mass))
        # a class's transition to itself gains from both sides at once
        gain += _xlogx(d + x + y + own) - _xlogx(d + x) - _xlogx(d + y) + _xlogx(d)
        gain[0] = -np.inf
        to = int(gain.argmax())
        t[:, to] += x
        t[to] += y
        t[to, to] += own
        mass[to] += total
        cls[unit] = to
        if unit < LIVE and to != c:
            for side, n in ((after, pairs[:, unit]), (before, pairs[unit])):
                side[:LIVE, c] -= n
                side[:LIVE, to] += n
    return cls


def exchange(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units and the transitions of classes, for `texts` with units; of all passes, those of the highest likelihood.

    A pass counts every unit's contexts by current classes, then moves units. In the first half of passes, PARTS sets of units move from the same state, each unaware of
    the others, which keeps like units from falling into one class early; later all move in turn, of those behind the first LIVE every second one a pass.
    The result depends on counts alone, not on the order or partitioning of rows.
    """
    number = np.arange(UNITS)
    classes = np.where(np.arange(UNITS) == 0, 0, 1 + np.arange(UNITS) % (CLASSES - 1))
    pairs, best = neighbours(texts), None
    for k in range(PASSES + 1):
        before, after, itself = contexts(texts, classes)
        table = np.zeros((CLASSES, CLASSES))
        np.add.at(table, classes, after.astype(np.float64))
        if best is None or likelihood(table) > best[0]:
            best = likelihood(table), classes, table
        if k < PASSES // 2:
            classes = np.choose(number % PARTS, [moved(classes, before, after, itself, pairs, number % PARTS == p) for p in range(PARTS)])
        elif k < PASSES:
            classes = moved(classes, before, after, itself, pairs, (number < LIVE) | (number % 2 == k % 2))
    return best[1], best[2]


@dataclass
class Model:
    """Tables of a fixed size: log10 of the probabilities of class transitions, and of a unit given its class."""

    transition: np.ndarray
    classes: np.ndarray  # of units
    emission: np.ndarray  # of a unit


def train(texts: DataFrame, known: Vocabulary) -> Model:
    """A model of the coded `texts` (units) to learn from. Without any, classes are dealt in turn and transitions are equal."""
    classes, table = exchange(texts)
    into = table.sum(axis=0)
    share = (into + 1) / (into.sum() + CLASSES)
    transition = (table + ALPHA * share) / (table.sum(axis=1, keepdims=True) + ALPHA)
    members = np.bincount(classes, minlength=CLASSES)
    emission = (known.tokens + BETA) / (np.bincount(classes, known.tokens, CLASSES) + BETA * members)[classes]
    return Model(np.log10(transition), classes, np.log10(emission))


def score(texts: DataFrame, model: Model, known: Vocabulary) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score and perplexity (of a token, by the score) for each of the coded `texts`."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches):
        import pyarrow as pa

        m = shared.value
        flat = m.transition.ravel()
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _units_of(batch)
            c = m.classes[u]
            each = flat[np.concatenate([[0], c[:-1]]) * CLASSES + c] + m.emission[u]
            sizes = batch.column(2).to_numpy()
            total = np.add.reduceat(each, np.cumsum(sizes) - sizes) + batch.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(total)], ["doc_id", "learn", "n_tokens", "n_known", "base_score", "score"])

    made = map_batches(texts.select("doc_id", "learn", "n_tokens", "n_known", "base_score", "fixed", "units"), run, "doc_id bigint, learn boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return made.select("doc_id", "learn", "n_tokens", "n_known", F.lit(known.n).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def train_and_score(docs: DataFrame, learn: Column) -> tuple[DataFrame, Model, Vocabulary]:
    """Scores of all `docs` (doc_id, text), each read whole, by a model of those for which `learn` is true; the model and its vocabulary.

    base_score is the add-one unigram's log10 probability, score the class model's. A null text is an empty one: only its end is scored. Repeated
    rows are counted and scored each; an empty table gives no rows; nothing to learn from gives a model that knows no word; other columns are not read. Texts of any length
    are read whole: a very long one is a chunk of its own.
    """
    chunks = cut(chunked(docs, learn))
    known = vocabulary(chunks)
    texts = cut(coded(chunks, known))
    model = train(texts.where("learn").select("units"), known)
    return score(texts, model, known), model, known


def score_with(docs: DataFrame, model: Model, known: Vocabulary) -> DataFrame:
    """Scores of further `docs` (doc_id, text) by a model that others taught."""
    return score(cut(coded(cut(chunked(docs, F.lit(False))), known)), model, known)


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity, by train_and_score().

    A null doc_id is learned from and gives a null doc_id; a null or empty text has one token.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found, _, _ = train_and_score(docs, trains(F.col("doc_id")))
    return found.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
