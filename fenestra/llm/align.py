"""Alignment of the tokens of two vocabularies over one text.

Both tokenizers cut the same bytes; where tokens of both end, a group ends. The vocabularies used here never join what a single space parts from
what is no white space before and after it, so a text falls into units there, every unit is encoded once for all its occurrences in a chunk of
texts, and long texts are encoded in parts, in tasks of their own.

Groups of a long text come from fragments: a range of bytes has the tokens that end in it, up to the first common end (its open prefix), closed groups, and
what follows the last common end (its open suffix). Two neighbours make one fragment: the left one's suffix and the right one's prefix are one group if
both have a common end, else they stay open. That is associative, so fragments are joined sixteen at a time, level by level, by ranges that grow, on as many tasks as there are ranges.

Two tokens are linked if their bytes overlap: every stretch between neighbouring ends of either side is one link. Counts of linked ids are added up by chunks first;
each chunk then looks its own pairs up, the most frequent ones in a broadcast table of fixed size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from fenestra.llm.batches import map_batches, map_rows
from fenestra.llm.bpe import PATTERN, byte_symbols, vocabulary
from fenestra.llm.common import cut, look_up, read, sized

#: Bytes of text that make a chunk; bytes above which a text is encoded in parts of about that size; bytes of a fragment's range; fragments joined at a time.
CHUNK, PART, RANGE, FAN = 8_000_000, 65_536, 16_384, 16
#: Where texts fall into parts: white space as regular expressions know it, of which no other kind may touch the space.
_SAFE = regex.compile(r"(?<=\S) (?=\S)")

_FRAGMENT = "n_a bigint, n_b bigint, closed boolean, groups bigint, body string, pa array<int>, pae array<bigint>, pb array<int>, pbe array<bigint>, sa array<int>, sae array<bigint>, sb array<int>, sbe array<bigint>"
_CHUNK = f"chunk bigint, key bigint, bad boolean, a array<int>, b array<int>, n array<bigint>, docs array<struct<doc_id bigint, ok boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest string>>, units binary, links binary, parts array<struct<at bigint, {_FRAGMENT}>>"


class Pair:
    """Both tokenizers, made from the text of a byte-level BPE file and the bytes of a sentencepiece BPE model."""

    def __init__(self, spec: str, model: bytes):
        d = json.loads(spec)
        kind = d.get("pre_tokenizer") or {}
        if d["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or d.get("normalizer"):
            raise ValueError("the first vocabulary must be a byte-level BPE that splits words and neither normalizes nor adds a space")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the second vocabulary joins words")
        symbols = byte_symbols()
        raw = {i: bytes(symbols[c] for c in token) for token, i in d["model"]["vocab"].items()}
        self.encode_a = self._in_order_of_merges(d, raw) or self._by_file(spec)
        self.blob_a = _Table([raw.get(i, b"") for i in range(max(raw) + 1)])
        self.blob_b = _Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    @staticmethod
    def _in_order_of_merges(d: dict, raw: dict[int, bytes]) -> Callable[[str], list[int]] | None:
        """An encoder for a vocabulary whose ids are the ranks of its merges, which is much quicker for short texts; else None."""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]]
        vocab = d["model"]["vocab"]
        first = min((vocab[a + b] for a, b in merges), default=0)
        special = {t["id"] for t in d["added_tokens"]}
        plain = {x: i for i, x in raw.items() if i not in special}
        if [vocab[a + b] for a, b in merges] != list(range(first, first + len(merges))) or len(plain) != len(merges) + 256 or any(len(x) > 1 for x, i in plain.items() if i < first):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={}).encode_ordinary

    @staticmethod
    def _by_file(spec: str) -> Callable[[str], list[int]]:
        t = tokenizers.Tokenizer.from_str(spec)
        t.encode_special_tokens = True  # their strings are ordinary text
        t.no_truncation()
        t.no_padding()
        return lambda text: t.encode(text, add_special_tokens=False).ids

    def encode(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For both sides: ids of all tokens of all units in order, their ends in the units' bytes laid end to end, and how many each unit has.

        A unit stands for a space and itself. Those that either side doesn't spell byte for byte have no tokens; their bytes count.
        """
        whole = [" " + u for u in units]
        bodies = [w.encode() for w in whole]
        sizes = np.array([len(x) for x in bodies], np.int64)
        flat, ends = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(sizes)
        sides, good = [], np.ones(len(units), bool)
        for table, ids in ((self.blob_a, list(map(self.encode_a, whole))), (self.blob_b, self.b.encode(units, num_threads=1) if units else [])):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            tokens = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            own = np.repeat(np.arange(len(units)), n)
            spelled = np.bincount(own, table.lengths[tokens], len(units)).astype(np.int64)
            same = spelled == sizes
            part = flat if same.all() else flat[np.repeat(same, sizes)]
            unlike = table.spell(tokens[same[own]]) != part
            if unlike.any():
                same[np.repeat(np.flatnonzero(same), sizes[same])[unlike]] = False
            good &= same
            sides.append((tokens, own))
        out = []
        for table, (tokens, own) in zip((self.blob_a, self.blob_b), sides):
            keep = good[own]
            tokens, own = tokens[keep], own[keep]
            n = np.bincount(own, minlength=len(units))
            within = np.cumsum(table.lengths[tokens]) - np.repeat(np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))[:-1]]), n)
            out.append((tokens, within + np.repeat(ends - sizes, n), n))
        return [*out, (good, sizes, ends)]


class _Table:
    """Bytes of tokens by id."""

    def __init__(self, raw: list[bytes]):
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.offsets, self.blob = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(raw), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.blob[np.repeat(self.offsets[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def listed(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> str:
    """Groups in order, from a place where one begins to one where one ends, as `a1,a2|b1;a3|b2`."""
    ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
    group = np.concatenate([2 * np.searchsorted(ends, a_ends), 2 * np.searchsorted(ends, b_ends) + 1])
    order = np.argsort(group, kind="stable")
    group, ids = group[order], np.concatenate([a, b])[order].tolist()
    last = np.flatnonzero(np.append(group[1:] != group[:-1], True)) if len(ids) else []
    text = list(map(str, ids))
    mark = [","] * len(ids)
    for k in last:
        mark[k] = "|" if not group[k] & 1 else ";"
    return "".join([x for both in zip(text, mark) for x in both])[:-1]


def fragment(a, a_ends, b, b_ends) -> dict:
    """The fragment of the tokens that end in one range of bytes."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    out = {"n_a": len(a), "n_b": len(b), "closed": bool(len(common)), "groups": max(len(common) - 1, 0), "body": ""}
    first, last = (common[0], common[-1]) if len(common) else (None, None)
    for s, ids, ends in (("a", a, a_ends), ("b", b, b_ends)):
        i, j = (np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "right")) if len(common) else (len(ids), len(ids))
        out |= {f"p{s}": ids[:i].tolist(), f"p{s}e": ends[:i].tolist(), f"s{s}": ids[j:].tolist(), f"s{s}e": ends[j:].tolist()}
        out[s] = ids[i:j], ends[i:j]
    (x, xe), (y, ye) = out.pop("a"), out.pop("b")
    out["body"] = listed(x, xe, y, ye)
    return out


def composed(left: dict, right: dict) -> dict:
    """The fragment of two neighbouring ranges."""
    out = {"n_a": left["n_a"] + right["n_a"], "n_b": left["n_b"] + right["n_b"], "closed": left["closed"] or right["closed"]}
    ends = ("pa", "pae", "pb", "pbe"), ("sa", "sae", "sb", "sbe")
    if left["closed"] and right["closed"]:
        middle = listed(*[np.array(left[s] + right[p], np.int64) for p, s in zip(*ends)])
        body = ";".join(x for x in (left["body"], middle, right["body"]) if x)
        return out | {"groups": left["groups"] + 1 + right["groups"], "body": body} | {k: left[k] for k in ends[0]} | {k: right[k] for k in ends[1]}
    if left["closed"]:
        return out | {"groups": left["groups"], "body": left["body"]} | {k: left[k] for k in ends[0]} | {s: left[s] + right[p] for p, s in zip(*ends)}
    return out | {"groups": right["groups"], "body": right["body"]} | {p: left[p] + right[p] for p in ends[0]} | {s: right[s] for s in ends[1]}


def closed(whole: dict) -> tuple[int, int, int, int, str]:
    """n_a, n_b, n_groups, n_links and the list of groups of a fragment that is a whole text: its prefix is the first group, nothing is open behind."""
    first = listed(*[np.array(whole[k], np.int64) for k in ("pa", "pae", "pb", "pbe")])
    n = whole["groups"] + bool(first)
    return whole["n_a"], whole["n_b"], n, whole["n_a"] + whole["n_b"] - n, ";".join(x for x in (first, whole["body"]) if x)


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest()


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Unit codes of all texts in order, how many each text has, and the units."""
    words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = words.flatten().dictionary_encode()
    known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    sizes = np.diff(words.offsets.to_numpy())
    bare = np.array([bool(w) for w in known], bool)
    begins = np.array([bool(w) and not w[0].isspace() for w in known], bool)
    ends = np.array([bool(w) and not w[-1].isspace() for w in known], bool)
    if bare.all() and begins.all() and ends.all():
        return code, sizes, known
    first = np.zeros(len(code), bool)
    first[np.cumsum(sizes) - sizes] = True
    starts = first.copy()
    starts[1:] |= ends[code[:-1]] & begins[code[1:]]
    at = np.flatnonzero(starts)
    n = np.diff(np.append(at, len(code)))
    unit = code[at].astype(np.int64)
    joined: dict[str, int] = {}
    for k in np.flatnonzero(n > 1):
        text = " ".join(known[c] for c in code[at[k] : at[k] + n[k]])
        unit[k] = joined.setdefault(text, len(known) + len(joined))
    used, unit = np.unique(unit, return_inverse=True)
    every = known + list(joined)
    return unit, np.add.reduceat(starts.astype(np.int64), np.cumsum(sizes) - sizes), [every[i] for i in used]


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<i4").tobytes())


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i4").astype(np.int64)


def _chunk_row(pair: Pair, docs: list[tuple], key: int | None, at: int) -> dict:
    """A row of _CHUNK for docs of doc_id and text; with a key, for the one part of a long text that begins at byte `at`."""
    codes, sizes, units = _units([t for _, t in docs])
    (a, a_ends, n_a), (b, b_ends, n_b), (good, bytes_of, unit_ends) = pair.encode(units)
    every = np.union1d(a_ends, b_ends)
    link = np.stack([a[np.searchsorted(a_ends, every)], b[np.searchsorted(b_ends, every)]]) if len(every) else np.zeros((2, 0), np.int64)
    pairs, link = np.unique(link[0] << 32 | link[1], return_inverse=True)
    n_links = np.diff(np.searchsorted(every, np.concatenate([[0], unit_ends]), "right"))
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    n_groups = np.diff(np.searchsorted(common, np.concatenate([[0], unit_ends]), "right"))
    starts = np.cumsum(sizes) - sizes
    total = lambda per_unit: np.add.reduceat(per_unit[codes], starts)
    ok = total((~good).astype(np.int64)) == 0
    counts = np.bincount(codes[np.repeat(ok, sizes)], minlength=len(units))
    n = np.bincount(link, np.repeat(counts, n_links), len(pairs)).astype(np.int64)  # exact below 2**53
    out = {"key": key, "bad": not ok.all(), "a": (pairs >> 32).astype(np.int32), "b": (pairs & 0xFFFFFFFF).astype(np.int32), "n": n, "units": _pack(np.concatenate([sizes, codes])), "links": _pack(np.concatenate([n_links, link])), "parts": None}
    sums = list(zip(*[np.where(ok, total(x), 0).tolist() for x in (n_a, n_b, n_groups, n_links)]))
    if key is None:
        spelled = _listed_units(a, a_ends, b, b_ends, n_a, n_b, good)
        digests = [hashlib.sha256(b"".join([spelled[c] for c in codes[s : s + m].tolist()])[:-1]).hexdigest() if fine else "" for s, m, fine in zip(starts.tolist(), sizes.tolist(), ok.tolist())]
    else:
        digests = [None]
        out["parts"] = list(_fragments(codes, (a, a_ends, n_a), (b, b_ends, n_b), bytes_of, unit_ends, at)) if ok.all() else []
    out["docs"] = [(doc_id, fine, *s, d) for (doc_id, _), fine, s, d in zip(docs, ok.tolist(), sums, digests)]
    return out


def _listed_units(a, a_ends, b, b_ends, n_a, n_b, good) -> list[bytes]:
    """The groups of each unit, a `;` after each; nothing for one without tokens."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    group = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
    order = np.argsort(group, kind="stable")
    group = group[order]
    last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
    mark = pa.array([",", "|", ";"]).take(pa.array(np.where(last, 1 + (group & 1), 0)))
    text = pc.binary_join_element_wise(pa.array(np.concatenate([a, b])[order]).cast(pa.string()), mark, "")
    body = b"".join(text.cast(pa.binary()).to_pylist()) if text.offset or len(text) == 0 else text.buffers()[2].to_pybytes()
    ends = np.frombuffer(text.buffers()[1], np.int32)[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist() if len(text) else [0] * (len(good) + 1)
    return [body[i:j] for i, j in zip(ends, ends[1:])]


def _fragments(codes, side_a, side_b, bytes_of, unit_ends, at: int) -> Iterator[dict]:
    """Fragments of the text that `codes` spell, which begins at byte `at`, by the ranges that divide all texts."""
    unit_at = at + np.cumsum(bytes_of[codes]) - bytes_of[codes]
    laid = []
    for ids, ends, n in (side_a, side_b):
        first = np.cumsum(n) - n
        m = n[codes]
        k = np.repeat(first[codes] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        laid += [ids[k], ends[k] - np.repeat((unit_ends - bytes_of)[codes] - unit_at, m)]
    a, a_ends, b, b_ends = laid
    for lo in range(at // RANGE, int((a_ends[-1] - 1) // RANGE) + 1):
        edges = lo * RANGE, (lo + 1) * RANGE
        i, j = np.searchsorted(a_ends, edges, "right"), np.searchsorted(b_ends, edges, "right")
        yield {"at": max(at, edges[0])} | fragment(a[i[0] : i[1]], a_ends[i[0] : i[1]], b[j[0] : j[1]], b_ends[j[0] : j[1]])


def _parts(docs: DataFrame) -> DataFrame:
    """key, doc_id, at, text: parts of long texts, without the space that each begins with."""

    def work():
        def each(key, doc_id, text):
            begin, offset = 0, 0
            while begin < len(text):
                met = _SAFE.search(text, begin + PART)
                end = met.start() if met else len(text)
                part = text[begin:end]
                yield key, doc_id, offset, part
                begin, offset = end + 1, offset + 1 + len(part.encode())

        return each

    return map_rows(docs.withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "text"), work, "key bigint, doc_id bigint, at bigint, text string")


def chunks(docs: DataFrame, byte_level: str, pieces: bytes) -> DataFrame:
    """Rows of _CHUNK for all texts with a word."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((byte_level, pieces))  # the files' size, whatever the data
    docs = docs.select("doc_id", "text").where(F.length("text") > 0)
    length = F.octet_length("text")
    long = cut(_parts(docs.where(length > PART)))  # written, so the keys stay as they are
    short = docs.where(length <= PART).select(F.lit(None).cast("bigint").alias("key"), "doc_id", F.lit(0).cast("bigint").alias("at"), "text")
    spread = long.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "at")
    schema = _arrow(_CHUNK)

    def run(batches):
        from pyspark import TaskContext

        pair, number, held, size = None, TaskContext.get().partitionId() << 32, [], 0

        def row(docs, key=None, at=0):
            nonlocal pair
            pair = pair or Pair(*files.value)
            return pa.RecordBatch.from_pylist([_chunk_row(pair, docs, key, at) | {"chunk": number}], schema)

        for batch in batches:
            for key, doc_id, at, text in zip(*[c for c in batch.columns]):
                key, doc_id, text = key.as_py(), doc_id.as_py(), text.as_py()
                if key is None:
                    held.append((doc_id, text))
                    size += len(text)
                if key is not None or size >= CHUNK:
                    yield row([(doc_id, text)], key, at.as_py()) if key is not None else row(held)
                    number += 1
                    held, size = (held, size) if key is not None else ([], 0)
        if held:
            yield row(held)

    return map_batches(short.unionByName(spread), run, _parse_datatype_string(_CHUNK))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(schema))


def whole(parts: DataFrame) -> DataFrame:
    """key and a fragment of every text, from rows of key and fragments at different bytes: joined FAN ranges at a time until each text has one."""
    last = parts.agg(F.max("at")).first()[0] or 0
    width = RANGE
    schema = f"key bigint, at bigint, {_FRAGMENT}"
    arrow = _arrow(schema)

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        done = rows[0]
        for r in rows[1:]:
            done = {"key": done["key"], "at": done["at"]} | composed(done, r)
        return pa.Table.from_pylist([done], arrow)

    while True:
        width *= FAN
        parts = cut(parts.groupBy("key", F.expr(f"at div {width}").alias("range")).applyInArrow(join, schema))
        if last < width:
            return parts


def align(docs: DataFrame, byte_level: str, pieces: bytes) -> DataFrame:
    """One row for each of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256 (string).

    `byte_level` is the text of a byte-level BPE file and `pieces` a sentencepiece BPE model: side A encodes a space and the text, side B the text, to which it adds that space. Texts that are null, empty, or that either side doesn't
    spell byte for byte have no tokens: zeros, and '' for groups_sha256; they count for no pair of ids. An id pair's count is in how many links it is, over all texts; a link is best if no pair with its B id has a greater count, ties included.
    Repeated rows give repeated results and count again, null ids stay, other columns are not read, and an empty table gives no rows. One row's list of groups must fit a string of Spark.
    """
    rows = cut(chunks(docs, byte_level, pieces))
    keyed = rows.where(F.col("key").isNotNull())
    bad = cut(keyed.where("bad").select("key").distinct())
    lost = sized(bad)
    links = rows.select("chunk", "key", F.posexplode(F.arrays_zip("a", "b", "n")).alias("i", "x")).select("chunk", "key", "i", "x.*")
    counts = links.join(lost, "key", "left_anti").groupBy("a", "b").agg(F.sum("n").alias("f")).where("f > 0")
    counts = cut(counts)
    best = counts.groupBy("b").agg(F.max("f").alias("top"))
    table = cut(counts.join(best, "b").select("a", "b", "f", (F.col("f") == F.col("top")).alias("best")))
    found = look_up(links.select("chunk", "i", "a", "b"), table, ["a", "b"], "f").groupBy("chunk").agg(F.collect_list(F.struct("i", "f", "best")).alias("found"))
    schema = "key bigint, doc_id bigint, ok boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest string, n_best bigint, count_sum bigint"
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                key, docs, units, links, found = (batch.column(c)[k] for c in range(5))
                docs, pairs = docs.values, found.values
                f, top = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if pairs is not None and len(pairs):
                    i = pairs.field("i").to_numpy()
                    f, top = np.zeros(i.max() + 1, np.int64), np.zeros(i.max() + 1, np.int64)
                    f[i] = pairs.field("f").fill_null(0).to_numpy()
                    top[i] = pairs.field("best").fill_null(False).cast(pa.int64()).to_numpy()
                units, links, n = _unpack(units.as_py()), _unpack(links.as_py()), len(docs)
                sizes, codes = units[:n], units[n:]
                m = int(codes.max()) + 1
                n_links, link = links[:m], links[m:]
                starts = np.cumsum(sizes) - sizes
                sums = []
                for per_pair in (top, f):
                    running = np.concatenate([[0], np.cumsum(per_pair[link])])
                    ends = np.cumsum(n_links)
                    sums.append(np.add.reduceat((running[ends] - running[ends - n_links])[codes], starts))
                ok = docs.field("ok").cast(pa.int64()).to_numpy()
                columns = [pa.array([key.as_py()] * n, pa.int64()), *[docs.field(c) for c in ("doc_id", "ok", "n_a", "n_b", "n_groups", "n_links", "digest")], *[pa.array(s * ok) for s in sums]]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    each = map_batches(rows.join(found, "chunk", "left").select("key", "docs", "units", "links", "found"), run, schema)
    each = cut(each)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    short = each.where(F.col("key").isNull()).select("doc_id", *names, F.col("digest").alias("groups_sha256"))
    fragments = whole(cut(keyed.join(lost, "key", "left_anti").select("key", F.explode("parts").alias("x")).select("key", "x.*")))

    def work():
        def each(key, *values):
            *n, groups = closed(dict(zip((c.split()[0] for c in _FRAGMENT.split(", ")), values)))
            yield key, *n, _digest(groups)

        return each

    joined = map_rows(fragments.drop("at"), work, "key bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string")
    sums = each.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    long = sums.join(joined, "key", "left").select("doc_id", *[F.when(F.col("groups_sha256").isNull(), F.lit(0)).otherwise(F.col(c)).cast("bigint").alias(c) for c in names], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    empty = docs.where(F.coalesce(F.length("text"), F.lit(0)) == 0).select("doc_id", *[F.lit(0).cast("bigint").alias(c) for c in names], F.lit("").alias("groups_sha256"))
    return short.unionByName(long).unionByName(empty)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, by align(), with the byte-level vocabulary of 50,257 tokens and the sentencepiece one of 32,000."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        pieces = f.read()
    return align(read(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path("byte_bpe_50k.json")), pieces)
