"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

Encoding takes, at each place, the longest token that an Aho-Corasick automaton finds there, and keeps it if it may stand after
the token before it; else it tries the next shorter one, and goes back a token when none is left. Two tokens may stand side by side if
merging their joined bytes would leave the border between them. That is decided from both tokens' merge trees and remembered in a
table, which makes the result equal to replaying all merges, without replaying them.

Only pre-tokens not seen before by a Python worker are encoded; their ids are remembered as bytes, in a table of fixed size.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.llm.batches import map_rows
from fenestra.llm.common import read

#: The pattern that a byte-level pre-tokenizer uses when the file doesn't name one.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 60
#: Pre-tokens remembered by a worker, of so many bytes at most; the table is emptied when full.
MEMO, MEMO_BYTES = 400_000, 64


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one vocabulary, given as the text of a tokenizers JSON file."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        kind, odd = d.get("pre_tokenizer") or {}, [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if d["model"].get(k)]
        if d["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or d.get("normalizer") or odd:
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        vocab = {raw(t): i for t, i in d["model"]["vocab"].items()}
        added = {t["content"]: t["id"] for t in d["added_tokens"]}
        if any(t[k] for t in d["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip or match whole words only are not supported")
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for at, pair in enumerate(d["model"]["merges"]):
            left, right = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            whole = vocab[left + right]
            self.merge[vocab[left], vocab[right]] = at
            if self.order.setdefault(whole, at) == at:
                self.parts[whole] = vocab[left], vocab[right]
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if len(t) == 1 or i in self.parts:  # others can't result from merges
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        usable = {t: i for t, i in vocab.items() if len(t) == 1 or i in self.parts}
        self.shorter = {i: next((usable[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in usable), None) for t, i in usable.items()}
        self.splits = regex.compile(PATTERN).findall if kind.get("use_regex", True) else lambda s: [s] if s else []
        self.specials = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        size = max(self.bytes_of) + 1
        lengths = np.zeros(size, np.int64)
        for i, t in self.bytes_of.items():
            lengths[i] = len(t)
        self.lengths, self.offsets = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    def _compatible(self, x: int, y: int) -> bool:
        """Whether merging the bytes of x and y leaves exactly x, y."""
        left, right = [x], [y]  # the tokens that touch the border, last to first
        while left[-1] in self.parts:
            left.append(self.parts[left[-1]][1])
        while right[-1] in self.parts:
            right.append(self.parts[right[-1]][0])
        i, j = len(left) - 1, len(right) - 1
        while True:
            next_left = self.order[left[i - 1]] if i else NEVER
            next_right = self.order[right[j - 1]] if j else NEVER
            across = self.merge.get((left[i], right[j]), NEVER)
            if across < next_left and across <= next_right:  # of equal merges, the leftmost goes first
                return False
            if not i and not j:
                return True
            if next_left <= next_right:
                i -= 1
            else:
                j -= 1

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest: list[int | None] = [None] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):  # for one end, longer tokens come first
            start = end + 1 - len(self.bytes_of[token])
            longest[start] = token  # ends only grow
        dead, out, at, token = bytearray(n + 1), [], 0, longest[0]
        while at < n:
            if token is None:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                last = out.pop()
                at, token = at - len(self.bytes_of[last]), self.shorter[last]
                continue
            end = at + len(self.bytes_of[token])
            if not dead[end] and (not out or self._fit(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            else:
                token = self.shorter[token]
        return out

    def _fit(self, x: int, y: int) -> bool:
        key = x << 32 | y
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[key] = self._compatible(x, y)
        return known

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = b"".join(i.to_bytes(4, "little") for i in self.encode_piece(raw))
        if len(raw) <= MEMO_BYTES:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def _ordinary(self, text: str) -> bytes:
        get, make = self.memo.get, self._piece
        return b"".join([get(p) or make(p) for p in self.splits(text)])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return self._ordinary(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self._ordinary(text[at : m.start()]), self.added[m[0]]
            at = m.end()
        return b"".join([*out, self._ordinary(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids' tokens, gathered from one table by offset and length."""
        t = np.frombuffer(ids, "<u4")
        out = []
        for k in range(0, len(t), 1 << 20):
            part = t[k : k + (1 << 20)]
            n = self.lengths[part]
            ends = np.cumsum(n)
            out.append(self.blob[np.repeat(self.offsets[part] - (ends - n), n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def vocabulary(path: str) -> str:
    """The text of a vocabulary file, read on the driver; tasks get it by broadcast, so executors need no copy."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, digests: bool = False, keep: bool = True) -> DataFrame:
    """One row for each of `docs` (doc_id, text): doc_id, n_tokens, and ids (array<int>) with `keep`.

    A null text is an empty one and has no tokens. Added tokens spelled out in a text become their ids. `digests` adds ids_sha256 and decoded_sha256,
    the latter of the text decoded again. Repeated rows give repeated results; other columns are not read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # the file's size, whatever the data

    def work():
        c = Codec(spec.value)  # a task's own: workers live on, and other operators' tasks need their memory

        def each(doc_id, text):
            ids = c.encode(text or "")
            sums = None, None
            if digests:
                back = c.decode(ids).decode("utf-8", "replace").encode()
                sums = hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()
            yield doc_id, len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32) if keep else None, *sums

        return each

    out = map_rows(docs.select("doc_id", "text"), work, "doc_id bigint, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string")
    return out.drop(*[] if keep else ["ids"], *[] if digests else ["ids_sha256", "decoded_sha256"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null or no ids give an empty text, bytes that aren't UTF-8 its replacement character."""
    spec = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def work():
        c = Codec(spec.value)  # a task's own: workers live on, and other operators' tasks need their memory

        def each(doc_id, ids):
            yield doc_id, c.decode(np.asarray(ids or [], "<u4").tobytes()).decode("utf-8", "replace")

        return each

    return map_rows(encoded.select("doc_id", "ids"), work, "doc_id bigint, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, n_tokens and digests of the ids and of the text decoded from them, by encode(); a null text has no tokens."""
    import public_tokenizers

    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True, keep=False)
