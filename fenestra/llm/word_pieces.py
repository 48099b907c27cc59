"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest piece of the vocabulary at each place of a word. The automaton is a trie over the
pieces with failure links: where no edge goes on, the pieces that greedy splitting would have emitted by then are popped, and the walk goes on from
the node that spells what is left. Only how many pieces each link pops is stored, so counting a word reads each
character once and builds no pieces.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.llm.batches import map_rows
from fenestra.llm.bpe import byte_symbols, vocabulary
from fenestra.llm.common import read

#: Words remembered by a worker, of so many bytes at most; the table is emptied when full.
MEMO, MEMO_BYTES = 400_000, 64
MARK = "Ġ"


def pieces_of(spec: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuing pieces from a byte-level vocabulary: tokens with a leading space, and those without.

    Tokens that aren't whole UTF-8 characters, or hold white space, are left out.
    """
    symbols, first, later = byte_symbols(), [], []
    for token in json.loads(spec)["model"]["vocab"]:
        begins = token.startswith(MARK)
        try:
            piece = bytes(symbols[c] for c in token[begins:]).decode()
        except UnicodeDecodeError:
            continue
        if piece and not any(c.isspace() for c in piece):
            (first if begins else later).append(piece)
    return first, later


class Counter:
    """Counts greedy longest-match pieces of a word; 0 where some part has no piece."""

    def __init__(self, first: list[str], later: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # node 0 begins a word, node 1 continues one
        ends = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                at = root
                for c in piece:
                    nxt = self.edges[at].get(c)
                    if nxt is None:
                        nxt = self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    at = nxt
                ends[at] = True
        self.link, self.pops = [-1] * len(ends), [0] * len(ends)
        todo = deque((0, 1))
        while todo:  # by depth: the links of shorter prefixes are there before they are needed
            node = todo.popleft()
            for c, child in self.edges[node].items():
                todo.append(child)
                if ends[child]:
                    self.link[child], self.pops[child] = 1, 1
                    continue
                at, popped = self.link[node], self.pops[node]
                while at >= 0 and c not in self.edges[at]:
                    at, popped = self.link[at], popped + self.pops[at]
                if at >= 0:
                    self.link[child], self.pops[child] = self.edges[at][c], popped
        self.memo: dict[bytes, int] = {}

    def count(self, word: str) -> int:
        edges, link, pops, at, n = self.edges, self.link, self.pops, 0, 0
        for c in word:
            while (to := edges[at].get(c)) is None:
                n += pops[at]
                at = link[at]
                if at < 0:
                    return 0
            at = to
        while at != 1:
            n += pops[at]
            at = link[at]
            if at < 0:
                return 0
        return n

    def remembered(self, word: bytes) -> int:
        n = self.count(word.decode())
        if len(word) <= MEMO_BYTES:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = n
        return n


@lru_cache(maxsize=2)
def counter(spec: str) -> Counter:
    return Counter(*pieces_of(spec))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row for each of `docs` (doc_id, text): doc_id, n_words, n_unknown, n_tokens (long).

    Words are separated by space and U+0009 to U+000D. A word that the pieces can't spell counts as one unknown token. A null or blank
    text has none. Repeated rows give repeated results; other columns are not read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # the file's size, whatever the data

    def work():
        c = counter(spec.value)

        def each(doc_id, text):
            counts = list(map(c.memo.get, ws := (text or b"").split()))  # bytes.split(): at ASCII white space
            if None in counts:
                counts = [c.remembered(w) if n is None else n for w, n in zip(ws, counts)]
            unknown = counts.count(0)
            yield doc_id, len(ws), unknown, sum(counts) + unknown

        return each

    return map_rows(docs.select("doc_id", F.col("text").cast("binary")), work, "doc_id bigint, n_words bigint, n_unknown bigint, n_tokens bigint")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, by token_counts(); a null text has no words."""
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
