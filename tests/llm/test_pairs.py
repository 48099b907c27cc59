"""Jaccard join and substring dedup against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from fenestra.llm import jaccard_join, substring_dedup
from fenestra.llm.components import components, merge

SCHEMA = "doc_id bigint, text string, component_id string, path string, n int"


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 4)))
    base = [[word() for _ in range(r.choice([3, 8, 40, 120]))] for _ in range(12)]
    passage = [word() for _ in range(60)]
    out = [None, "", " \t\n", "one", "ONE", "a b c d", "A B\nC d"]
    for b in base:
        out += [" ".join(b), " ".join(b).upper()]
        for _ in range(4):
            c = list(b)
            for _ in range(r.randint(1, 5)):
                c[r.randrange(len(c))] = word()
            out.append(" ".join(c))
        out.append(" ".join(b[: len(b) // 2] + passage + b[len(b) // 2 :]))
    many = [word() for _ in range(80)]
    for _ in range(60):
        c = list(many)
        c[r.randrange(80)] = word()
        out.append(" ".join(c))
    r.shuffle(out)
    return out


def frame(spark, values):
    rows = [(None if v is None else v[0], None if v is None else v[1], "x", None, 1) for v in values]
    return spark.createDataFrame(rows, SCHEMA)


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed):
    rows = list(enumerate(texts(seed)))
    got = jaccard_join.near_duplicates(frame(spark, rows + rows[:3] + [(None, "a b c d e")])).collect()
    assert len(got) == len(rows) + 4
    want = plain_components(rows)
    assert all(r.doc_id is None and r.component_id is None or (r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_one_of_each(spark):
    rows = list(enumerate(texts(3)))
    docs = frame(spark, rows + rows[:5] + [(None, "a b"), (None, "a b")])
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns
    want = plain_components(rows)
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in want.items() if c == i)
    assert sum(r.doc_id is None for r in got.collect()) == 2


def plain_removal(rows):
    """n_words, n_removed and the digest of what is left for each of `rows`; texts of one doc_id take nothing from each other."""
    k, first = substring_dedup.K, defaultdict(lambda: 1 << 60)
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - k + 1):
            if i is not None:
                first[tuple(w[p : p + k])] = min(i, first[tuple(w[p : p + k])])
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {p + j for p in range(len(w) - k + 1) if i is not None and first[tuple(w[p : p + k])] < i for j in range(k)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [4, 5])
def test_substring_dedup(spark, seed):
    rows = list(enumerate(texts(seed)))
    a, b, long = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 20), ("b", 20), ("w", 3000)))
    rows += rows[:4] + [(None, "a " * 30), (999, "q " * 20), (999, "r " * 20), (1001, a), (1001, b), (1002, a + " tail"), (1003, b + " more"), (1003, "z " + a), (1004, a), (1005, "x " + a), (1006, a + " " + b)]
    # runs over several blocks of places: whole, with words changed, and cut
    changed = [f"c{i}" if i % 700 == 699 else w for i, w in enumerate(long.split())]
    rows += [(2000, "y " * 5 + long), (2001, long), (2002, " ".join(changed)), (2003, " ".join(changed[640:2000])), (2004, "v " + " ".join(long.split()[63:200]) + " v")]
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == plain_removal(rows)


def plain_heads(edges):
    """The head of every edge's path, by going back one edge at a time."""
    into, out = Counter(v for _, v, _, _ in edges), Counter(u for u, _, _, _ in edges)
    by_place = {(d, p): (u, v) for u, v, d, p in edges}
    heads = {}
    for u, v, d, p in sorted(edges, key=lambda e: e[2:]):
        before = by_place.get((d, p - 1))
        heads[d, p] = heads[d, p - 1] if before and before[1] == u and into[u] == out[u] == 1 else p
    return heads


def test_compaction(spark):
    r = random.Random(11)
    edges, node = [], 0
    for doc, n in ((1, 700), (2, 64), (3, 128), (4, 129), (5, 1), (6, 2000)):
        node += 10_000
        place = r.choice([0, 3, 63, 64, 100])
        for _ in range(n):
            edges.append((node, node + 1, doc, place))
            gap = r.random() < 0.004
            node, place = node + 1 + gap, place + 1 + gap * r.choice([0, 1, 70])
    # branches at some nodes
    edges += [(u, -u, 7, 100 + 2 * i) for i, (u, _, _, _) in enumerate(r.sample(edges, 3))]
    edges = list({e[2:]: e for e in edges}.values())
    got = substring_dedup.compacted(spark.createDataFrame(edges, "u bigint, v bigint, from_doc bigint, from_place bigint")).collect()
    assert {(x.from_doc, x.from_place): x["head"] for x in got} == plain_heads(edges) and len(got) == len(edges)
    assert len({(x.from_doc, x["head"]) for x in got}) > 6


def test_paths_name_their_source(spark):
    rows = list(enumerate(texts(6)))
    words = {i: (t or "").split() for i, t in rows}
    for p in substring_dedup.repeated_paths(frame(spark, rows)).collect():
        n = p.n + substring_dedup.K - 1
        assert p.from_doc < p.doc_id and words[p.doc_id][p.start : p.start + n] == words[p.from_doc][p.from_at : p.from_at + n]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert jaccard_join.near_duplicates(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0 and jaccard_join.one_of_each(none).count() == 0
    blank = frame(spark, [(1, None), (2, "")])
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(blank).collect()) == [(1, 1), (2, 2)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 60), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 50, 50: 50, 60: 50}
    again = merge(components(spark.createDataFrame(links, "a bigint, b bigint")), spark.createDataFrame([(60, 40), (200, 201)], "a bigint, b bigint"))
    assert {r.id: r.component for r in again.collect()} == {i: 0 for i in range(41)} | {100: 0, 50: 0, 60: 0, 200: 200, 201: 200}
