"""URL filters by rules, and where none fits, by the words of host and path.

Names of hosts are words run together. A unigram model of the pages' own words splits them: the cheapest chain of known words, and of unknown ones that cost more the longer
they are, is found by Viterbi for every distinct run of letters. Then multinomial naive Bayes, taught by the URLs that a rule decides, scores the words of
host and path. Costs and weights are whole numbers (millionths of a nat), so a score is the same in whatever order it is added up.

Words, runs and URLs are all tables that grow with the input: nothing but the most frequent rows (a fixed number) and a bitmap of fixed size is
broadcast, everything else is joined by shuffles.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.llm.batches import map_rows
from fenestra.llm.common import cut, look_up, read
from fenestra.llm.shingles import bitmap, meets

#: Verdict, host and beginning of the path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A known word has so many letters at most; longer parts of names are unknown words.
LONGEST_WORD = 24
#: What a nat is in costs and weights.
UNIT = 1_000_000
_LETTER = round(UNIT * math.log(10))
#: Markup, programs and entities are no words of a page.
_MARKUP = r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>|&#?\w+;"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first `://` up to `/`, `?` or `#`, with A-Z lower-cased, and then up to `?` or `#`; both are empty without a `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; both null if none does. Of equally long ones the one with the longer host wins."""
    rule = verdict = F.lit(None).cast("string")
    for said, name, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):  # the last one to be wrapped is asked first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        rule, verdict = F.when(fits, F.lit(name + begin)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def word_table(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """word, n (long): lower-cased words of the pages' texts, and of the labels of `hosts` (host) that are spelled with hyphens."""
    text = F.lower(F.regexp_replace("html", _MARKUP, " "))
    found = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    spelled = F.expr("filter(split(lower(host), '[.:]'), x -> instr(x, '-') > 0)")
    from_hosts = hosts.select(F.explode(F.regexp_extract_all(F.array_join(spelled, " "), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return found.unionByName(from_hosts).where(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count("*").alias("n"))


def cheapest(run: str, arcs: list[tuple[int, int, int]], total: int) -> list[str]:
    """The words that `run` splits into at least cost, from arcs (first letter from 0, letters, occurrences of the word among `total`).

    A known word costs log(total / n); an unknown one of k letters log(total) and log(10) for each letter after the first. Of equal costs an unknown word wins, then a longer one.
    """
    begins: list[list[tuple[int, int]]] = [[] for _ in range(len(run) + 1)]
    for at, k, n in arcs:
        begins[at + k].append((k, round(UNIT * math.log(total / n))))
    whole, far = round(UNIT * math.log(max(total, 1))), 1 << 62
    best, opened, back, since = [0], [far], [0], [0]  # least cost up to a letter; the same inside an unknown word; and where the last word begins
    for end in range(1, len(run) + 1):
        new, on = best[end - 1] + whole, opened[end - 1] + _LETTER
        opened.append(min(new, on))
        since.append(since[end - 1] if on <= new else end - 1)
        cost, start = opened[end], since[end]
        for k, c in sorted(begins[end], reverse=True):
            if best[end - k] + c < cost:
                cost, start = best[end - k] + c, end - k
        best.append(cost)
        back.append(start)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def segment(runs: DataFrame, table: DataFrame) -> DataFrame:
    """run, words (array) for every row of `runs` (distinct runs of letters), by the words of `table` (word, n)."""
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cells = runs.sparkSession.sparkContext.broadcast(bitmap(table.select(F.xxhash64("word").alias("hash"))))  # of a fixed size

    def work():
        known, digest = cells.value, xxhash.xxh64_intdigest

        def each(run):
            spans = [(i, run[i:j]) for i in range(len(run)) for j in range(i + 1, min(len(run), i + LONGEST_WORD) + 1)]
            hit = meets(np.array([digest(p.encode(), 42) for _, p in spans], np.uint64), known)
            yield from ((run, *spans[k]) for k in np.flatnonzero(hit))

        return each

    spans = cut(map_rows(runs.select("run"), work, "run string, at int, word string"))
    arcs = look_up(spans, table, ["word"], "n").where(F.col("n").isNotNull())
    met = runs.select("run").join(arcs.groupBy("run").agg(F.collect_list(F.struct("at", F.length("word").alias("k"), "n")).alias("arcs")), "run", "left")

    def walk():
        def each(run, arcs):
            yield run, cheapest(run, [tuple(a.values()) for a in arcs or []], total)

        return each

    return map_rows(met.select("run", "arcs"), walk, "run string, words array<string>")


def _tokens(host: Column, path: Column) -> Column:
    """Runs of letters, and the lengths of runs of digits, by where they stand (h, p)."""

    def found(kind: str, text: Column) -> Column:
        runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\p{Nd}+"), F.lit(0))
        return F.transform(runs, lambda x: F.struct(F.lit(kind).alias("kind"), F.when(x.rlike(r"^\p{Nd}"), F.concat(F.lit("#"), F.length(x).cast("string"))).otherwise(x).alias("run")))

    return F.concat(found("h", host), found("p", path))


def fit(counts: DataFrame, blocked: int, allowed: int) -> tuple[DataFrame, int]:
    """Weights of multinomial naive Bayes with add-one smoothing, as kind, word, weight (long), from `counts` (kind, word, in_block, in_allow: long); and the prior's.

    A weight is log P(word | block) - log P(word | allow). Without any taught URL all weights are 0.
    """
    b, a, v = counts.agg(F.coalesce(F.sum("in_block"), F.lit(0)), F.coalesce(F.sum("in_allow"), F.lit(0)), F.count("*")).first()
    odds = lambda own, all_own, other, all_other: F.log((own + 1) / F.lit(all_own + v)) - F.log((other + 1) / F.lit(all_other + v))
    weight = F.round(odds(F.col("in_block"), b, F.col("in_allow"), a) * UNIT).cast("bigint")
    return counts.select("kind", "word", weight.alias("weight")), round(UNIT * math.log((blocked + 1) / (allowed + 1)))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """One row for each of `pages` (page_id, url, html): page_id, host, path, rule, verdict, score (long, millionths of a nat; above 0 means block).

    A rule that fits decides. Else the score does, which the tokens of host and path have by what the distinct URLs that rules decide teach; a URL without tokens, as a null one, has the prior's.
    Texts of the pages give the words that names are split by; null and empty ones none. Repeated rows give repeated results, null ids stay, other columns are not read, and an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    urls = cut(parsed.select("host", "path").distinct().withColumn("said", said))
    tokens = cut(urls.select("host", "path", "said", F.explode(_tokens(F.col("host"), F.col("path"))).alias("t")).select("host", "path", "said", "t.kind", "t.run"))
    in_runs = cut(tokens.groupBy("kind", "run").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "block").alias("in_block"), F.count_if(F.col("said") == "allow").alias("in_allow")))
    table = cut(word_table(pages, urls.select("host").distinct()))
    runs = in_runs.select("run").where(~F.startswith("run", F.lit("#"))).distinct()
    split = cut(segment(runs, table))
    in_words = in_runs.join(split, "run", "left").select("kind", "run", "n", "in_block", "in_allow", F.explode(F.coalesce("words", F.array("run"))).alias("word"))
    in_words = cut(in_words)
    counts = in_words.groupBy("kind", "word").agg(F.sum("in_block").alias("in_block"), F.sum("in_allow").alias("in_allow"), F.sum("n").alias("n"))
    taught = {r["said"]: r["n"] for r in urls.groupBy("said").agg(F.count("*").alias("n")).collect()}  # three rows
    weights, prior = fit(cut(counts), taught.get("block", 0), taught.get("allow", 0))
    scores = cut(in_words.join(weights, ["kind", "word"]).groupBy("kind", "run").agg(F.sum("weight").alias("weight"), F.max("n").alias("n")))
    scored = look_up(tokens.select("host", "path", "kind", "run"), scores, ["kind", "run"], "n").groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    out = parsed.join(scored, ["host", "path"], "left").withColumn("score", F.coalesce("weight", F.lit(0)) + F.lit(prior))
    verdict = F.coalesce(said, F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.col("score").cast("bigint").alias("score"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the URL of every row of pages, by judge()."""
    return judge(read(spark, sf_dir, "pages"))
