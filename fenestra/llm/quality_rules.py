"""Rule bitmask ledger: every quality rule is evaluated once and kept as one bit beside its measurements.

The ledger is written once. Policies are sets of bits with a version, so changing a policy, comparing two of
them or asking what one rule alone removes (an ablation) costs a bitwise operation on a number that is
already there; the texts are not read again.

All of it is DataFrame functions. The repeated-window measure sorts the window hashes of one text inside its own row, so
there is no shuffle at all before the ablation's bitwise aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.llm.common import cut, read, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Rules in bit order. The first two are the base policy. Each is a condition on the measurements; integers only.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbol_heavy": "100 * n_symbols > 15 * word_chars",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a text is kept if none of their bits is set."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(RULES))


def _bind(value: Column, body) -> Column:
    """Evaluate `value` once for a row and hand it to `body` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(tokens: Column) -> Column:
    """How many words lie in a window of five words that the text holds twice or more."""
    w = WINDOW
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - w), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(w)]))

    def covered(keys: Column) -> Column:
        by_key = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return _bind(by_key, lambda s: _bind(positions(s), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(w), F.coalesce(F.get(p, i + 1) - x, F.lit(w)))), F.lit(0).cast("bigint"), lambda a, x: a + x)))

    def positions(s: Column) -> Column:
        # get() gives null outside the array
        same = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False)))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def measure(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("bigint")).otherwise(covered(keys))

    return F.when(F.size(tokens) < w + 1, F.lit(0).cast("bigint")).otherwise(_bind(hashes, lambda h: _bind(windows(h), measure)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with their measurements and `failed_bits`.

    Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and failed_bits (long, bit i for
    the i-th of RULES). Columns of these names in the input are replaced. A null text is measured as an empty one. Lines count
    only if they hold a word; each line equal to an earlier one counts as a duplicate. Two windows are the same if the
    64-bit hashes of their words' hashes are; within one text of n words, two different windows collide with
    a chance below n*n / 2**65. Repeated rows are measured each for itself.
    """
    # coalesce(): a null text behaves as an empty one in every measure
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    measured = docs.withColumn("_tokens", words(F.col(text))).withColumns({
        "n_words": F.size("_tokens").cast("bigint"),
        "word_chars": F.length(F.array_join("_tokens", "")).cast("bigint"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint"),
        "_lines": _bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds"))),
        "n_repeat_words": _repeated_words(F.col("_tokens")),
    }).withColumns({"n_lines": F.col("_lines.n").cast("bigint"), "n_dup_lines": (F.col("_lines.n") - F.col("_lines.kinds")).cast("bigint")})
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed_bits", total).drop("_tokens", "_lines")


def apply_policy(scored: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """Add the boolean `out`: none of the policy's bits is set."""
    return scored.withColumn(out, F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(scored: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many rows fail it, fail it alone, and would be kept without it.

    One row per rule: rule, policy, n_failed, n_failed_alone, n_kept_without (long). One pass that counts the distinct bit patterns (2**rules at
    most), then bitwise tests on those counts. An empty ledger gives zeros.
    """
    patterns = scored.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    tests = {}
    for rule in policy.rules:
        bit = 1 << list(RULES).index(rule)
        has, rest = F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("bits").bitwiseAND(F.lit(policy.mask & ~bit)) == 0
        tests[rule] = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (has, has & rest, rest)]
    row = patterns.agg(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(policy.version).alias("policy"), a.alias("n_failed"), b.alias("n_failed_alone"), c.alias("n_kept_without")) for r, (a, b, c) in tests.items()]).alias("x"))
    return row.select(F.inline("x"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: measurements, the verdicts of the base and the standard policy, failed_bits, and the version of the policy behind kept."""
    scored = apply_policy(apply_policy(ledger(read(spark, sf_dir, "documents").select("doc_id", "text")), STANDARD), BASE, "base_kept")
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed_bits", F.lit(STANDARD.version).alias("policy"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For both policies, each rule's ablation over all documents: the ledger is made once, and its bit patterns are counted for each policy."""
    bits = cut(ledger(read(spark, sf_dir, "documents").select("text")).select("failed_bits"))
    return ablations(bits, BASE).unionByName(ablations(bits, STANDARD))


_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))

_LEDGER_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents
), w AS (
  SELECT rid, doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t
), u AS (
  SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= {WINDOW}
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i+{WINDOW - 1}], ' ')) AS n FROM u
), hit AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM win WHERE n >= 2
), rep AS (
  SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM hit GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)
), b AS (SELECT *, CAST({_BITS} AS BIGINT) AS failed_bits FROM m)"""

OP5_SQL = f"""{_LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {BASE.mask}) <> 0 AS base_failed,
       (failed_bits & {STANDARD.mask}) = 0 AS kept, failed_bits, '{STANDARD.version}' AS policy FROM b
"""


def _ablation_sql(policy: Policy, rule: str) -> str:
    bit = 1 << list(RULES).index(rule)
    count = lambda test: f"CAST(count(*) FILTER (WHERE {test}) AS BIGINT)"
    rest = f"failed_bits & {policy.mask & ~bit} = 0"
    return f"SELECT '{rule}' AS rule, '{policy.version}' AS policy, {count(f'failed_bits & {bit} <> 0')} AS n_failed, {count(f'failed_bits & {bit} <> 0 AND {rest}')} AS n_failed_alone, {count(rest)} AS n_kept_without FROM b"


ABLATIONS_SQL = _LEDGER_SQL + " UNION ALL ".join(_ablation_sql(p, r) for p in (BASE, STANDARD) for r in p.rules)
