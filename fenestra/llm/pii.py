"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Strict patterns with checks (the base) give spans that always stay. High-recall generators propose further, overlapping spans,
such as a card number that a neighbouring phone number hides from the base; only candidates that pass their kind's check can be added. Whether one that passes is
personal data or a look-alike (part of an id, a version, a price) is for boosted trees, by features of its format and context; the check's result is none of them. A
threshold for each kind, calibrated on candidates that the trees didn't see, selects what is added.

There are no hand-made labels. Candidates that equal a base span teach as positive, as they stand and once more as they would stand in a sentence: in brackets, before a comma or
full stop. Negative are candidates that fail their check, others behind a word or sign that announces an id, a version or a price, and look-alikes: a copy of each positive
that passes the check but stands in such a place.

Everything is DataFrame functions. Spans are found and scored inside the row, so a corpus is read twice (to fit, to apply) and no text is
shuffled; fitted trees become nested conditions. Within a row, n matches cost n * log(n): running sums and sorted sweeps, no array grown value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.llm.common import apart, cut, read

KINDS = ("email", "ip", "card", "phone")
#: Labelled candidates that the trees learn from, about, at most half of each kind; all others calibrate thresholds.
SAMPLE = 20_000
TREES, DEPTH = 12, 3
#: A threshold is the lowest score from which on so great a share of the calibrating candidates is positive.
PRECISION = 0.98
CONTEXT = 24
#: Windows that a step of a running sum joins, and steps: enough for 8**9 matches in one text.
RADIX, STEPS = 8, 9

# The base patterns. Lookbehind, \G (the end of the match before) and possessive repeats give the same matches as the plain patterns in
# linear time: in a run of characters that all could begin a match, only the run's first place is tried.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # shorter runs of digits fail the check anyway
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: High-recall generators.
PROPOSE = {
    "email": (rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",),
    "ip": (r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",),
    "card": (r"(?<![0-9])[0-9]{13,19}(?![0-9])", r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![0-9])", r"(?<![0-9])3[47][0-9]{2}[ .-]?[0-9]{6}[ .-]?[0-9]{5}(?![0-9])"),
    "phone": (r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
#: What a text must hold for a pattern of the kind to match at all.
GUARD: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.contains(t, F.lit("@")) | F.contains(t, F.lit("at)")) | F.contains(t, F.lit("at]")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ .-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")) | t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
}
#: Words that announce personal data, and words and signs that announce other numbers.
CUES = r"(?i)(?:mail|phone|tel|call|fax|card|visa|ip|host|addr|contact)[a-z]*\W*$"
LEAD = r"(?i)(?:\b(?:id|no|nr|ver|version|v|part|ref|price|sum|order)\W{0,2}|[=#$/])$"
FEATURES = ("kind", "length", "digits", "separators", "kinds_of_digits", "left", "right", "cue", "plus", "groups")
#: What stands before and after look-alikes, and after positives in a sentence.
LEADS, TAILS = (" id=", " id ", " v", " ver ", " #", " $", " no.", " ref: ", "/"), ("-7", "%", "/x", "7", "x", "_a")
STOPS = (". ", ", ", "; ", ") ", ".", ": ", "? ", '" ')

def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once for a row and hand it to `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(values: Column, how: str, back: bool = False) -> Column:
    """Running sum, max or min over an array of numbers, from its start or, with `back`, from its end.

    Each step joins RADIX windows of the step before, so n values cost n * log(n), and no array is grown value by value.
    """

    def step(a: Column, k: int) -> Column:
        far = RADIX**k if back else -(RADIX**k)

        def joined(x: Column, i: Column) -> Column:
            others = [F.get(a, i + j * far) for j in range(1, RADIX)]  # null outside the array
            if how == "sum":
                for o in others:
                    x = x + F.coalesce(o, F.lit(0))
                return x
            return F.greatest(x, *others) if how == "max" else F.least(x, *others)

        return F.transform(a, joined)

    def steps(a: Column, k: int) -> Column:
        return a if k == STEPS else F.when(F.size(a) <= RADIX**k, a).otherwise(_bind(step(a, k), lambda b: steps(b, k + 1)))

    return _bind(values, lambda a: steps(a, 0))


def _pieces(text: Column, pattern: str) -> Column:
    """All matches of a pattern (m), each with the text before it (p), and the text behind the last one, where m is null."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))


def _places(x: Column, more: Callable[[Column], list[Column]]) -> Column:
    """Matches from _pieces(): their places in code points (start, end) and bytes (from, to), s, before and after, and what `more` makes of s."""
    n = lambda y, size: size(y["p"]) + F.coalesce(size(y["m"]), F.lit(0))

    def spans(ends: Column) -> Column:
        def span(y: Column, i: Column) -> Column:
            end, to = F.get(ends["n"], i), F.get(ends["b"], i)
            after = F.substring(F.coalesce(F.get(x, i + 1)["p"], F.lit("")), 1, 2)
            return F.struct(
                (end - F.length(y["m"])).alias("start"), end.alias("end"), (to - F.octet_length(y["m"])).alias("from"), to.alias("to"),
                y["m"].alias("s"), F.right(y["p"], F.lit(CONTEXT)).alias("before"), after.alias("after"), *more(y["m"]),
            )

        return F.transform(F.filter(F.transform(x, lambda y, i: F.struct(y.alias("y"), i.alias("i"))), lambda z: z["y"]["m"].isNotNull()), lambda z: span(z["y"], z["i"]))

    running = [_scan(F.transform(x, lambda y: n(y, size)), "sum").alias(name) for name, size in (("n", F.length), ("b", F.octet_length))]  # noqa: B023
    return _bind(F.struct(*running), spans)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: Column, s: Column, base: Column) -> Column:
    """The check of a kind; for the base, an email always passes."""
    n = F.length(_digits(s))
    email = base | (s.rlike(r"\.[A-Za-z]{2,}$") & ~s.rlike(r"\.\.|^[.-]"))
    ip = s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$")
    card = F.when((n >= 13) & (n <= 19), _luhn(_digits(s))).otherwise(False)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).otherwise((n >= 9) & (n <= 15))


def _left(before: Column) -> Column:
    """How closely something stands before, in the order that trees can cut: 0 nothing or white space, 1 what opens or parts, 2 another sign, 3 a letter, 4 a digit."""
    return F.when(before.rlike(r"\p{L}$"), 3).when(before.rlike("[0-9]$"), 4).when(before.rlike(r"""[(\[{<"',;:]$"""), 1).when(before.rlike(r"\S$"), 2).otherwise(0)


def _right(after: Column) -> Column:
    """The same for what stands behind; 1 is what closes or ends a sentence, with no letter or digit behind it."""
    closes = after.rlike(r"""^[.,;:!?)\]}>"'](?![\p{L}0-9])""")
    return F.when(after.rlike(r"^\p{L}"), 3).when(after.rlike("^[0-9]"), 4).when(closes, 1).when(after.rlike(r"^\S"), 2).otherwise(0)


def _features(x: Column) -> Column:
    """FEATURES of a candidate (kind, s, before, after) as an array<double>."""
    s, digits = x["s"], _digits(x["s"])
    kinds = F.size(F.array_distinct(F.filter(F.split(digits, ""), lambda c: c != "")))
    parts = [
        _rank(x["kind"]), F.length(s), F.length(digits), F.length(F.regexp_replace(s, r"[^ ().\-]", "")), kinds,
        _left(x["before"]), _right(x["after"]), F.when(x["before"].rlike(LEAD), -1).when(x["before"].rlike(CUES), 1).otherwise(0), s.startswith("+").cast("int"), F.size(F.split(s, "[^0-9A-Za-z]+")),
    ]
    return F.array(*[p.cast("double") for p in parts])


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _detected(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with _base (spans that always stay) and _more (candidates, each once, by kind and place, with valid: their check; they may overlap)."""
    body = F.col("_body")
    none = F.array().cast("array<struct<m:string,p:string>>")
    own = {k: GUARD[k](body) for k in KINDS}
    groups = [(k, True, BASE[k]) for k in KINDS] + [(k, False, p) for k in KINDS for p in PROPOSE[k]]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(base).alias("own"), F.when(own[k], _pieces(body, p)).otherwise(none).alias("x")) for k, base, p in groups])
    # one expression for the places of all patterns' matches
    found = F.transform(F.filter(each, lambda g: F.size(g["x"]) > 1), lambda g: _places(g["x"], lambda s: [g["kind"].alias("kind"), g["own"].alias("own"), _passes(g["kind"], s, g["own"]).alias("valid")]))
    some = docs.withColumn("_body", F.coalesce(F.col(text), F.lit(""))).withColumn("_found", F.flatten(found))
    base = F.transform(F.filter("_found", lambda x: x["own"] & x["valid"]), lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "from", "to"))))
    rest = F.transform(F.filter("_found", lambda x: ~x["own"]), lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "from", "to", "s", "before", "after", "valid"))))
    fresh = lambda a: lambda x, i: F.coalesce((F.get(a, i - 1)["kind"] != x["kind"]) | (F.get(a, i - 1)["start"] != x["start"]) | (F.get(a, i - 1)["end"] != x["end"]), F.lit(True))
    return some.withColumns({"_base": base, "_more": _bind(F.array_sort(rest), lambda a: F.filter(a, fresh(a)))}).drop("_found")


def _swept(base: Column, more: Column) -> Column:
    """`more` with same (a base span of the kind has its place) and over (it overlaps a base span), by place.

    Base spans and candidates are sorted together; running ends from the left and starts from the right tell what reaches into a candidate.
    """
    none = F.lit(None)
    fields = ("from", "to", "s", "before", "after", "valid")
    events = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"), F.lit(0).alias("own"), *(none.cast({"from": "int", "to": "int", "valid": "boolean"}.get(c, "string")).alias(c) for c in fields))),
        F.transform(more, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(1).alias("own"), *(x[c].alias(c) for c in fields))),
    )

    def swept(e: Column) -> Column:
        ends = _scan(F.transform(e, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(-1)), "max")
        starts = _scan(F.transform(e, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(2**31 - 1)), "min", back=True)

        def marked(r: Column) -> Column:
            def mark(x: Column, i: Column) -> Column:
                before = F.get(e, i - 1)
                same = (before["own"] == 0) & (before["kind"] == x["kind"]) & (before["start"] == x["start"]) & (before["end"] == x["end"])
                over = (F.get(r["ends"], i) > x["start"]) | (F.get(r["starts"], i) < x["end"])
                return F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "own", *fields)), F.coalesce(same, F.lit(False)).alias("same"), over.alias("over"))

            return F.filter(F.transform(e, mark), lambda x: x["own"] == 1)

        return _bind(F.struct(ends.alias("ends"), starts.alias("starts")), marked)

    return _bind(F.array_sort(events), swept)


@dataclass
class Model:
    """Fitted trees as (weight, tree), and a threshold for each kind; without trees nothing is added.

    A tree is a number, or (feature, limit, tree up to the limit, tree above).
    """

    trees: list[tuple[float, tuple | float]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin(self, f: Column) -> Column:
        """The trees' sum for an array of features, as nested conditions."""
        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * _branch(tree, f)
        return total


def _branch(tree: tuple | float, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    which, limit, low, high = tree
    return F.when(F.get(f, F.lit(which)) <= limit, _branch(low, f)).otherwise(_branch(high, f))


def _tree(node) -> tuple | float:
    """A fitted tree, read node by node from Spark's model; all features are continuous."""
    if not node.subtreeDepth():
        return float(node.prediction())
    return int(node.split().featureIndex()), float(node.split().threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _shares(counts: dict[str, int]) -> dict[str, float]:
    """The share of each kind's labelled candidates that the trees learn from: half, or SAMPLE dealt evenly; what a rare kind can't use goes to the others."""
    shares, left = {}, float(SAMPLE)
    for i, (kind, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        take = min(n / 2, left / (len(counts) - i))
        shares[kind], left = take / n, left - take
    return shares


def _pick(values: tuple[str, ...], seed: int) -> Column:
    """One of `values`, by a hash of the candidate."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("s", "key", F.lit(seed)), F.lit(len(values))) + 1).cast("int"))


def _look_alike(found: DataFrame) -> DataFrame:
    """Copies of positives with something of another kind of number before them, after them, or both; what, depends on hashes."""
    side = F.pmod(F.xxhash64("s", "key", F.lit(3)), F.lit(3))
    before = F.when(side != 1, F.concat(F.col("before"), _pick(LEADS, 1))).otherwise(F.col("before"))
    return found.where("label = 1").withColumns({"before": before, "after": F.when(side != 0, _pick(TAILS, 2)).otherwise(F.col("after")), "label": F.lit(0.0), "valid": F.lit(True)})


def _in_sentence(found: DataFrame) -> DataFrame:
    """Copies of positives with a sentence's signs behind them, a third of them in brackets."""
    opened = F.when(F.pmod(F.xxhash64("s", "key", F.lit(4)), F.lit(3)) == 0, F.concat(F.col("before"), F.lit("("))).otherwise(F.col("before"))
    return found.where("label = 1").withColumns({"before": opened, "after": _pick(STOPS, 5)})


def _taught(found: DataFrame) -> DataFrame:
    """kind, valid, f and label of labelled candidates, of each positive in a sentence, and of a look-alike of it."""
    both = found.unionByName(_in_sentence(found)).unionByName(_look_alike(found))
    return both.select("kind", "valid", _features(F.struct("kind", "s", "before", "after")).alias("f"), "label")


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Fit trees and thresholds to the candidates of all `docs`: trees to a sample of each kind, thresholds to all that the trees didn't see.

    Without candidates of both labels, as in an empty table, the model adds nothing. Thresholds are about candidates that pass their check, as no others are added.
    """
    body = docs.select(text, *[c for c in ("doc_id",) if c in docs.columns])
    seen = _detected(body, text).where(F.size("_more") > 0)
    # the key has doc_id, so that copies of a text are dealt to both parts
    doc = F.xxhash64("_body", *body.columns[1:])
    each = seen.select(F.explode(_swept(F.col("_base"), F.col("_more"))).alias("c"), doc.alias("doc")).select("c.*", "doc")
    found = cut(each.where(F.col("same") | ~F.col("valid") | (~F.col("over") & F.col("before").rlike(LEAD))).select("kind", "s", "before", "after", "valid", F.col("same").cast("double").alias("label"), F.xxhash64("doc", "start", "end", "kind").alias("key")))
    shares = _shares({r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()})
    if not shares:
        return Model()
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(int((1 << 20) * share))) for k, share in shares.items()])
    found = found.withColumn("learn", F.pmod("key", F.lit(1 << 20)) < limit)
    learn = cut(_taught(found.where("learn")).withColumns({name: F.get("f", F.lit(i)) for i, name in enumerate(FEATURES) if name != "kind"}).withColumn("kind", F.get("f", F.lit(0))))
    if learn.select("label").distinct().count() < 2:
        return Model()
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(learn).select("x", "label")
    gbt = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11, maxBins=32).fit(vectors)
    model = Model([(w, _tree(t._java_obj.rootNode())) for w, t in zip(gbt.treeWeights, gbt.trees)])
    # precision from each score on; as many rows as the trees have different sums
    scored = _taught(found.where("NOT learn")).where("valid").withColumn("score", F.round(model.margin(F.col("f")), 6)).groupBy("kind", "score").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("all")).collect()
    for kind in KINDS:
        good = every = 0
        for r in sorted((r for r in scored if r["kind"] == kind), key=lambda r: -r["score"]):
            good, every = good + r["good"], every + r["all"]
            if good >= PRECISION * every:
                model.thresholds[kind] = r["score"]
    return model


def _longest(spans: Column) -> Column:
    """Of each chain of overlapping spans of a kind the longest, of equal ones the first."""
    wide = 1 << 40
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct((_rank(x["kind"]) * wide + x["start"]).alias("at"), (_rank(x["kind"]) * wide + x["end"]).alias("till"), x.alias("x"))))

    def chains(k: Column) -> Column:
        def numbered(till: Column) -> Column:
            return _scan(F.transform(k, lambda x, i: F.when(F.get(till, i - 1) > x["at"], 0).otherwise(1)), "sum")

        def firsts(n: Column) -> Column:
            by_length = F.array_sort(F.transform(k, lambda x, i: F.struct(F.get(n, i).alias("chain"), (x["at"] - x["till"]).alias("less"), x["x"].alias("x"))))
            return _bind(by_length, lambda a: F.transform(F.filter(a, lambda x, i: F.coalesce(F.get(a, i - 1)["chain"] != x["chain"], F.lit(True))), lambda x: x["x"]))

        return _bind(_bind(_scan(F.transform(k, lambda x: x["till"]), "max"), numbered), firsts)

    return F.when(F.size(spans) < 2, spans).otherwise(_bind(keyed, chains))


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` with `base` and `spans`: arrays of kind, start, end (code points, end exclusive), and `places`: all spans by place, in bytes.

    base and spans are ordered by kind as in KINDS, then start, then end; spans has all of base and what the model adds: candidates that pass their check, score at their
    kind's threshold or above and overlap no base span, and of a chain of overlapping ones of a kind the longest. A null text has none. Columns of these three names in the
    input are replaced, all others stay; repeated rows are judged alike.
    """
    span = lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "from", "to")))

    def chosen(x: Column) -> Column:
        score = _bind(_features(x), lambda f: F.round(model.margin(f), 6))
        test = F.lit(False)
        for kind, least in model.thresholds.items():
            test = test | ((x["kind"] == kind) & (score >= least))
        return x["valid"] & ~x["over"] & test

    none = F.array().cast("array<struct<kind:string,start:int,end:int,from:int,to:int>>")
    return apart(docs, [text], lambda d: _selected(_detected(d, text), model, chosen, span, none))


def _selected(found: DataFrame, model: Model, chosen: Callable[[Column], Column], span: Callable[[Column], Column], none: Column) -> DataFrame:
    added = none
    if model.thresholds:
        some = F.transform(F.filter(_swept(F.col("_base"), F.filter("_more", lambda x: x["valid"])), chosen), span)
        added = F.when(F.exists("_more", lambda x: x["valid"]), some).otherwise(none)
    found = found.withColumn("_added", added).withColumn("_all", F.concat("_base", F.when(F.size("_added") > 0, _longest(F.col("_added"))).otherwise(none)))

    def ordered(spans: str) -> Column:
        keyed = F.array_sort(F.transform(spans, lambda x: F.struct(_rank(x["kind"]).alias("r"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
        return F.transform(keyed, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    places = F.array_sort(F.transform("_all", lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), x["kind"].alias("kind"))))
    return found.withColumns({"base": ordered("_base"), "spans": ordered("_all"), "places": places}).drop("_body", "_base", "_more", "_added", "_all")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """detect()'s rows with every span of the text replaced by its kind in angle brackets; of overlapping spans, the first one's.

    Adds nothing else; n_chars, if there, follows the text. Texts without spans, null ones too, stay as they are.
    """
    raw = F.col(text).cast("binary")

    def pieces(till: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            at = F.coalesce(F.get(till, i - 1), F.lit(0))
            between = F.substr(raw, at + 1, F.greatest(F.lit(0), x["from"] - at)).cast("string")
            return F.concat(between, F.when(x["from"] >= at, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(""))

        return F.concat(F.array_join(F.transform("places", piece), ""), F.substr(raw, F.element_at(till, -1) + 1).cast("string"))

    clean = _bind(_scan(F.transform("places", lambda x: x["to"]), "max"), pieces)
    out = found.withColumn(text, F.when(F.size("places") > 0, clean).otherwise(F.col(text)))
    return out.withColumn("n_chars", F.when(F.size("places") > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))) if "n_chars" in found.columns else out


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, the base spans by kind and their digest, all spans, n_added; nulls, repeats and long texts as in detect()."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, fit(docs))
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter("base", of(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"))
