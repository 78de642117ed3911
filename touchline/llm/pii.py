"""Personal data: base patterns, and boosted trees over further candidate spans.

Base spans are the leftmost non-overlapping matches of one pattern per kind that pass the
kind's check (IP parts at most 255, Luhn digits of cards, numbers of digits); they always
stay. High-recall generators propose overlapping spans besides: anything like an address,
a dotted quad or a long number. A candidate is right if a base span of its kind confirms it or
it passes its kind's check itself (an address once `(at)` and `(dot)` are undone, an
international number with 00 for +), wrong if it fails a check that decides or a base span of
another kind has its place, and otherwise unknown and not learned from. Boosted trees learn
from a bounded sample which candidates are right, seeing only their format and context, not
the checks; a threshold per kind, calibrated on candidates kept out of training, selects the
spans that are added where no base span is. Only candidates that pass their check are added:
numbers that pass by chance look and stand like others that fail, and stay below the threshold.

DataFrame functions and Spark ML (JVM) only. Each text is scanned once; what is kept of it
are the candidate matches with a little context. Offsets count code points: splitting a
text by a pattern gives the gaps between its matches, and running sums of gaps and matches
give their places. Patterns use possessive quantifiers and look-behind, so runs of any
length are scanned in linear time without recursion.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one
(a null or repeated doc_id does no harm); other columns are ignored; an empty table gives
an empty result; without candidates, or with only wrong ones, nothing is added; with only
right ones there is nothing to tell apart and all are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import stored, whole_text

#: Kinds in the order in which spans of equal start are listed.
KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: Fixed: the base patterns, in an equivalent form that never backtracks far.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{2,7}+",
    "phone": r"(?<![0-9])(?:\+|00)?[0-9]{1,4}+[\x20./-]?\(?[0-9]{2,4}+\)?(?:[\x20./-][0-9]{2,5}+){1,4}+",
}
CONTEXT = 24
MAX_TRAINING = 20_000
PRECISION = 0.99
#: Probabilities are rounded down to so many steps, which bounds the counts per kind.
STEPS = 10_000
TREES, DEPTH = 20, 3

FEATURES = [
    "is_email", "is_ip", "is_card", "is_phone", "length", "digits", "letters", "groups", "longest_group",
    "spaces", "dots", "hyphens", "brackets", "distinct", "left_letter", "right_letter", "left_digit",
    "right_digit", "left_quote", "contact_word", "number_word", "left_symbols",
]


def _found(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """The matches of a pattern in text order, with the length of the gap before each and the context."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.array(F.struct(matches.alias("m"), gaps.alias("g")))

    def spans(x: Column) -> Column:
        return F.transform(x["m"], lambda match, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(base).alias("base"),
            i.alias("place"),
            match.alias("match"),
            F.length(x["g"][i]).alias("gap"),
            F.substring(x["g"][i], -CONTEXT, CONTEXT).alias("left"),
            F.substring(x["g"][i + 1], 1, CONTEXT).alias("right"),
        ))

    return F.transform(both, spans)[0]


def scan(docs: DataFrame) -> DataFrame:
    """row_no, doc_id and the matches of all patterns, of every row. Store it: numbers are only
    stable once written."""
    found = [_found(F.col("text"), k, p, True) for k, p in BASE.items()]
    found += [_found(F.col("text"), k, p, False) for k, p in GENERATORS.items()]
    return docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", whole_text().alias("text")).select(
        "row_no", "doc_id", F.concat(*found).alias("found")
    )


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    def value(digit: Column, i: Column) -> Column:
        doubled = digit.cast("int") * F.when((F.length(digits) - i) % 2 == 0, 2).otherwise(1)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: Column, match: Column, digits: Column) -> Column:
    """Whether a base match passes its kind's check."""
    n = F.length(digits)
    small = F.forall(
        F.split(match, r"\."),
        lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3)
        & (F.coalesce(F.try_to_number(F.substring(F.ltrim(part, F.lit("0")), 1, 3), F.lit("999")), F.lit(0)) <= 255),
    )
    return (
        F.when(kind == KINDS.index("email"), True)
        .when(kind == KINDS.index("ip"), small)
        .when(kind == KINDS.index("card"), n.between(14, 19) & F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .otherwise(n.between(10, 15))
    )


def _valid(kind: Column, match: Column, digits: Column, right: Column) -> Column:
    """Whether a proposal passes its kind's check itself; null where the check cannot tell."""
    address = F.regexp_replace(F.regexp_replace(match, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    abroad = F.regexp_replace(match, "^00", "+")
    n = F.length(_digits(abroad))
    whole = ~right.rlike("^[0-9]")
    return (
        F.when(kind == KINDS.index("email"), F.when(
            address.rlike(f"^{BASE['email']}$") & ~right.rlike("^[A-Za-z0-9-]"), True
        ))
        .when(kind == KINDS.index("phone"), F.when(~whole | ~n.between(10, 15), False).when(abroad.startswith("+"), True))
        .otherwise(whole & _passes(kind, match, digits))
    )


def candidates(scanned: DataFrame) -> DataFrame:
    """One row per match: row_no, kind, base, match, left, right, start, end, passes."""
    order = Window.partitionBy("row_no", "base", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = scanned.select("row_no", F.explode("found").alias("f")).select("row_no", "f.*")
    size = F.length("match")
    digits = _digits(F.col("match"))
    return rows.select(
        "row_no", "kind", "base", "match", "left", "right",
        F.sum(F.col("gap") + size).over(order).alias("end"), size.alias("size"), digits.alias("digits"),
    ).select(
        "row_no", "kind", "base", "match", "left", "right", "digits",
        (F.col("end") - F.col("size")).alias("start"), "end",
        F.when(~F.col("base"), _valid(F.col("kind"), F.col("match"), F.col("digits"), F.col("right"))).alias("valid"),
    ).where(~F.col("base") | _passes(F.col("kind"), F.col("match"), F.col("digits")))


def _count(text: str, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", "")).cast("double")


def with_features(spans: DataFrame) -> DataFrame:
    """Format and context of each span as numbers; the base checks are not among them."""
    groups = F.split(F.regexp_replace("match", "^[^0-9A-Za-z]+", ""), "[^0-9A-Za-z]+")
    low = F.lower(F.concat("left", F.lit(" "), F.col("right")))
    yes = {f"is_{k}": F.col("kind") == i for i, k in enumerate(KINDS)} | {
        "left_letter": F.col("left").rlike("[A-Za-z]$"),
        "right_letter": F.col("right").rlike("^[A-Za-z]"),
        "left_digit": F.col("left").rlike("[0-9]$"),
        "right_digit": F.col("right").rlike("^[0-9]"),
        "left_quote": F.col("left").rlike("[\"'=:]\\x20?$"),
        "contact_word": low.rlike("tel|phone|call|fax|mail|contact|mobil|reach|write"),
        "number_word": low.rlike("card|visa|account|order|invoice|isbn|version|serial|no\\.|id"),
    }
    return spans.withColumns({
        "length": F.length("match").cast("double"),
        "digits": F.length("digits").cast("double"),
        "letters": _count("match", "A-Za-z"),
        "groups": F.size(groups).cast("double"),
        "longest_group": F.array_max(F.transform(groups, F.length)).cast("double"),
        "spaces": _count("match", r"\x20"),
        "dots": _count("match", "."),
        "hyphens": _count("match", "-"),
        "brackets": _count("match", r"()\[\]"),
        "distinct": F.size(F.array_distinct(F.split("match", ""))).cast("double"),
        "left_symbols": _count("left", r"#*$%&|<>"),
        **{name: F.coalesce(flag.cast("double"), F.lit(0.0)) for name, flag in yes.items()},
    })


def confirmed(proposals: DataFrame, base: DataFrame) -> DataFrame:
    """`proposals` with `touches` (a base span of any kind overlaps) and `known`: 1 where a base span
    of the kind covers most of it or it is valid itself, 0 where it is not valid or only touched,
    null where nothing tells. That no base span touches it makes no proposal wrong."""
    hits = base.select(
        "row_no", F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("kind").alias("b_kind"),
        (F.floor(F.col("start") / 64)).alias("from"), (F.floor((F.col("end") - 1) / 64)).alias("to"),
    ).withColumn("cell", F.explode(F.sequence("from", "to"))).drop("from", "to")
    cells = proposals.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64)))
    )
    shared = F.least("end", "b_end") - F.greatest("start", "b_start")
    own = ["row_no", "kind", "start", "end"]
    marks = cells.join(hits, ["row_no", "cell"]).where(shared > 0).groupBy(*own).agg(
        F.max(((F.col("kind") == F.col("b_kind")) & (2 * shared > F.col("end") - F.col("start"))).cast("int")).alias("known")
    )
    return proposals.join(marks, own, "left").withColumns({
        "touches": F.col("known").isNotNull(),
        "known": F.when((F.col("known") == 1) | F.col("valid"), 1.0).when(F.col("known").isNotNull() | ~F.col("valid"), 0.0),
    })


def added(proposals: DataFrame) -> DataFrame | None:
    """Valid proposals that the trees select and no base span touches, or None when there are none to
    learn from. Training uses the MAX_TRAINING known proposals of smallest hash, two of three by
    another hash; the thresholds are found from all of the third that is kept out."""
    spans = ["row_no", "kind", "start", "end"]
    free = proposals.where(~F.col("touches") & F.col("valid"))
    known = proposals.where(F.col("known").isNotNull())
    calibrating = F.xxhash64("start", "row_no") % 3 == 0
    train = stored(
        known.where(~calibrating)
        .orderBy(F.xxhash64("row_no", "kind", "start"), "row_no", "kind", "start").limit(MAX_TRAINING),
        "pii-sample",
    ).coalesce(1)
    kept_out = known.where(calibrating)
    outcomes = {r["known"] for r in train.select("known").distinct().collect()}
    if len(outcomes) < 2:
        return free.select(*spans) if outcomes == {1.0} and proposals.where("known = 0").isEmpty() else None
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="known", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=1)
    model = trees.fit(assemble.transform(train))

    def probability(rows: DataFrame) -> DataFrame:
        p = vector_to_array("probability")[1]
        return model.transform(assemble.transform(rows)).withColumn("p", F.floor(p * STEPS) / STEPS)

    # The lowest threshold at and above which the kept out proposals are right often enough.
    counts = probability(kept_out).groupBy("kind", "p").agg(F.count("known").alias("n"), F.sum("known").alias("known"))
    down = Window.partitionBy("kind").orderBy(F.col("p").desc()).rangeBetween(Window.unboundedPreceding, 0)
    levels = counts.select("kind", "p", (F.sum("known").over(down) / F.sum("n").over(down)).alias("right"))
    thresholds = {
        r["kind"]: r["threshold"]
        for r in levels.where(F.col("right") >= PRECISION).groupBy("kind").agg(F.min("p").alias("threshold")).collect()
    }
    if not thresholds:
        return None
    passing = reduce(lambda a, b: a | b, [
        (F.col("kind") == kind) & (F.col("p") >= max(threshold, 0.5)) for kind, threshold in thresholds.items()
    ])
    return probability(free).where(passing).select(*spans)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    scanned = stored(scan(docs), "pii-scan")
    found = stored(candidates(scanned), "pii-candidates")
    base = found.where("base").select("row_no", "kind", "start", "end")
    proposals = stored(
        with_features(confirmed(found.where(~F.col("base")), base)).select(
            "row_no", "kind", "start", "end", "valid", "known", "touches", *FEATURES
        ),
        "pii-proposals",
    )
    more = added(proposals)
    spans = base.withColumn("base", F.lit(True))
    if more is not None:
        spans = spans.unionByName(more.withColumn("base", F.lit(False)))
    span = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    per_row = spans.groupBy("row_no").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.sort_array(F.collect_list(span)).alias("all"),
    )
    nothing = F.lit("")
    return scanned.select("row_no", "doc_id").join(per_row, "row_no", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(_listed(F.col("base")), nothing).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("all")), nothing).alias("spans"),
    )
