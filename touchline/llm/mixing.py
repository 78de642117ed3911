"""Mixing sources to target weights by soft membership. DataFrame functions only.

Documents that occur in the labelled table teach a classifier (Gaussian naive Bayes on letter
shares, from one aggregation over all of them) which domain a text belongs to; every
document gets posteriors over the domains, rounded to multiples of 1/`GRID`. With w tokens
and posteriors p, a document at rate r adds r * w * p[d] expected tokens to domain d. The
rates minimise sum over d of (expected[d] - target[d])^2 / (2 * present[d]) subject to
r >= floor, by projected gradient descent in the metric of the documents' tokens: step 1 is
then never too long, and documents of equal posteriors move alike, so every iteration is
one aggregation over the distinct posteriors (bounded by the grid, whatever the corpus) and
the driver sees one number per domain. A document's rate is its walk along those numbers.

Targets are shares of a total; by default the smallest total that leaves no domain short of
what it has, so scarce domains are repeated and none is thinned. Rate r means floor(r)
copies and one more with the rest as probability, decided by a hash of the identifier.

Defined results: null and empty texts have no tokens and the prior's posteriors; documents
of domains without a target are placed by their text like all others; without labelled
documents all domains are equally likely; without tokens all rates are 1 (or the floor);
repeated rows get equal rates; other columns pass through `mix` unchanged; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import SPACES, let, stored, total, whole_text

#: Target share of each domain's tokens.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
DOMAIN = "lang"
FLOOR = 1.0
GRID = 32
MAX_ITERATIONS = 60
TOLERANCE = 1e-5
#: Copies of one document that one row of a task makes; more are made in parts by several tasks.
COPIES_AT_ONCE = 1000

#: Letters, lower and upper case, whose shares of a text are the classifier's features.
LETTERS = {
    "a": "aA", "c": "cC", "d": "dD", "e": "eE", "h": "hH", "i": "iI", "n": "nN", "o": "oO", "t": "tT", "u": "uU",
    "z": "zZ", "umlaut": "äöüßÄÖÜ", "grave": "éèêçàÉÈÊÇÀ", "tilde": "ñóíáúÑÓÍÁÚ",
}
#: Added to every variance, in squared shares, so that a class without spread stays finite.
LEAST_VARIANCE = 1e-4


def letter_shares(text: Column) -> dict[str, Column]:
    size = F.greatest(F.length(text), F.lit(1))
    return {name: F.length(F.regexp_replace(text, f"[^{members}]+", "")) / size for name, members in LETTERS.items()}


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACES + "+", -1), "")).cast("long")


def features(text: Column) -> Column:
    """tokens and `x_<letter>` of a text."""
    return F.struct(n_words(text).alias("tokens"), *[x.alias(f"x_{name}") for name, x in letter_shares(text).items()])


def train(measured: DataFrame, labels: DataFrame, domains: list[str]) -> dict[str, tuple[float, list[float], list[float]]]:
    """Log prior, means and variances of each domain from its documents in the labelled table."""
    known = labels.select("doc_id").distinct()
    names = [f"x_{name}" for name in LETTERS]
    rows = (
        measured.where(F.col("domain").isin(domains) & (F.col("x.tokens") > 0)).join(known, "doc_id", "left_semi")
        .groupBy("domain")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x.{f}").alias(f"{f}_mean") for f in names],
             *[F.var_pop(f"x.{f}").alias(f"{f}_var") for f in names])
        .collect()  # a row per domain that has a target
    )
    n = sum(r["n"] for r in rows)
    return {
        r["domain"]: (math.log(r["n"] / n), [r[f"{f}_mean"] for f in names],
                      [r[f"{f}_var"] + LEAST_VARIANCE for f in names])
        for r in rows
    }


def posteriors(x: Column, model: dict, domains: list[str]) -> Column:
    """Struct of `q_<domain>` for features x: posteriors as whole multiples of 1 / GRID."""
    def named(values: list[Column]) -> Column:
        return F.struct(*[v.alias(f"q_{d}") for d, v in zip(domains, values)])

    if not model:
        return named([F.lit(GRID) for _ in domains])
    scores = []
    for d in domains:
        if d not in model:
            scores.append(F.lit(float("-inf")))
            continue
        prior, means, variances = model[d]
        pieces = [
            -((x[f"x_{name}"] - m) ** 2) / (2 * v) - 0.5 * math.log(v) for name, m, v in zip(LETTERS, means, variances)
        ]
        scores.append(F.when(x["tokens"] > 0, total(pieces) + prior).otherwise(prior))

    def rounded(odds: Column) -> Column:
        whole = total([odds[i] for i in range(len(domains))])
        return named([F.round(odds[i] / whole * GRID).cast("int") for i in range(len(domains))])

    return let(F.array(*scores), lambda s: let(
        F.array_max(s), lambda best: let(F.transform(s, lambda v: F.exp(v - best)), rounded)
    ))


def shares(q: Column, domains: list[str]) -> list[Column]:
    whole = total([q[f"q_{d}"] for d in domains])
    return [q[f"q_{d}"] / whole for d in domains]


def rate(q: Column, steps: list[list[float]], domains: list[str], floor: float) -> Column:
    """A document's rate: from 1, along each step weighted by its posteriors, never below `floor`."""
    start = F.lit(max(1.0, floor))
    if not steps:
        return start
    walk = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])
    return F.aggregate(walk, start, lambda r, step: F.greatest(
        F.lit(float(floor)), r - total([p * step[i] for i, p in enumerate(shares(q, domains))])
    ))


def fit(
    placed: DataFrame, targets: dict[str, float], floor: float = 0.0, tokens: float | None = None
) -> list[list[float]]:
    """The steps of the descent: for each iteration, (expected - target) / present of each domain."""
    domains = list(targets)
    alike = stored(placed.groupBy("q").agg(F.sum("x.tokens").alias("tokens")), "posteriors")
    q = F.col("q")

    def expected(r: Column) -> list[float]:
        row = alike.agg(*[F.sum(F.col("tokens") * p * r).alias(d) for d, p in zip(domains, shares(q, domains))]).first()
        return [row[d] or 0.0 for d in domains]

    present = expected(F.lit(1.0))
    if not sum(present):
        return []
    weights = [w / sum(targets.values()) for w in targets.values()]
    wanted = tokens or max(s / w for s, w in zip(present, weights) if w > 0)
    goal = [w * wanted for w in weights]
    steps: list[list[float]] = []
    for _ in range(MAX_ITERATIONS):
        now = expected(rate(q, steps, domains, floor))
        if all(abs(e - g) <= TOLERANCE * wanted for e, g in zip(now, goal)):
            break
        steps.append([(e - g) / s if s else 0.0 for e, g, s in zip(now, goal, present)])
    else:
        now = expected(rate(q, steps, domains, floor))
        off = {d: round((e - g) / wanted, 6) for d, e, g in zip(domains, now, goal) if abs(e - g) > TOLERANCE * wanted}
        if off:
            warnings.warn(f"targets missed after {MAX_ITERATIONS} steps, as shares of all tokens by {off}", stacklevel=2)
    return steps


def decision(
    doc_id: Column, x: Column, model: dict, steps: list[list[float]], domains: list[str], floor: float
) -> Column:
    """Struct of tokens, p_<domain>, rate and copies of a document with features x."""
    chance = F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("mix")), F.lit(1 << 30)) / (1 << 30)

    def decided(x: Column, q: Column, r: Column) -> Column:
        more = (chance < r - F.floor(r)).cast("long")
        return F.struct(
            x["tokens"].alias("tokens"), *[p.alias(f"p_{d}") for d, p in zip(domains, shares(q, domains))],
            r.alias("rate"), (F.floor(r) + more).cast("long").alias("copies"),
        )

    return let(x, lambda x: let(
        posteriors(x, model, domains), lambda q: let(rate(q, steps, domains, floor), lambda r: decided(x, q, r))
    ))


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str, floor: float):
    """Features of all rows, the classifier, and the steps to the rates."""
    measured = stored(
        docs.select("doc_id", F.col(domain).cast("string").alias("domain"), features(whole_text()).alias("x")),
        "mix-features",
    )
    model = train(measured, labels, list(targets))
    placed = measured.select("x", posteriors(F.col("x"), model, list(targets)).alias("q"))
    return measured, model, fit(placed, targets, floor)


def plan(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: str = DOMAIN, floor: float = FLOOR
) -> DataFrame:
    """Per row: doc_id, tokens, posterior of each domain (p_<domain>), rate, copies."""
    measured, model, steps = _fitted(docs, labels, targets, domain, floor)
    decided = decision(F.col("doc_id"), F.col("x"), model, steps, list(targets), floor)
    return measured.select("doc_id", decided.alias("d")).select("doc_id", "d.*")


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: str = DOMAIN, floor: float = FLOOR,
    at_once: int = COPIES_AT_ONCE,
) -> DataFrame:
    """The rows of `docs`, each as often as its copies say, all columns as they were.

    Texts are read twice, to fit and to mix. Only a document wanted more than `at_once` times is
    shuffled: its copies are made in parts of that many, which are dealt out.
    """
    measured, model, steps = _fitted(docs, labels, targets, domain, floor)

    def copies(x: Column) -> Column:
        return decision(F.col("doc_id"), x, model, steps, list(targets), floor)["copies"]

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        # A sequence from 1 to 0 would count down.
        several = let(times, lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)))
        return rows.select("*", F.explode(several).alias("part"))

    row, own = F.struct("*").alias("row"), copies(features(whole_text()))
    few = repeated(docs.select(row, let(own, lambda n: F.when(n <= at_once, n)).alias("copies")), F.col("copies"))
    # An aggregate, as a search for a first row would look at one partition after the other.
    most = measured.agg(F.max(copies(F.col("x")))).first()[0]
    if (most or 0) <= at_once:
        return few.select("row.*")
    many = docs.select(row, own.alias("copies")).where(F.col("copies") > at_once)
    parts = repeated(many, F.ceil(F.col("copies") / at_once)).repartition("row.doc_id", "part")
    left = F.least(F.lit(at_once).cast("long"), F.col("copies") - (F.col("part") - 1) * at_once)
    return few.select("row.*").unionByName(repeated(parts.select("row", left.alias("copies")), F.col("copies")).select("row.*"))
