"""URL filter: rules first, then the reputation of the host by empirical Bayes.

Labelled page outcomes (good or bad) are counted per host, registered domain (the last two
labels of the host) and suffix (the last label). Each level's rate is shrunk towards the
level above by a beta-binomial prior: suffix towards all pages, domain towards its suffix,
host towards its domain. How strongly is estimated for each level from the spread of the
observed rates (moments of the overdispersion). A host is blocked when the upper posterior
bound of its good rate is below `min_good`. A host without labelled pages has the host-level
posterior of no pages: its domain's rate (its suffix's if the domain has none either) with the
weight of the host prior, so a wide bound.

Defined results: null urls and urls without `://` have empty host and path, and share the
reputation of the empty host; a page with several labels is good only if all are; pages
without labels count for nothing; with no labels at all every host is allowed; repeated
rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stored


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed rules of the registered query.
RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]
MIN_GOOD = 0.7
BOUND_Z = 1.645
#: Bounds of the estimated correlation of pages of one unit; the prior counts as 1/rho - 1 pages.
MIN_RHO, MAX_RHO = 0.005, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(
        F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(text, pattern, 2)


def longest_rule(rules: list[Rule], value) -> Column:
    """`value(rule)` of the longest rule that fits columns host and path, else null."""
    def fits(rule: Rule) -> Column:
        host = F.col("host")
        return ((host == rule.host) | host.endswith("." + rule.host)) & F.col("path").startswith(rule.path)

    ordered = sorted(rules, key=lambda r: len(r.name), reverse=True)
    return reduce(
        lambda found, rule: found.when(fits(rule), F.lit(value(rule))), ordered[1:],
        F.when(fits(ordered[0]), F.lit(value(ordered[0]))),
    ) if ordered else F.lit(None).cast("string")


def registered_domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, good (0 or 1) of each labelled page. A page is good if it is of quality and not toxic."""
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.min(F.when((F.col("quality") == 1) & ~(F.coalesce("toxic", F.lit(0)) == 1), 1).otherwise(0)).alias("good")
    )
    hosts = pages.select("page_id", host_and_path(F.col("url"))[0].alias("host"))
    return hosts.join(marks, "page_id").select("host", "good")


def _shrunk(units: DataFrame, prior: str) -> DataFrame:
    """`units` (n, good, column `prior`) with `strength`, the prior's weight in pages."""
    m = F.least(F.greatest(F.col(prior), F.lit(1e-3)), F.lit(1 - 1e-3))
    spread = F.sum((F.col("good") - F.col("n") * m) ** 2 / (F.col("n") * m * (1 - m)))
    rho = units.agg(
        F.least(
            F.greatest((spread - F.count(F.lit(1))) / F.greatest(F.sum(F.col("n") - 1), F.lit(1)), F.lit(MIN_RHO)),
            F.lit(MAX_RHO),
        ).alias("rho")
    )
    return units.withColumn("strength", 1 / F.coalesce(rho.scalar(), F.lit(MAX_RHO)) - 1)


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """level, unit, mean, upper: the posterior of every host with a labelled page, and, as `level`
    domain and suffix, of a host without any under every domain and suffix."""
    counts = stored(
        outcomes.groupBy("host").agg(F.count("good").alias("n"), F.sum("good").alias("good")), "host-outcomes"
    )
    hosts = counts.select("*", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"))
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*sums)
    overall = hosts.agg((F.sum("good") / F.sum("n")).alias("rate"))

    def posterior(units: DataFrame, prior: str, name: str) -> DataFrame:
        alpha = F.col("strength") * F.col(prior) + F.col("good")
        beta = F.col("strength") * (1 - F.col(prior)) + F.col("n") - F.col("good")
        return _shrunk(units, prior).withColumns({f"{name}_alpha": alpha, f"{name}_beta": beta}).withColumn(
            f"{name}_rate", F.col(f"{name}_alpha") / (F.col(f"{name}_alpha") + F.col(f"{name}_beta"))
        )

    suffixes = posterior(suffixes.withColumn("prior", overall.scalar()), "prior", "suffix")
    suffixes = stored(suffixes.select("suffix", "suffix_rate", "suffix_alpha", "suffix_beta"), "suffix-rates")
    domains = posterior(domains.join(suffixes, "suffix"), "suffix_rate", "domain")
    domains = stored(domains.select("domain", "domain_rate", "domain_alpha", "domain_beta"), "domain-rates")
    hosts = stored(posterior(hosts.join(domains, "domain"), "domain_rate", "host"), "host-rates")
    strength = hosts.agg(F.max("strength").alias("strength")).scalar()

    def unlabelled(units: DataFrame, name: str) -> DataFrame:
        """The posterior of a host of no pages; a domain of no pages has its suffix's rate."""
        return units.select(
            name, (strength * F.col(f"{name}_rate")).alias(f"{name}_alpha"),
            (strength * (1 - F.col(f"{name}_rate"))).alias(f"{name}_beta"),
        )

    def level(units: DataFrame, name: str) -> DataFrame:
        a, b = F.col(f"{name}_alpha"), F.col(f"{name}_beta")
        mean = a / (a + b)
        deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
        return units.select(
            F.lit(name).alias("level"), F.col(name).alias("unit"), mean.alias("mean"),
            F.least(mean + BOUND_Z * deviation, F.lit(1.0)).alias("upper"),
        )

    return reduce(
        DataFrame.unionByName,
        [level(hosts, "host"), level(unlabelled(domains, "domain"), "domain"), level(unlabelled(suffixes, "suffix"), "suffix")],
    )


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule] = RULES, min_good: float = MIN_GOOD) -> DataFrame:
    """page_id, host, path, rule, verdict and the posterior (host_rate, host_upper) of each page."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    reputation = stored(host_reputation(page_outcomes(pages, labels)), "reputation")
    known = parsed.select("host").distinct().select(
        "host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix")
    )
    for name in ("host", "domain", "suffix"):
        units = reputation.where(F.col("level") == name).select(
            F.col("unit").alias(name), F.col("mean").alias(f"{name}_mean"), F.col("upper").alias(f"{name}_upper")
        )
        known = known.join(units, name, "left")
    verdicts = stored(
        known.select(
            "host",
            F.coalesce("host_mean", "domain_mean", "suffix_mean").alias("host_rate"),
            F.coalesce("host_upper", "domain_upper", "suffix_upper").alias("host_upper"),
        ),
        "host-verdicts",
    )
    by_reputation = F.when(F.col("host_upper") < min_good, "block").otherwise("allow")
    return parsed.join(verdicts, "host", "left").select(
        "page_id", "host", "path",
        longest_rule(rules, lambda r: r.name).alias("rule"),
        F.coalesce(longest_rule(rules, lambda r: r.verdict), by_reputation).alias("verdict"),
        "host_rate", "host_upper",
    )
