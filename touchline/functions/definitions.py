"""Metrics from written definitions: formulas by name, computed in the order they depend on each other.

A definition file names metrics, their formulas, groups and levels. A formula is arithmetic over
other metrics ("(spend / impressions) * 1000"); one that counts or sums a source
("COUNT(DISTINCT user_id)", "SUM(attribution_credit) by model") is a base metric, a column that
the mart or the credit brings along. Formulas become Spark expressions in which a division
by nothing gives 0; percentages are 0 to 100, as such files write them.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import ratio

_COUNTED = re.compile(r"\s*(COUNT|SUM|AVG|MIN|MAX)\s*\(", re.IGNORECASE)


def _expression(node: ast.expr, formula: str) -> Column:
    if isinstance(node, ast.Name):
        return F.col(node.id)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return F.lit(node.value)
    if isinstance(node, ast.BinOp):
        left, right = _expression(node.left, formula), _expression(node.right, formula)
        if isinstance(node.op, ast.Div):
            return ratio(left, right)
        if isinstance(node.op, (ast.Add, ast.Sub, ast.Mult)):
            return {ast.Add: left + right, ast.Sub: left - right, ast.Mult: left * right}[type(node.op)]
    raise ValueError(f"formula {formula!r}: only + - * / over metrics and numbers are supported")


@dataclass(frozen=True)
class Definitions:
    """Formulas of derived metrics, names of base metrics, and groups of either."""

    formulas: Mapping[str, str]
    base: frozenset[str]
    groups: Mapping[str, tuple[str, ...]]
    benchmarks: Mapping[str, str]

    @classmethod
    def from_config(cls, config: Mapping) -> Definitions:
        """From the sections `metrics`, `metric_groups` and `calculation_order`, checked against each other."""
        metrics = config.get("metrics", {})
        formulas = {n: m["formula"] for n, m in metrics.items() if not _COUNTED.match(m["formula"])}
        found = cls(
            formulas, frozenset(metrics) - frozenset(formulas),
            {g: tuple(names) for g, names in config.get("metric_groups", {}).items()},
            {n: m["benchmark"] for n, m in metrics.items() if "benchmark" in m},
        )
        known = set(metrics)
        unknown = {n for names in found.groups.values() for n in names} - known
        if unknown:
            raise ValueError(f"groups name unknown metrics: {sorted(unknown)}")
        place = {n: level for level, names in config.get("calculation_order", {}).items() for n in names}
        for name in found.order():
            for needed in found.needs(name) & set(formulas):
                if place.get(name, 0) < place.get(needed, 0):
                    raise ValueError(f"{name} is calculated before {needed}, which its formula needs")
        return found

    def _parsed(self, name: str) -> ast.expr:
        try:
            return ast.parse(self.formulas[name].strip(), mode="eval").body
        except SyntaxError as e:
            raise ValueError(f"formula {self.formulas[name]!r} of {name} cannot be read") from e

    def needs(self, name: str) -> set[str]:
        """Names that a metric's formula mentions."""
        if name not in self.formulas:
            return set()
        return {n.id for n in ast.walk(self._parsed(name)) if isinstance(n, ast.Name)}

    def order(self, wanted: Iterable[str] | None = None) -> list[str]:
        """Derived metrics in an order in which each comes after those it needs."""
        open_names, graph = list(self.formulas if wanted is None else wanted), {}
        while open_names:
            name = open_names.pop()
            if name not in graph:
                graph[name] = self.needs(name)
                open_names += graph[name]
        try:
            return [n for n in TopologicalSorter(graph).static_order() if n in self.formulas]
        except CycleError as e:
            raise ValueError(f"formulas need each other: {' -> '.join(e.args[1])}") from e

    def add(self, rows: DataFrame, wanted: Iterable[str]) -> DataFrame:
        """Append metrics and whatever they need; columns that are there already are used as they are."""
        wanted = list(wanted)
        unknown = [n for n in wanted if n not in self.formulas and n not in self.base]
        if unknown:
            raise KeyError(f"unknown metrics: {unknown}")
        have = set(rows.columns)
        order = [n for n in self.order(wanted) if n not in have]
        expressions = {n: _expression(self._parsed(n), self.formulas[n]) for n in order}
        made = have | set(order)
        missing = sorted({n for name in order for n in self.needs(name)}.union(wanted) - made)
        if missing:
            raise ValueError(f"base metrics are not among the columns: {missing}")
        for name, expression in expressions.items():
            rows = rows.withColumn(name, expression)
        return rows

    def of_group(self, rows: DataFrame, group: str) -> DataFrame:
        """Append the metrics of a group."""
        if group not in self.groups:
            raise KeyError(f"unknown group {group!r}, choose from {sorted(self.groups)}")
        return self.add(rows, self.groups[group])

    def long(self, rows: DataFrame, keys: Iterable[str]) -> DataFrame:
        """keys, metric_group, metric, value: all groups, a row per metric."""
        keys = list(keys)
        for group in self.groups:
            rows = self.of_group(rows, group)
        entries = F.array(*[
            F.struct(F.lit(g).alias("metric_group"), F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
            for g, names in self.groups.items() for n in names
        ])
        return rows.select(*keys, F.explode(entries).alias("_m")).select(*keys, "_m.*")


# The definitions users have in their files.
DEFAULT = {
    "metrics": {
        "impressions": {"formula": "COUNT(impression_id)"},
        "clicks": {"formula": "COUNT(click_id)"},
        "conversions": {"formula": "COUNT(conversion_id)"},
        "spend": {"formula": "SUM(impression_cost)"},
        "revenue": {"formula": "SUM(conversion_value_usd)"},
        "ctr": {"formula": "clicks / impressions * 100", "benchmark": ">= 1.5%"},
        "cpm": {"formula": "(spend / impressions) * 1000"},
        "cpc": {"formula": "spend / clicks"},
        "cvr": {"formula": "conversions / clicks * 100", "benchmark": ">= 3%"},
        "cpa": {"formula": "spend / conversions", "benchmark": "<= $50"},
        "roas": {"formula": "revenue / spend", "benchmark": ">= 4.0x"},
        "aov": {"formula": "revenue / conversions"},
        "fill_rate": {
            "formula": "served_impressions / (served_impressions + unfilled_requests) * 100", "benchmark": ">= 95%",
        },
        "frequency": {"formula": "impressions / unique_users"},
        "attributed_revenue": {"formula": "SUM(attribution_credit) by model"},
        "unique_users": {"formula": "COUNT(DISTINCT user_id)"},
        "unique_converters": {"formula": "COUNT(DISTINCT user_id)"},
    },
    "metric_groups": {
        "efficiency_metrics": ["cpm", "cpc", "cpa"],
        "engagement_metrics": ["ctr", "cvr", "frequency"],
        "roi_metrics": ["roas", "aov", "revenue"],
        "reach_metrics": ["impressions", "unique_users", "frequency"],
        "attribution_metrics": ["attributed_revenue"],
    },
    "calculation_order": {
        1: ["impressions", "clicks", "conversions", "spend", "revenue", "unique_users", "unique_converters"],
        2: ["ctr", "cvr", "cpm", "cpc", "fill_rate", "frequency", "aov"],
        3: ["roas", "cpa"],
        4: ["attributed_revenue"],
    },
}
# End of fixed values.
