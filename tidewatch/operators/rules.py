"""Declarative rules over row fields, turned into one Spark column per rule.

A rule is JSON: ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": ...}`` or a comparison
``{"field", "op", "value"}``. A missing field makes a comparison unknown, and a rule fires only
when it is true: with missing held as NULL that is exactly SQL's three-valued logic, so a rule is
a plain boolean column that Catalyst can push down and generate code for.
"""

from __future__ import annotations

import functools
import json
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Size limits of a rule.
MAX_DEPTH, MAX_NODES, MAX_LIST = 16, 256, 1000

# The operators of a rule.
_COMPARE = {
    "eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge,
    "lt": operator.lt, "lte": operator.le,
}
_ORDERING = ("gt", "gte", "lt", "lte", "between")
_LISTED = ("in", "not_in")
_NULL_TESTS = ("is_null", "is_not_null")
_OPERATORS = (*_COMPARE, *_LISTED, "between", *_NULL_TESTS)


class InvalidRule(ValueError):
    """Every problem found in a rule, each with the path to it."""

    def __init__(self, problems: list[tuple[str, str]]):
        super().__init__("; ".join(f"{path}: {what}" for path, what in problems))
        self.problems = problems


@dataclass(frozen=True)
class Rule:
    """A named rule; ``override`` is the tier it raises a payment to, if any."""

    name: str
    expression: dict
    override: str | None = None

    @staticmethod
    def parse(name: str, text: str, override: str | None = None) -> "Rule":
        return Rule(name, json.loads(text), override)


@dataclass
class _Check:
    """Walks an expression against a schema, collecting problems."""

    numeric: dict[str, bool]
    problems: list[tuple[str, str]] = field(default_factory=list)
    nodes: int = 0

    def note(self, path: str, what: str) -> None:
        self.problems.append((path, what))

    def walk(self, node, path: str, depth: int) -> None:
        self.nodes += 1
        if depth > MAX_DEPTH:
            return self.note(path, "too many levels")
        if not isinstance(node, dict):
            return self.note(path, "expected an object")
        logical = [k for k in ("all", "any", "not") if k in node]
        if not logical:
            return self.comparison(node, path)
        if len(node) != 1:
            return self.note(path, "all, any and not stand alone in their object")
        name = logical[0]
        if name == "not":
            return self.walk(node["not"], f"{path}.not", depth + 1)
        if not isinstance(node[name], list) or not node[name]:
            return self.note(f"{path}.{name}", "expected a list of conditions, at least one")
        for i, child in enumerate(node[name]):
            self.walk(child, f"{path}.{name}[{i}]", depth + 1)

    def comparison(self, node: dict, path: str) -> None:
        for name in sorted(set(node) - {"field", "op", "value"}):
            self.note(f"{path}.{name}", "unexpected member")
        name, op, value = node.get("field"), node.get("op"), node.get("value")
        if name not in self.numeric:
            self.note(f"{path}.field", "no such column")
        if op not in _OPERATORS:
            self.note(f"{path}.op", "no such operator")
        if name in self.numeric and op in _OPERATORS:
            self.operand(self.numeric[name], op, value, f"{path}.value")

    def operand(self, numeric: bool, op: str, value, path: str) -> None:
        if op in _ORDERING and not numeric:
            return self.note(path, f"{op} compares numbers only")
        if op in _NULL_TESTS:
            if value is not None:
                self.note(path, f"{op} stands without a value")
        elif op in _LISTED:
            if not isinstance(value, list) or not 1 <= len(value) <= MAX_LIST:
                return self.note(path, f"expected a list with 1 to {MAX_LIST} entries")
            for i, item in enumerate(value):
                self.scalar(numeric, item, f"{path}[{i}]")
        elif op == "between":
            if not isinstance(value, list) or len(value) != 2:
                return self.note(path, "expected two numbers")
            before = len(self.problems)
            for i, item in enumerate(value):
                self.scalar(True, item, f"{path}[{i}]")
            if len(self.problems) == before and value[0] > value[1]:
                self.note(path, "bounds are the wrong way round")
        else:
            self.scalar(numeric, value, path)

    def scalar(self, numeric: bool, value, path: str) -> None:
        is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if numeric and not is_number:
            self.note(path, "expected a number")
        if not numeric and not isinstance(value, str):
            self.note(path, "expected text")


def problems(rule: Rule, schema: T.StructType) -> list[tuple[str, str]]:
    """Everything wrong with a rule for a table of this schema; empty when it may be compiled."""
    numeric = {
        f.name: isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in schema.fields
    }
    check = _Check(numeric)
    check.walk(rule.expression, "expression", 1)
    if check.nodes > MAX_NODES:
        check.note("expression", f"more than {MAX_NODES} conditions")
    return check.problems


def _column(name: str, schema: T.StructType) -> Column:
    c = F.col(name)
    return c.cast("int") if isinstance(schema[name].dataType, T.BooleanType) else c


def _condition(node: dict, schema: T.StructType) -> Column:
    if "all" in node:
        return functools.reduce(operator.and_, [_condition(n, schema) for n in node["all"]])
    if "any" in node:
        return functools.reduce(operator.or_, [_condition(n, schema) for n in node["any"]])
    if "not" in node:
        return ~_condition(node["not"], schema)
    c, op, value = _column(node["field"], schema), node["op"], node.get("value")
    if op in _COMPARE:
        return _COMPARE[op](c, F.lit(value))
    if op in _LISTED:
        return c.isin(value) if op == "in" else ~c.isin(value)
    if op == "between":
        return c.between(*value)
    return c.isNull() if op == "is_null" else c.isNotNull()


def compile_rule(rule: Rule, schema: T.StructType) -> Column:
    """True, false or NULL (unknown) per row."""
    found = problems(rule, schema)
    if found:
        raise InvalidRule(found)
    return _condition(rule.expression, schema)


_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``matched_rules`` and the highest ``rule_override`` among those that fired."""
    fired = {r.name: F.coalesce(compile_rule(r, df.schema), F.lit(False)) for r in rules}
    matched = F.array_compact(F.array(*[F.when(fired[r.name], F.lit(r.name)) for r in rules]))
    ranks = [
        F.when(fired[r.name], F.lit(_RANK[r.override])).otherwise(F.lit(-1)) for r in rules if r.override
    ]
    top = F.array_max(F.array(F.lit(-1), *ranks))
    override = F.lit(None).cast("string")
    for name, rank in _RANK.items():
        override = F.when(top == rank, name).otherwise(override)
    return df.withColumn("matched_rules", matched).withColumn("rule_override", override)


def preview(df: DataFrame, rule: Rule, since_us: int, until_us: int) -> DataFrame:
    """How many rows of [since, until) the rule would have matched."""
    recent = df.filter((F.col("t") >= since_us) & (F.col("t") < until_us))
    hit = compile_rule(rule, df.schema)
    return recent.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.coalesce(hit, F.lit(False)).cast("long")), F.lit(0)).alias("matches"),
    )


def threshold_preview(
    df: DataFrame, medium: float, high: float, until_us: int, hours: int = 24
) -> DataFrame:
    """Alerts per hour that the proposed thresholds would have raised over the last hours."""
    window = df.filter((F.col("t") >= until_us - hours * 3_600_000_000) & (F.col("t") < until_us))
    high_n = F.sum((F.col("score") >= high).cast("long"))
    medium_n = F.sum(((F.col("score") >= medium) & (F.col("score") < high)).cast("long"))
    return window.agg(
        (F.coalesce(high_n, F.lit(0)) / hours).alias("high_per_hour"),
        (F.coalesce(medium_n, F.lit(0)) / hours).alias("medium_per_hour"),
    )
