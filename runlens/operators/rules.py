"""Declarative rules: predicates, selections and estimands as plain data, compiled to columns and plans."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import ratio
from .joins import admission_funnel, rate_at_least_once
from .ordered import round_robin

_ORDERED = {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}


def predicate(rule: dict[str, Any]) -> Column:
    """{"op": eq|ne|lt|lte|gt|gte|in, "path": dotted, "value": ...} or {"all"|"any": [...]} or {"not": {...}}.

    eq and ne compare missing like a value and never coerce text to numbers; an ordering with a missing
    side does not hold. No rules in `all` hold, none in `any` do not.
    """
    if "all" in rule:
        return reduce(lambda a, b: a & b, map(predicate, rule["all"]), F.lit(True))
    if "any" in rule:
        return reduce(lambda a, b: a | b, map(predicate, rule["any"]), F.lit(False))
    if "not" in rule:
        return ~predicate(rule["not"])
    at, op, value = F.col(rule["path"]), rule["op"], rule["value"]
    if op in ("eq", "ne"):
        same = at.eqNullSafe(F.lit(value))
        return same if op == "eq" else ~same
    if op == "in":
        return F.coalesce(at.isin(*value), F.lit(False)) if value else F.lit(False)
    if op in _ORDERED:
        return F.coalesce(_ORDERED[op](at, F.lit(value)), F.lit(False))
    raise ValueError(f"no comparison {op}")


def select(rows: DataFrame, rule: dict[str, Any]) -> DataFrame:
    """{"where": predicate, "round_robin": {"group", "order", "take"}} or {"where", "order", "take"}."""
    kept = rows.where(predicate(rule["where"])) if "where" in rule else rows
    if "round_robin" in rule:
        spec = rule["round_robin"]
        return round_robin(kept, spec["group"], spec["order"], spec["take"])
    return kept.orderBy(*rule["order"]).limit(rule["take"])


def estimand(rows: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """One row: rate of a predicate; at-least-once rate by group; or mean difference of two arms by pair, a missing arm counting 0."""
    if spec["kind"] == "rate":
        hit = predicate(spec["hit"])
        return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), ratio(F.count_if(hit), F.count(F.lit(1))).alias("rate"))
    if spec["kind"] == "at_least_once":
        return rate_at_least_once(rows, spec["group"], predicate(spec["hit"]))
    if spec["kind"] == "paired_difference":
        arm, value = F.col(spec["arm"]), F.col(spec["value"])
        by = rows.groupBy(spec["pair"]).agg(*(F.coalesce(F.avg(F.when(arm == a, value)), F.lit(0.0)).alias(n) for a, n in zip(spec["arms"], "ab", strict=True)))
        return by.agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("b") - F.col("a")).alias("difference"))
    raise ValueError(f"no estimand {spec['kind']}")


def funnel(rows: DataFrame, stages: dict[str, dict[str, Any]]) -> DataFrame:
    return admission_funnel(rows, {name: predicate(rule) for name, rule in stages.items()})


def reproducible(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row: keys in one snapshot only, keys whose fields differ, keys that agree."""
    x = a.select(*key, F.struct(*fields).alias("x"), F.lit(True).alias("in_a"))
    y = b.select(*key, F.struct(*fields).alias("y"), F.lit(True).alias("in_b"))
    both = x.join(y, key, "full_outer")
    lone, same = F.col("in_a").isNull() | F.col("in_b").isNull(), F.col("x").eqNullSafe(F.col("y"))
    return both.agg(F.count_if(lone).alias("lone"), F.count_if(~lone & ~same).alias("differ"), F.count_if(~lone & same).alias("same"))
