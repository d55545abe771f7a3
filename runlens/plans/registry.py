"""Queries by name, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; sql is what it must equal on the same tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t_p_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t in SQL: one less twice the density's area up to |t|, by Simpson's rule."""
    top, sides = f"least(abs({t}), 60)", "case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end"
    area = f"list_sum(list_transform(range(0, 2001), lambda i: {sides} * pow(1 + pow({top} * i / 2000, 2) / ({df}), -(({df}) + 1) / 2))) * {top} / 6000"
    return f"(1 - 2 * {area} * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()))"


def normal_p_sql(z: str) -> str:
    """Two-sided p of a normal deviate in SQL, likewise."""
    top, sides = f"least(abs({z}), 12)", "case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end"
    return f"(1 - 2 * list_sum(list_transform(range(0, 2001), lambda i: {sides} * exp(-pow({top} * i / 2000, 2) / 2))) * {top} / 6000 / sqrt(2 * pi()))"


def uniform_sql(key: str, counter: str, seed: int = 0) -> str:
    """The counter-based generator of functions.random in SQL."""
    p = (1 << 31) - 1
    h = f"((({key})::bigint & {p}) * 48271 + ((({key})::bigint >> 31) & {p}) * 69621 + {counter} * 40692 + {seed * 16807 + 1}) % {p}"
    for shift, factor in ((13, 1103515245), (11, 1597334677), (15, 630360016)):
        h = f"list_transform([{h}], lambda h: (xor(h, h >> {shift}) * {factor}) % {p})[1]"
    return f"(({h} + 0.5) / {float(p)})"
