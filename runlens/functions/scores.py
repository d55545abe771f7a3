"""Scores, intervals and costs as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard normal quantile at 0.975.
Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion; (0, 1) for no trials."""
    n = n.cast("double")
    p = ratio(successes, n)
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = F.greatest((centre - spread) / scale, F.lit(0.0)), F.least((centre + spread) / scale, F.lit(1.0))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(1.0)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that k draws without replacement from n attempts include one of c passes."""
    n, c = n.cast("int"), c.cast("int")
    misses = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - F.lit(float(k)) / i))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1 - misses)


def partial_credit(current: Column, target: Column) -> Column:
    """current/target within 0..1; 1 for a target of 0 or less."""
    return F.when(target <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(current, target))))


def weighted_mean(value: Column, weight: Column | None = None) -> Column:
    """Aggregate: sum(w x) / sum(w), 0 for no rows; a null weight counts 1."""
    w = F.lit(1.0) if weight is None else F.coalesce(weight, F.lit(1.0))
    return F.coalesce(ratio(F.sum(w * value), F.sum(w)), F.lit(0.0))


def weighted_composite(dims: Column, weights: dict[str, float]) -> Column:
    """Weighted mean over a map of dimensions; a missing dimension or a negative weight is an error."""
    if any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("weights must be at least 0 and not all 0")
    parts = [F.lit(w) * F.coalesce(F.try_element_at(dims, F.lit(d)), F.raise_error(F.lit(f"no dimension {d}")).cast("double")) for d, w in weights.items()]
    return reduce(lambda a, b: a + b, parts) / sum(weights.values())


def task_score(holdout: Column, search: Column) -> Column:
    return F.coalesce(holdout, search)


def gated_score(score: Column, gated: Column) -> Column:
    """What training sees: 0 for a gated run, null for an ungraded one."""
    return F.when(score.isNotNull() & F.coalesce(gated, F.lit(False)), 0.0).otherwise(score)


def token_cost(prices: dict[str, float], **tokens: Column) -> Column:
    """Price of token classes, each per million; a null count is 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0)) * (prices[k] / 1e6) for k, n in tokens.items()])


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def blend(heldout: Column, judge: Column, weight: float = 0.7) -> Column:
    return weight * heldout + (1 - weight) * judge


def cliffs_band(delta: Column) -> Column:
    d = F.abs(delta)
    return F.when(d < 0.147, "negligible").when(d < 0.33, "small").when(d < 0.474, "medium").otherwise("large")


def first_number(attributes: Column, keys: list[str]) -> Column:
    """The first of the keys in a string map that holds a finite number."""
    found = [F.try_element_at(attributes, F.lit(k)).try_cast("double") for k in keys]
    return F.coalesce(*(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x) for x in found))


def judge_family(model: Column) -> Column:
    """The maker of a model by its id."""
    m = F.lower(model)
    return (
        F.when(m.rlike("claude|anthropic"), "anthropic").when(m.rlike("gpt|openai|(^|[^a-z])o[0-9]"), "openai")
        .when(m.rlike("gemini|google|palm"), "google").when(m.rlike("llama|meta"), "meta").when(m.rlike("mistral|mixtral"), "mistral")
        .when(m.rlike("qwen"), "qwen").when(m.rlike("deepseek"), "deepseek").when(m.rlike("glm|zhipu"), "zhipu").otherwise("unknown")
    )
