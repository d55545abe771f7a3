"""Personal data: fixed base patterns, and boosted trees that choose among further candidates. Native SQL throughout.

Positions come from cutting a text at a pattern's matches: the pieces between and the matches alternate.
Possessive quantifiers and `\\G` keep every pattern linear on long runs; they match what the plain
patterns match, since a start inside a run fails whenever the run's first start does.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: The base kinds in their order, with their patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates: numbers with separators, account numbers, spelled-out addresses, keys and other secrets.
FURTHER = {
    "number": r"(?<![A-Za-z0-9+])[(0-9][0-9(). /-]{5,24}[0-9](?![A-Za-z0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]{0,64}[0-9])(?=[0-9_+/=-]{0,64}[A-Za-z])[A-Za-z0-9_+/=-]{16,}+",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?i:at) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(] ?(?i:dot) ?[\])]|\.) ?[A-Za-z0-9-]{2,63})+",
}
KINDS = [*BASE, *FURTHER]
#: What can precede personal numbers, and what precedes other ones.
HINTS = r"(?i)(?:tel|phone|call|fax|mobile|cell|ssn|social|card|account|acct|iban|passport|mail|contact)[^A-Za-z0-9]{0,4}(?:no|number|nr|at|is|me)?[^A-Za-z0-9]{0,4}$"
SECRETS = r"(?i)(?:token|secret|password|passwd|pwd|passphrase|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|bearer|auth)[^A-Za-z0-9]{0,5}(?:is[^A-Za-z0-9]{0,3})?$"
AGAINST = r"(?i)(?:commit|revision|sha1|sha256|md5|hash|checksum|digest|uuid|id|version|release|isbn|page|pages|year|copyright|figure|chapter|order|total|price|usd|eur|section)[^A-Za-z0-9]{0,4}$"
CONTEXT = 32
#: Trees, their learning rate, and the least precision on examples that were not learned from.
TREES, RATE, PRECISION = 40, 0.3, 0.99

_SPAN = "array<struct<start:int,k:int,end:int,match:string>>"
_WIDE = "array<struct<start:int,k:int,end:int,match:string,before:string,after:string>>"


def _matches(text: Column, kind: str, guard: Column) -> Column:
    """start, k, end (code points) and text of all matches of a kind, in order; of further kinds also the CONTEXT characters before and the one after."""
    wide, pattern = kind in FURTHER, (BASE | FURTHER)[kind]
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = [found.alias("m"), between.alias("g")]
    if wide:
        parts.append(F.transform(F.slice(between, F.lit(2), F.greatest(F.size(between), F.lit(1))), lambda g: F.substring(g, 1, 1)).alias("a"))
    empty = F.array().cast(_WIDE if wide else _SPAN)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        fields = [start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), end.alias("end"), x["m"].alias("match")]
        before = F.right(F.concat(acc["tail"], x["g"]), F.lit(CONTEXT))
        if wide:
            fields += [before.alias("before"), F.coalesce(x["a"], F.lit("")).alias("after")]
        new = F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(*fields)))).cast(_WIDE if wide else _SPAN)
        tail = F.right(F.concat(before, F.coalesce(x["m"], F.lit(""))), F.lit(CONTEXT)) if wide else F.lit("")
        return F.struct(end.alias("at"), new.alias("out"), tail.alias("tail"))

    first = F.struct(F.lit(0).alias("at"), empty.alias("out"), F.lit("").alias("tail"))
    return F.when(guard, F.aggregate(F.arrays_zip(*parts), first, add, lambda acc: acc["out"])).otherwise(empty)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, every second from the right doubled, add up to a multiple of ten."""
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x["match"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int") <= 255))
    n = F.length(_digits(x["match"]))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(x["match"]))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x)


def _numbers(x: Column) -> list[tuple[str, Column]]:
    """Format and context of a candidate."""
    m, before = x["match"], x["before"]
    digits, groups = _digits(m), F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    count = lambda s: F.length(m) - F.length(F.replace(m, F.lit(s)))
    return [
        ("kind", x["k"]),
        ("digits", F.length(digits)),
        ("length", F.length(m)),
        ("groups", F.size(groups)),
        ("longest", F.array_max(F.transform(groups, F.length))),
        ("first", F.length(F.get(groups, F.lit(0)))),
        ("last", F.length(F.try_element_at(groups, F.lit(-1)))),
        ("hyphens", count("-")),
        ("dots", count(".")),
        ("slashes", count("/")),
        ("spaces", count(" ")),
        ("brackets", count("(")),
        ("year", F.get(groups, F.lit(0)).rlike("^(19|20)[0-9]{2}$").cast("int")),
        ("luhn", F.when(F.length(digits).between(12, 19), _luhn(digits).cast("int")).otherwise(0)),
        ("hint", before.rlike(HINTS).cast("int")),
        ("against", before.rlike(AGAINST).cast("int")),
        ("adjacent", x["after"].rlike("[%$€:/]").cast("int")),
        ("secret", before.rlike(SECRETS).cast("int")),
        ("known", m.rlike("^(?:AKIA|ASIA|sk-|gh[pousr]_|xox[bp]-|eyJ|glpat-)").cast("int")),
        ("capitals", F.length(F.regexp_replace(m, "[^A-Z]", ""))),
    ]


def examples(n: int = 1600, seed: int = 7) -> list[tuple[str, int]]:
    """Texts made from formats, each with one candidate, and whether it is personal data."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("aeinorstlumd") for _ in range(rng.randint(2, 8)))
    x = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k - 1)) + rng.choice("0123456789")
    y = lambda k: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789_-") for _ in range(k - 1)) + rng.choice("23456789")
    cue = lambda: rng.choice(["token", "secret", "password", "api_key", "api key", "access_key", "auth token", "TOKEN", "client_secret"]) + rng.choice([" = ", "=", ": ", ' = "', ": '", " is "])
    known = lambda: rng.choice(["sk-", "ghp_", "xoxb-", "AKIA"])
    year = lambda: f"{rng.choice(['19', '20'])}{d(2)}"
    yes = [
        lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(3)} {d(7)}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"0{d(2)} {d(4)} {d(4)}",
        lambda: f"{rng.choice(['DE', 'GB', 'FR', 'ES'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", lambda: f"{rng.choice(['DE', 'FR'])}{d(20)}",
        lambda: f"{w()}.{w()} [at] {w()} [dot] com", lambda: f"{w()}{d(2)}(at){w()}.org",
        lambda: cue() + x(rng.choice([32, 40, 64])), lambda: cue() + y(rng.randint(18, 48)), lambda: known() + y(rng.randint(20, 40)),
    ]
    no = [
        lambda: f"{year()}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{year()}", lambda: f"{d(1)}.{d(2)}.{d(3)}.{d(1)}", lambda: f"{year()}-{year()}",
        lambda: d(rng.randint(7, 13)), lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(5)}.{d(4)}", lambda: f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}",
        lambda: " ".join(d(rng.randint(1, 3)) for _ in range(rng.randint(4, 8))), lambda: f"{d(3)} - {d(4)}",
        lambda: rng.choice(["commit ", "sha256: ", "md5 ", "uuid ", "id=", ""]) + x(rng.choice([32, 40, 64])), lambda: f"{w()}_{w()}_{w()}_{d(2)}_{w()}", lambda: f"/{w()}/{w()}/{w()}{d(3)}/{w()}",
    ]
    hints, others = ["tel ", "phone: ", "call ", "mobile ", "contact: ", "account "], ["version ", "page ", "order ", "isbn ", "total ", "year "]
    out = []
    for i in range(n):
        label = i % 2
        lead = rng.choice(hints if label else others) if rng.random() < 0.3 else f"{w()} "
        out.append((f"{w()} {lead}{rng.choice(yes if label else no)()} {w()}", label))
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, threshold, low, high) or a leaf's value."""
    best, total = None, g.sum() ** 2 / (h.sum() + 1)
    if depth:
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= t
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - total
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, f, float(t))
    if best is None:
        return float(RATE * g.sum() / (h.sum() + 1))
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _apply(tree[2], x), _apply(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[list, float]:
    """Trees of depth 3 by Newton boosting on three quarters; the least margin with PRECISION on the rest."""
    rest = np.arange(len(x)) % 8 >= 6
    learn, margin, trees = ~rest, np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_grow(x[learn], (y - p)[learn], (p * (1 - p))[learn], 3))
        margin += _apply(trees[-1], x)
    order = np.argsort(-margin[rest], kind="stable")
    m, hit = margin[rest][order], np.cumsum(y[rest][order]) / np.arange(1, rest.sum() + 1)
    ok = np.flatnonzero((hit >= PRECISION) & (m > 0))
    return trees, float(m[ok[-1]]) if len(ok) else float("inf")


def _margin(trees: list, features: list[Column]) -> Column:
    def column(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        return F.when(features[tree[0]] <= tree[1], column(tree[2])).otherwise(column(tree[3]))

    return reduce(lambda a, b: a + b, map(column, trees))


def _candidates(rows: DataFrame) -> DataFrame:
    """doc_id, text -> with `further`: all matches of the generators."""
    digit = F.col("text").rlike("[0-9]")
    at = F.col("text").rlike(r"[\[(] ?(?i:at) ?[\])]")
    guards = {"number": digit, "account": digit, "secret": digit, "address": at}
    found = F.concat(*(_matches(F.col("text"), k, g) for k, g in guards.items()))
    return rows.withColumn("further", found)


_trained: dict[str, tuple[list, float]] = {}


def model(spark: SparkSession) -> tuple[list, float]:
    """The trees and their threshold, trained once for each session on examples()."""
    key = spark.sparkContext.applicationId
    if key not in _trained:
        literals = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(y).alias("y")) for t, y in examples()))
        rows = _candidates(spark.range(1).select(F.inline(literals)))
        features = rows.select("y", F.explode(F.transform("further", lambda x: F.struct(*(c.cast("double").alias(n) for n, c in _numbers(x))))).alias("f"))
        found = features.select("y", "f.*").fillna(0.0).collect()
        _trained[key] = boost(np.array([r[1:] for r in found]), np.array([r[0] for r in found], float))
    return _trained[key]


def find(docs: DataFrame, base: str = "base", spans: str = "spans") -> DataFrame:
    """(doc_id, text, ...) -> all input columns, and under these names arrays of start, k (index in KINDS), end, match.

    Both are sorted by start and then kind; `spans` has the base ones and the candidates chosen by the
    trees that overlap no base one. A null text counts as empty and has none. Columns of these names are
    an error.
    """
    if {base.lower(), spans.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {base} or {spans}; give other names")
    spark = docs.sparkSession
    trees, least = model(spark)
    own = [docs[c] for c in docs.columns]
    said, digit, kept, more, scores, *each = fresh(docs, "pii_text", "pii_digit", "pii_base", "pii_further", "pii_scored", *(f"pii_{k}" for k in KINDS))
    names, text = dict(zip(KINDS, each, strict=True)), F.col(said)
    guards = {"email": text.contains("@"), "ip": F.col(digit) & text.contains("."), "card": F.col(digit), "phone": F.col(digit) & text.contains("+")}
    rows = docs.withColumn(said, F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn(digit, F.col(said).rlike("[0-9]"))
    rows = rows.withColumns({names[k]: _matches(text, k, g) for k, g in guards.items()})
    rows = rows.withColumn(kept, F.array_sort(F.concat(*(F.filter(names[k], _check(k)) for k in BASE))))
    at = text.rlike(r"[\[(] ?(?i:at) ?[\])]")
    rows = rows.withColumns({names[k]: _matches(text, k, at if k == "address" else F.col(digit)) for k in FURTHER})
    free = lambda x: ~F.exists(kept, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    rows = rows.withColumn(more, F.filter(F.concat(*(F.col(names[k]) for k in FURTHER)), free))

    def scored(x: Column) -> Column:
        span = F.struct(*(x[c].alias(c) for c in ("start", "k", "end", "match")))
        return F.struct(span.alias("x"), F.struct(*(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in _numbers(x))).alias("f"))

    blank = F.struct(*(F.lit(v).alias(c) for c, v in (("start", 0), ("k", 0), ("end", 0), ("match", ""), ("before", ""), ("after", ""))))
    features = [n for n, _ in _numbers(blank)]
    rows = rows.withColumn(scores, F.when(F.size(more) > 0, F.transform(more, scored)))
    chosen = F.filter(scores, lambda s: _margin(trees, [s["f"][n] for n in features]) >= least)
    found = F.array_sort(F.concat(kept, F.coalesce(F.transform(chosen, lambda s: s["x"]), F.array().cast(_SPAN))))
    return rows.select(*own, F.col(kept).alias(base), found.alias(spans))


def _listed(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row for each input row."""
    def of(i: int):
        return lambda x: x["k"] == i

    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in `text` replaced by its kind in brackets; overlapping spans become one. All other columns stay as they are."""
    base, spans = fresh(docs, "pii_known", "pii_spans")

    def add(acc: Column, x: Column) -> Column:
        kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
        new = F.array(F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.get(kinds, x["k"]))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], new)).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    tail = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    new = F.when(F.size(spans) > 0, F.aggregate(spans, first, add, tail)).otherwise(F.col("text"))
    return find(docs, base, spans).withColumn("text", new).select(*docs.columns)
