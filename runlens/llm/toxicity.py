"""Toxic passages as maximal scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, written

#: Learning reads at most so many labelled documents of each class, chosen by hash of the id; with fewer, all.
SAMPLE_DOCS = 10_000
#: Weight of the Dirichlet prior as a share of the documents learned from; its shape is each token's frequency in both classes.
PRIOR_SHARE = 0.05
#: Standard errors that a log-odds must differ from 0 by, and those taken off it before it counts.
LEAST_ERRORS, ERRORS = 2.58, 1.0
#: What each token costs, in nats; it keeps the expected score of clean text negative.
DRIFT = 1.0
#: Lengths of word starts that stand for words without evidence of their own, longest first.
STARTS = (7, 6, 5, 4)
#: A passage is significant if clean text of the document's length has one as good with less than this probability.
SIGNIFICANT = 0.01
CACHED_WORDS = 200_000
_TOKEN = re.compile(r"[^\W_]+")


def sample(labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The labelled documents to learn from (doc_id, toxic), and how many there are of each class in all."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    known = written(known, "labels")
    totals = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    some = [known.where(F.col("toxic") == c).orderBy(*order).limit(SAMPLE_DOCS) for c in (0, 1)]
    return some[0].unionByName(some[1]), totals


def token_log_odds(texts: DataFrame) -> DataFrame:
    """(toxic, text) -> token, score: log-odds of documents having it, shrunk by the prior and by its error."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))

    def starts(k: int) -> Column:
        longer = F.filter(words, lambda w: F.length(w) > k)
        return F.array_distinct(F.transform(longer, lambda w: F.concat(F.lit(f"{k}:"), F.substring(w, 1, k))))

    rows = texts.select("toxic", F.explode(F.concat(words, *map(starts, STARTS))).alias("token")).where("token <> ''")
    counts = rows.groupBy("token").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t + c >= 3")
    nt, nc = (float(x or 0) for x in texts.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    docs = max(10.0, PRIOR_SHARE * (nt + nc))
    prior = (F.col("t") + F.col("c")) * (docs / max(1.0, nt + nc))
    t, c = F.col("t") + prior, F.col("c") + prior
    odds = F.log(t / (nt + docs + 1 - t)) - F.log(c / (nc + docs + 1 - c))
    error = F.sqrt(1 / t + 1 / c)
    return (
        counts.select("token", odds.alias("odds"), error.alias("error"))
        .where(F.abs("odds") > LEAST_ERRORS * F.col("error"))
        .select("token", (F.col("odds") - F.signum("odds") * ERRORS * F.col("error")).alias("score"))
    )


def maximal_segments(steps: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Ruzzo and Tompa's linear scan: all maximal scoring segments of (score, start, end) steps, in order.

    Each candidate knows the nearest one before it that starts from a lower sum, so a search goes along
    that chain instead of back through the whole list.
    """
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, end, place of the lower one
    total = 0.0
    for score, start, end in steps:
        before, total = total, total + score
        if score <= 0:
            continue
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][0] >= before:
                at = found[at][4]
            if at < 0 or found[at][1] >= total:
                found.append((before, total, start, end, at))
                break
            before, _, start, _, lower = found[at]
            del found[at:]
            at = lower
    return [(r - l, a, b) for l, r, a, b, _ in found]


@dataclass
class Model:
    tokens: dict[str, float] = field(default_factory=dict)
    rate: float = 1e-6  # good segments that clean text has for each token
    decay: float = 1.0  # of their number, for each nat of score
    weights: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def word(self, raw: str) -> float:
        """A word's own log-odds, or else those of its longest start that has any; less the drift."""
        w = raw.lower()
        for key in (w, *(f"{k}:{w[:k]}" for k in STARTS if len(w) > k)):
            if key in self.tokens:
                return self.tokens[key] - DRIFT
        return -DRIFT

    def p_value(self, score: float, n: int) -> float:
        return -math.expm1(-self.rate * n * math.exp(-self.decay * score))

    def evidence(self, segments: list[tuple[float, int, int]], n: int) -> tuple[float, float]:
        if not segments:
            return 0.0, 0.0
        good = [s for s, _, _ in segments if self.p_value(s, n) < SIGNIFICANT]
        return -math.log(max(self.p_value(max(s for s, _, _ in segments), n), 1e-12)), math.log1p(sum(good))

    def score(self, segments: list[tuple[float, int, int]], n: int) -> float:
        a, b, c = self.weights
        x, y = self.evidence(segments, n)
        return 1 / (1 + math.exp(-(a + b * x + c * y)))


class Scanner:
    def __init__(self, model: Model) -> None:
        self.model, self.kept = model, {}

    def segments(self, text: str) -> tuple[list[tuple[float, int, int]], int]:
        """Maximal segments as (score, first token, end token), and the number of tokens."""
        words = _TOKEN.findall(text)
        scores = list(map(self.kept.get, words))
        if None in scores:
            if len(self.kept) > CACHED_WORDS:
                self.kept = {}
            for i, s in enumerate(scores):
                if s is None:
                    scores[i] = self.kept[words[i]] = self.kept.get(words[i]) or self.model.word(words[i])
        if not scores or max(scores) <= 0:
            return [], len(words)
        values = np.array(scores)
        steps, at = [], 0
        sums = np.concatenate([[0.0], np.cumsum(values)])
        for i in np.flatnonzero(values > 0).tolist():
            if i > at:
                steps.append((sums[i] - sums[at], at, i))
            steps.append((scores[i], i, i + 1))
            at = i + 1
        return maximal_segments(steps), len(words)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns tokens, the tail of clean text's segments and the final logistic from the bounded sample.

    Copies of one text count once. Without both classes the model knows no token and scores all alike.
    """
    some, totals = sample(labels)
    texts = _texts(docs).join(F.broadcast(some), "doc_id").where("text is not null")
    texts = written(texts.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text")), "train")
    model = Model({r[0]: r[1] for r in token_log_odds(texts).collect()})
    if len(totals) < 2:
        return Model()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for b in batches:
            out = [scanner.segments(t.as_py()) for t in b.column(1)]
            segments = pa.array([[s for s, _, _ in x] for x, _ in out], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in out], pa.int64()), segments], ["toxic", "n", "s"])

    rows = written(texts.select("toxic", "text").mapInArrow(scan, "toxic int, n long, s array<double>"), "segments")
    sums = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    n, total, tokens = rows.where("toxic = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in (F.size("s"), sums, F.col("n")))).first()
    model.rate = (n + 1) / (tokens + 1)
    model.decay = float(np.clip((n + 1) / (total + 1), 0.5, 2.0))
    tail = Model(rate=model.rate, decay=model.decay)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tail.evidence([(s, 0, 0) for s in x.as_py()], n.as_py()) for n, x in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1))], ["toxic", "best", "all"])

    known = rows.mapInArrow(weigh, "toxic int, best double, all double").collect()  # three numbers for each document of the sample
    x = np.array([(1.0, r[1], r[2]) for r in known]).reshape(-1, 3)
    y = np.array([r[0] for r in known], float)
    if not 0 < y.sum() < len(y):
        return Model()
    w = np.where(y > 0, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
    model.weights = _logistic(x, y, w)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression with a slight ridge, by damped Newton steps."""
    beta, ridge = np.zeros(x.shape[1]), 0.1 * np.eye(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, held_out, score, predicted, passages, one row for each input row.

    passages has the significant ones: start and end (code points, end exclusive), score and p_value. A
    null text counts as empty; an empty one gets the score of a text without toxic tokens. A row without
    doc_id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(m := shared.value)
        for b in batches:
            scores, found = [], []
            for t in b.column(2):
                segments, n = scanner.segments(text := t.as_py() or "")
                scores.append(m.score(segments, n))
                good = [(s, x, y, p) for s, x, y in segments if (p := m.p_value(s, n)) < SIGNIFICANT]
                spans = [x.span() for x in _TOKEN.finditer(text)] if good else []
                found.append([{"start": spans[x][0], "end": spans[y - 1][1], "score": s, "p_value": p} for s, x, y, p in good])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, passage)],
                ["doc_id", "held_out", "score", "predicted", "passages"],
            )

    return (
        _texts(docs)
        .select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
        .mapInArrow(
            run,
            "doc_id long, held_out boolean, score double, predicted int,"
            " passages array<struct<start:long,end:long,score:double,p_value:double>>",
        )
    )


def reject(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs without those that score at or above the threshold; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(m := shared.value)
        for b in batches:
            yield b.filter(pa.array([m.score(*scanner.segments(t.as_py() or "")) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
