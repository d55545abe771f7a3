"""Language identification, word first: known words by log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Learning reads at most about this many documents of each language, chosen by hash of the id; with fewer, all.
SAMPLE_DOCS = 4_000
#: A word that the sample of a language has less often counts as unseen; and the longest n-gram behind words.
LEAST = 2
LONGEST = 5
#: Bytes of unseen words' scores that a worker remembers.
CACHED = 64 << 20
_WORDS = re.compile(r"[^\W\d_]+")


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: the words of each language, LEAST times or more in the bounded sample of documents to learn from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    dealt = known.join(F.broadcast(sizes), "lang").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * SAMPLE_DOCS / F.col("docs")
    )
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    counts = dealt.select("lang", word).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= LEAST).select("lang", "word", "n")


#: Longer words are scored each time they occur.
CACHED_LENGTH = 40
#: N-grams of a word that are averaged at a time.
SLICE = 4096


class Table:
    """Log frequencies by key and language: one for whatever a language has not, and what each key's own languages add, row by row."""

    def __init__(self, weights: Iterable[tuple[str, int, float]], langs: int) -> None:
        self.row: dict[str, int] = {}
        rows, columns, values = array("q"), array("q"), array("d")
        for key, column, weight in weights:
            rows.append(self.row.setdefault(key, len(self.row)))
            columns.append(column)
            values.append(weight)
        cell, at = np.unique(np.array(rows, np.int64) * langs + np.array(columns, np.int64), return_inverse=True)
        sums = np.bincount(at, np.array(values, np.float64), len(cell))
        column = (cell % max(langs, 1)).astype(np.int32)
        self.langs, self.column, self.more = langs, column, np.log1p(sums).astype(np.float32)
        self.ends = np.searchsorted(cell, np.arange(len(self.row) + 1) * langs)
        self.rest = -np.log(np.bincount(column, sums, langs) + len(self.row) + 1)

    def total(self, rows: np.ndarray) -> np.ndarray:
        """The sum of the logs of these rows, by language."""
        first, n = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return len(rows) * self.rest + np.bincount(self.column[at], self.more[at], self.langs)


class Model:
    """Log frequencies of words and of n-grams (of the same words, ends marked), one column for each language."""

    def __init__(self, counts: list[tuple[str, str, int]]) -> None:
        counts = sorted(counts)
        self.langs = sorted({r[0] for r in counts})
        column = {x: i for i, x in enumerate(self.langs)}
        self.words = Table(((word, column[lang], n) for lang, word, n in counts), len(self.langs))
        self.grams = [
            Table(
                (
                    (f" {word} "[i : i + size], column[lang], 1 + math.log(n))
                    for lang, word, n in counts
                    for i in range(len(word) + 3 - size)
                ),
                len(self.langs),
            )
            for size in range(1, LONGEST + 1)
        ]

    def unseen(self, word: str) -> np.ndarray:
        """The mean over the longest n-grams of which any is known; nothing for a word with none."""
        marked = f" {word} "
        for size in range(LONGEST, 0, -1):
            table, total, n, last = self.grams[size - 1], np.zeros(len(self.langs)), 0, len(marked) - size + 1
            for at in range(0, last, SLICE):
                found = [x for i in range(at, min(at + SLICE, last)) if (x := table.row.get(marked[i : i + size])) is not None]
                if found:
                    total += table.total(np.array(found, np.int64))
                    n += len(found)
            if n:
                return (total / n).astype(np.float32)
        return np.zeros(len(self.langs), np.float32)


def letters(text: str) -> list[str]:
    """The runs of letters (of any script, `\\p{L}`) of a lower-cased text: other numerals such as `²` or `Ⅳ` are word characters to Python, but no letters."""
    found = _WORDS.findall(text.lower())
    return found if "".join(found).isalpha() else [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


class Scorer:
    """Predictions of one worker. Sums of unseen words are kept for the next texts, as many as CACHED bytes hold."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.cache = model, model.words.row, {}
        self.room = CACHED // (4 * len(model.langs) + 300)  # an entry has some 300 bytes besides its numbers

    def _unseen(self, word: str) -> np.ndarray:
        if len(word) > CACHED_LENGTH:
            return self.model.unseen(word)
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= self.room:
                self.cache.clear()
            found = self.cache[word] = self.model.unseen(word)
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = letters(text or "")
        if not words or not self.model.langs:
            return "und", 0.0
        total = np.zeros(len(self.model.langs))
        for at in range(0, len(words), 100_000):
            part = words[at : at + 100_000]
            found = list(map(self.known.get, part))
            for i, x in enumerate(found):
                if x is None:
                    total += self._unseen(part[i])
            total += self.model.words.total(np.array([x for x in found if x is not None], np.int64))
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score, one row for each input row.

    Learns from text and lang of documents that are not held out. lang_pred is a learned language, the
    first in order if several tie, and `und` with score 0 if the text is null or has no letter, or if
    there was nothing to learn from. A row without doc_id is not held out. score is the posterior
    probability of lang_pred under equal priors.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model([tuple(r) for r in word_counts(docs).collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for b in batches:
            out = [scorer.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )
