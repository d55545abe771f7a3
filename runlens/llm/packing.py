"""Packing tokenised documents into fixed sequences: first-fit decreasing over a tournament tree of bins."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Pieces that one task packs together. Larger groups waste less; each leaves about one sequence partly filled.
GROUP_PIECES = 16_384
#: Words kept by a worker with their ids; the memory is cleared when full.
CACHED_WORDS = 300_000
#: Characters tokenised at a time, cut at a space.
SLICE = 1 << 20

_PLAIN = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """Token ids of white-space-separated words, as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never merges across it, so a text's ids are its words' ids in
    turn. Words of plain Latin letters, digits and signs are split here and only their parts go through
    the library's model; all others go through the whole library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole, self.kept, self.parts = Tokenizer.from_file(path), {"": b""}, {}
        self.model, self.letters = self.whole.model, _byte_letters()

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            shown = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
            got = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(self.parts) >= CACHED_WORDS:
                self.parts = {}
            self.parts[part] = got
        return got

    def _ids(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        lower = word.lower()
        if lower.isalpha():
            return self._part(lower)
        return b"".join(map(self._part, _WORDS.findall(lower)))

    def ids(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        found = list(map(self.kept.get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    word = words[i]
                    found[i] = got = self.kept.get(word)
                    if got is None:
                        found[i] = got = self._ids(word)
                        if len(word) < 64:
                            if len(self.kept) >= CACHED_WORDS:
                                self.kept = {"": b""}
                            self.kept[word] = got
        return b"".join(found)

    def document(self, text: str, end: int) -> bytes:
        parts, at = [], 0
        while len(text) - at > SLICE:
            cut = text.find(" ", at + SLICE)
            if cut < 0:
                break
            parts.append(self.ids(text[at:cut]))
            at = cut
        return b"".join([*parts, self.ids(text[at:]), end.to_bytes(4, "little")])


_loaded: dict[str, Words] = {}


def words(path: str) -> Words:
    """The worker's tokenizer of this file, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 2) -> DataFrame:
    """(doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens: full pieces of `capacity` ids and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = words(tokenizer).document, 4 * capacity
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids, i = encode(text.as_py() or "", end), doc_id.as_py()
                out += [
                    (i, at // 4, min(width, len(ids) - at) // 4, zlib.crc32(ids[at : at + width]), len(ids) // 4)
                    for at in range(0, len(ids), width)
                ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, given in descending order.

    A tournament tree over the bins holds at each node the most room below it; a descent that goes left
    whenever the left half has room ends at the first bin that fits, so a piece costs O(log bins).
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, need in enumerate(lengths.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 2) -> DataFrame:
    """(doc_id, text, ...) -> one row for each piece, with its sequence_id and offset.

    A document is its ids and then `end`; a null or blank text is `end` alone. It is cut at multiples of
    `capacity`, so only its last piece is partial. Pieces are dealt to groups by hash, about GROUP_PIECES
    to each, and each group is packed on its own; sequence ids count up within a group, groups lie 2^32
    apart. Equal lengths go by doc_id and start; rows with one doc_id are packed like different documents.
    """
    cut = written(pieces(docs, tokenizer, capacity, end), "pieces")
    groups = max(1, round(cut.count() / GROUP_PIECES))
    schema = cut.schema.add("sequence_id", "long").add("offset", "long")

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit(pdf["length"].to_numpy(np.int64), capacity)
        return pdf.drop(columns="g").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(fill, schema)
