"""SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks.

A document longer than a chunk is cut near fixed places. At each place the true cut may be at any of a few
positions, which are the boundary's states. A chunk yields a matrix from its entry states to its exit
states: the score of the text between them, with its first and last piece. Matrices combine in the
max-plus semiring, a pair of neighbours adding minus infinity where the model would join the pieces
that meet; the product is associative. The best path fixes every cut, and each chunk is then encoded
between its own two cuts without looking at the others.

For a byte-pair model a sequence of pieces is the encoding of its text exactly if every two neighbours
are the encoding of theirs, so a finite path is the library's own result. For a unigram model scores
add up, and the best path is the best segmentation.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallel, written

#: Characters of a chunk; longer documents are encoded and decoded in chunks.
CHUNK = 16_384
CACHED_WORDS = 300_000
_SPACE = "▁"


class Codec:
    """One model file: whole texts by the library, or pieces of text that is already normalised."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            raw = f.read()
        spec = pb.ModelProto()
        spec.ParseFromString(raw)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=raw)
        norm = spec.normalizer_spec
        #: Only then is a text's normal form its characters with spaces escaped, and can be cut anywhere.
        self.plain = norm.name == "identity" and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        self.prefix = _SPACE if norm.add_dummy_prefix else ""
        norm.add_dummy_prefix = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.scores = [p.score for p in spec.pieces]
        self.unigram = spec.trainer_spec.model_type == spec.trainer_spec.UNIGRAM
        pieces = [p.piece for p in spec.pieces if p.type == 1 or p.type == 4]
        self.longest = max(map(len, pieces), default=1)
        #: No piece goes from another character to a space, so words can be encoded apart.
        self.by_word = self.plain and not self.unigram and not any(a != _SPACE and b == _SPACE for p in pieces for a, b in zip(p, p[1:], strict=False))
        self.kept: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", _SPACE) if text else ""

    def _ids(self, part: str) -> bytes:
        return np.array(self.inner.encode(part), "<u4").tobytes()

    def encode_normal(self, text: str) -> bytes:
        """The ids of normalised text, as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return self._ids(text)
        words = text.split(_SPACE)
        found, spaces, first = [], 0, True
        for w in words:
            if not first:
                spaces += 1
            first = False
            if w:
                key = _SPACE * spaces + w if spaces != 1 else _SPACE + w
                got = self.kept.get(key)
                if got is None:
                    got = self._ids(key)
                    if len(key) < 64:
                        if len(self.kept) >= CACHED_WORDS:
                            self.kept = {}
                        self.kept[key] = got
                found.append(got)
                spaces = 0
        if spaces:
            found.append(self._ids(_SPACE * spaces))
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        if not self.plain:
            return np.array(self.whole.encode(text), "<u4").tobytes()
        return self.encode_normal(self.normal(text))

    def decode(self, ids: bytes, first: bool = True) -> str:
        """The text of a document's ids, or of a later chunk's: only the first loses the space that stands before every text."""
        return (self.whole if first else self.inner).decode(np.frombuffer(ids, "<u4").tolist())

    def states(self, text: str, at: int) -> list[int]:
        """Positions from `at` on of which one is a cut of every encoding: each one to the next word's start, or each
        of the next `longest`. None lies within a run of spaces."""
        last = min(at + self.longest, len(text))
        if self.by_word:
            for p in range(max(at, 1), min(at + 4 * self.longest, len(text))):
                if text[p] == _SPACE and text[p - 1] != _SPACE:
                    return [x for x in range(at, p + 1) if x == p or (x < last and text[x] != _SPACE and text[x - 1] != _SPACE)]
            if _SPACE * 2 in text[max(0, at - 1) : at + self.longest + 1]:
                while at < len(text) and (text[at] != _SPACE or text[at - 1] == _SPACE):
                    at += 1
                return [at]
        return list(range(at, last)) or [len(text)]

    def _ends(self, text: str) -> tuple[int, int]:
        """The first and last piece of the encoding; of words encoded apart only the first and last are looked at."""
        first = last = text
        if self.by_word:
            head, tail = self._word_start(text), self._last_word(text)
            first, last = text[:head], text[tail:]
        a, b = np.frombuffer(self.encode_normal(first), "<u4"), np.frombuffer(self.encode_normal(last), "<u4")
        return int(a[0]), int(b[-1])

    @staticmethod
    def _word_start(text: str) -> int:
        """Where the second word with its spaces begins; the end if there is none."""
        at = 1
        while at < len(text):
            at = text.find(_SPACE, at)
            if at < 0:
                break
            if text[at - 1] != _SPACE:
                return at
            at += 1
        return len(text)

    @staticmethod
    def _last_word(text: str) -> int:
        """Where the last word with its spaces begins."""
        at = text.rfind(_SPACE, 0, len(text.rstrip(_SPACE)))
        if text.endswith(_SPACE) and at >= 0 and text.rstrip(_SPACE):
            return len(text.rstrip(_SPACE))
        while at > 0 and text[at - 1] == _SPACE:
            at -= 1
        return max(at, 0)

    def transfer(self, text: str, entry: list[int], leave: list[int]) -> list[tuple[int, int, float, int, int]]:
        """(entry, exit, score, first piece, last piece) between each pair of states."""
        out = []
        for a in entry:
            for b in leave:
                if a < b and self.unigram:
                    ids = np.frombuffer(self.encode_normal(text[a:b]), "<u4")
                    out.append((a, b, float(sum(self.scores[i] for i in ids.tolist())), int(ids[0]), int(ids[-1])))
                elif a < b:
                    out.append((a, b, 0.0, *self._ends(text[a:b])))
        return out

    def meets(self, left: int, right: int) -> bool:
        """Whether the model leaves these two pieces apart; a unigram model's score tells instead."""
        if self.unigram or left < 0 or right < 0:  # below 0: at a cut that is sure
            return True
        both = self.inner.id_to_piece(left) + self.inner.id_to_piece(right)
        if self.inner.is_byte(left) or self.inner.is_byte(right):
            return True  # bytes are never joined
        return self.inner.encode(both) == [left, right]

    def combine(self, a: dict, b: dict) -> dict:
        """Max-plus product of two spans' matrices {(entry, exit): (score, first, last, cuts)}; associative."""
        out: dict = {}
        starts: dict = {}
        for (mid, leave), right in b.items():
            starts.setdefault(mid, []).append((leave, right))
        for (entry, mid), left in a.items():
            for leave, right in starts.get(mid, []):
                score = left[0] + right[0]
                if ((entry, leave) not in out or score > out[entry, leave][0]) and self.meets(left[2], right[1]):
                    out[entry, leave] = (score, left[1], right[2], (*left[3], mid, *right[3]))
        return out


_loaded: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def chunk_matrix(c: Codec, text: str, nominal: int) -> tuple[list[int], list[int]]:
    """Entry and exit states of the chunk at this nominal start."""
    entry = c.states(text, nominal) if nominal else [0]
    leave = c.states(text, nominal + CHUNK) if nominal + CHUNK < len(text) else [len(text)]
    return entry, leave


_ENCODED = "row long, doc_id long, part int, ids binary, n_parts int"
_NAMES = ["row", "doc_id", "part", "ids", "n_parts"]


def _by_size(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    large = F.coalesce(F.length("text") > CHUNK, F.lit(False))
    return rows.where(~large), rows.where(large)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, text, ...) -> row, doc_id, part, ids, n_parts: each document's ids in parts by ascending `part`.

    The ids are those of the library's encode(). `row` tells rows with one doc_id apart. A null or empty
    text gives one part without ids. Documents of up to one chunk have one part; longer ones go the
    chunked way, each chunk with its own row and task.
    """
    small, giant = _by_size(docs)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            ids = [c.encode(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.binary()), pa.array([1] * len(ids), pa.int32())], _NAMES)

    return small.mapInArrow(whole, _ENCODED).unionByName(_giants(giant, model))


def _giants(docs: DataFrame, model: str) -> DataFrame:
    """encode() of giants: cut, build matrices, combine and trace them for each document, encode each chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for row, doc_id, text in zip(*b.columns, strict=True):
                t = c.normal(text.as_py())
                nominal = range(0, len(t), CHUNK) if c.plain else [0]
                for part, at in enumerate(nominal):
                    entry, leave = chunk_matrix(c, t, at) if c.plain else ([0], [len(t)])
                    entry, leave = [x for x in entry if x < max(leave)], leave
                    if entry:
                        piece = t[entry[0] : leave[-1]] if c.plain else text.as_py()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row.as_py()], pa.int64()), pa.array([doc_id.as_py()], pa.int64()), pa.array([part], pa.int32()), pa.array([piece]), pa.array([entry], pa.list_(pa.int64())), pa.array([leave], pa.list_(pa.int64()))],
                            ["row", "doc_id", "part", "text", "entry", "leave"],
                        )

    giant = docs.mapInArrow(cut, "row long, doc_id long, part int, text string, entry array<long>, leave array<long>")
    chunks = written(giant.repartition(parallel(docs.sparkSession), "row", "part"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            found = []
            for row, part, text, entry, leave in zip(b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), strict=True):
                e, x, base = entry.as_py(), leave.as_py(), entry.as_py()[0]
                if not c.plain or len(e) == len(x) == 1:
                    cells = [(e[0], x[0], 0.0, -1, -1)]  # both ends are sure: nothing to choose or to check
                else:
                    cells = [(a + base, z + base, s, f, g) for a, z, s, f, g in c.transfer(text.as_py(), [v - base for v in e], [v - base for v in x])]
                found += [(row.as_py(), part.as_py(), *cell) for cell in cells]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], ["row", "part", "entry", "leave", "score", "first", "last"])

    cells = chunks.select("row", "part", "text", "entry", "leave").mapInArrow(
        matrices, "row long, part int, entry long, leave long, score double, first int, last int"
    )

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        c, spans = codec(model), []
        for _, own in pdf.sort_values("part", kind="stable").groupby("part"):
            spans.append({(r.entry, r.leave): (r.score, r.first, r.last, ()) for r in own.itertuples()})
        parts = sorted(pdf["part"].unique().tolist())
        while len(spans) > 1:  # pairs of neighbours, as a parallel scan would
            spans = [c.combine(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
        if not spans[0]:  # a boundary without a state on the library's path, which states() rules out
            raise ValueError(f"no consistent path over {len(parts)} chunks")
        (first, last), (_, _, _, cuts) = max(spans[0].items(), key=lambda x: x[1][0])
        at = [first, *cuts, last]
        return pd.DataFrame({"row": pdf["row"].iloc[0], "part": parts, "start": at[:-1], "end": at[1:], "n_parts": len(parts)})

    cuts = cells.groupBy("row").applyInPandas(trace, "row long, part int, start long, end long, n_parts int")

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            ids = []
            for text, base, start, end in zip(b.column(3), b.column(4), b.column(5), b.column(6), strict=True):
                t, z = text.as_py(), base.as_py()
                ids.append(c.encode_normal(t[start.as_py() - z : end.as_py() - z]) if c.plain else c.encode(t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary()), b.column(7)], _NAMES)

    traced = chunks.join(cuts, ["row", "part"]).select("row", "doc_id", "part", "text", F.col("entry")[0].alias("base"), "start", "end", "n_parts")
    return traced.mapInArrow(backtrace, _ENCODED)


def _said(encoded: DataFrame, model: str) -> DataFrame:
    """The result of encode() with `said`: the text of each part, decoded where the part is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            said = [c.decode(x.as_py(), first=not p.as_py()) for p, x in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], [*_NAMES, "said"])

    return encoded.select(*_NAMES).mapInArrow(run, f"{_ENCODED}, said string")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The result of encode() -> row, doc_id, ids (whole), text: one row for each document, its parts decoded apart."""
    parts = F.array_sort(F.collect_list(F.struct("part", "ids", "said"))).alias("p")
    whole = _said(encoded, model).groupBy("row", "doc_id").agg(parts)
    return whole.select("row", "doc_id", F.array_join("p.said", "").alias("text"), F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids")).select("row", "doc_id", "ids", "text")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as little-endian 32-bit numbers), decoded_sha256 of the text decoded again.

    One row for each input row. Documents of one part are told where they are encoded; only the ids and texts
    of longer ones, encoded and decoded by chunks, are brought together.
    """
    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"]
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string"
    small, giant = _by_size(docs)

    def told(doc_ids: pa.Array, ids: list[bytes], said: list[str]) -> pa.RecordBatch:
        numbers = ([len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids])
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in said]
        return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(x, pa.int64()) for x in numbers), pa.array(hashes, pa.string())], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            ids = [c.encode(t.as_py() or "") for t in b.column(1)]
            yield told(b.column(0), ids, list(map(c.decode, ids)))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x.as_py() for x in b.column(1)]
            yield told(b.column(0), [b"".join(p["ids"] for p in x) for x in rows], ["".join(p["said"] for p in x) for x in rows])

    parts = _said(_giants(giant, model), model).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ids", "said"))).alias("p"))
    return small.select("doc_id", "text").mapInArrow(whole, schema).unionByName(parts.select("doc_id", "p").mapInArrow(gathered, schema))
