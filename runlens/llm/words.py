"""Words of many texts at once, on Arrow columns: runs of ASCII letters and digits and of all other characters beyond ASCII."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are cut into words at a time; a longer text is taken alone.
SLICE = 8 << 20
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts take about `limit` bytes, so that memory follows no batch's number of rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words one after the other, A-Z as a-z and nothing else changed, and the number of words of each text (null: none)."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), _BETWEEN)
    flat, ends = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    full = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), np.diff(before[ends])


def offsets_and_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string of an Arrow column without nulls begins (and the last ends), and the bytes of all."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
