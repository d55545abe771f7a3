"""SimHash fingerprints linked by covering locality-sensitive hashing.

For a radius r, every bit position gets one of the 2^(r+1)-1 nonzero vectors of r+1 bits, and
each nonzero vector v makes a table that keeps the positions whose vector has an odd inner
product with v. At most r differing positions span at most r dimensions, so some v is orthogonal
to all of them: that table keeps none of them and the pair collides there. Nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, scratch, written
from .components import cells, connected_components, mixed_buckets, settled

BITS = 64
#: Distinct fingerprints that one task compares with each other, or with as many others.
BLOCK = 1024
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, joined by one space; of all words if they are fewer."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - width + 1)


def simhash(text: str | None, width: int = 4) -> int:
    """Bit b is 1 if set in over half the shingle hashes; 0 for a text without words."""
    h = shingle_hashes(text, width)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long: the 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """One mask for each nonzero vector of radius+1 bits, as signed 64-bit numbers."""
    size = 2 ** (radius + 1) - 1
    vectors = [1 + b % size for b in range(BITS)]
    masks = [sum(1 << b for b, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(radius: int):
    """Rows of bucket members -> (a, b) edges that span the components of the links within each row."""

    def spans(fp: np.ndarray, rep: np.ndarray, part: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        if cross:
            near &= part[:, None] != part[None, :]
        np.fill_diagonal(near, True)
        label = rep.copy()
        while True:
            low = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
            if (low == label).all():
                break
            label = low
        moved = label != rep
        return rep[moved], label[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            cols = [b.column(i) for i in range(3)]
            ends = np.asarray(cols[0].offsets)
            fp, rep, part = (np.asarray(c.values) for c in cols)
            cross = np.asarray(b.column(3).to_numpy(zero_copy_only=False))
            pairs = np.flatnonzero(np.diff(ends) == 2)
            if len(pairs):
                x, y = ends[pairs], ends[pairs] + 1
                ok = np.bitwise_count(fp.view(np.uint64)[x] ^ fp.view(np.uint64)[y]) <= radius
                ok &= ~cross[pairs] | (part[x] != part[y])
                found.append((rep[x[ok]], rep[y[ok]]))
            for i in np.flatnonzero(np.diff(ends) > 2):
                s = slice(ends[i], ends[i + 1])
                found.append(spans(fp[s].view(np.uint64), rep[s], part[s], cross[i]))
            a, c = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def _in_blocks(rows: DataFrame, buckets: DataFrame, by: Column) -> DataFrame:
    """rows of the buckets (k, size), each once for every pair (i, j) of blocks that holds its own block, `part`.

    rows are exploded ones, which Spark takes to be as few as those before: without the hint it would broadcast them through the driver.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    return (
        rows.hint("merge").join(buckets, "k")
        .withColumn("part", F.pmod(F.xxhash64(by), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    )


def _dealt(rows: DataFrame, by: Column) -> DataFrame:
    """(k, fp, rep) -> fp, rep, part, cross: the members of each bucket with more than one.

    A bucket of over BLOCK members is cut into blocks by a hash of `by` and every pair of blocks becomes
    a group of its own, so that no task holds more than two blocks and none of the pairs is left out.
    """
    dealt = _in_blocks(rows, rows.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), by)
    return (
        dealt.groupBy("k", "i", "j")
        .agg(F.collect_list(F.struct("fp", "rep", "part")).alias("m"))
        .where(F.size("m") > 1)
        .select("m.fp", "m.rep", "m.part", (F.col("i") != F.col("j")).alias("cross"))
    )


def links(reps: DataFrame, radius: int) -> DataFrame:
    """(fp, rep), each fp once -> (a, b): rep pairs that span the components of links at `radius` bits or fewer."""
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(covering_masks(radius))]
    groups = _dealt(reps.select("fp", "rep", F.explode(F.array(*keys)).alias("k")), F.col("fp"))
    return groups.mapInArrow(_forest(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, fingerprint (16 hex digits), component_id.

    One row for each input row. Documents are linked if their fingerprints differ in at most `radius`
    bits; component_id is the smallest doc_id reachable. A null or blank text has fingerprint 0 and is
    linked like any other. A row without doc_id keeps its fingerprint, joins the component of its
    fingerprint and never names one: component_id is null if nothing else there has an id.
    """
    fps = written(fingerprints(docs, width), "fp")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    found = connected_components(links(written(reps, "reps"), radius))
    of = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Fingerprints of a document's word set, each under a hash of its own, that similar_groups() searches.
SEEDS = (1, 2, 3)


def word_fingerprint(text: str, seed: int) -> int:
    """SimHash over the set of words: an edited word weighs less here than in shingles."""
    words = {*(text or "").encode("utf-8", "replace").translate(_LOWER).split()}
    if not words:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _nearest(radius: int):
    """Rows of bucket members -> true links (a, b): each member's nearest one, and a tree that spans each component."""

    def pairs(fp: np.ndarray, part: np.ndarray, cross: bool) -> Iterator[tuple[int, int]]:
        d = np.bitwise_count(fp[:, None] ^ fp[None, :]).astype(np.int16)
        d[d > radius] = 99
        np.fill_diagonal(d, 99)
        if cross:
            d[part[:, None] == part[None, :]] = 99
        near = d.argmin(axis=1)
        yield from ((i, int(j)) for i, j in enumerate(near) if d[i, j] <= radius)
        left = np.ones(len(fp), bool)
        while left.any():
            edge = [int(np.flatnonzero(left)[0])]
            left[edge] = False
            while edge:
                i = edge.pop()
                new = np.flatnonzero(left & (d[i] <= radius))
                left[new] = False
                edge += new.tolist()
                yield from ((i, j) for j in new.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[int, int]] = set()
            for fps, reps, parts, cross in zip(*b.columns, strict=True):
                fp, rep = np.asarray(fps.values).view(np.uint64), np.asarray(reps.values).tolist()
                found |= {(min(rep[i], rep[j]), max(rep[i], rep[j])) for i, j in pairs(fp, np.asarray(parts.values), cross.as_py())}
            a, c = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


#: Bits of a shingle set's sketch: the parity of the number of its shingles at each place.
SKETCH = 1024


def sketch(shingles: np.ndarray) -> bytes:
    """Sketches of two sets differ in no more bits than the sets do in shingles."""
    return np.packbits(np.bincount((shingles.view(np.uint64) % SKETCH).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def _unlike(least: float, radius: int):
    """The members of a pair of blocks -> (a, b, ga, gb, d): links within the radius between groups that may be similar; d bits differ.

    Sets of n and m shingles with Jaccard similarity `least` differ in (n + m)(1 - least) / (1 + least)
    shingles at most, so what is left out here is not similar for certain.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        fp, part, g, rep, n = (t.column(c).to_numpy() for c in ("fp", "part", "g", "rep", "n"))
        fp, words = fp.view(np.uint64), np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(fp), -1)
        cross = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        found = [(np.empty(0, np.int64),) * 5]
        if cross:  # each member of the smaller block against all of the larger
            sides = sorted((np.flatnonzero(part == p) for p in np.unique(part)), key=len)
            turns = ((at, sides[1]) for at in sides[0]) if len(sides) == 2 else ()
        else:
            turns = ((at, np.arange(at + 1, len(fp))) for at in range(len(fp)))
        for at, among in turns:
            to = among[(np.bitwise_count(fp[among] ^ fp[at]) <= radius) & (g[among] != g[at])]
            d = np.maximum(np.bitwise_count(words[to] ^ words[at]).sum(axis=1, dtype=np.int64), np.abs(n[to] - n[at]))
            may = d <= (n[to] + n[at]) * (1 - least) / (1 + least) + 1e-6
            to, low = to[may], rep[at] < rep[to[may]]
            a, ga = np.full(len(to), rep[at]), np.full(len(to), g[at])
            found.append((np.where(low, a, rep[to]), np.where(low, rep[to], a), np.where(low, ga, g[to]), np.where(low, g[to], ga), d[may]))
        return pa.table({c: pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i, c in enumerate(("a", "b", "ga", "gb", "d"))})

    return run


def similar_groups(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, th (XXH64 of the text), g: the group of each row.

    Texts are grouped if their sets of `width`-word shingles have Jaccard similarity `least` or more,
    directly or through others; equal texts always are. Candidates are texts of which one of the word
    fingerprints differs in at most `radius` bits, found by covering hashing. First each text's nearest
    candidate and a tree over each bucket are verified exactly, then every other candidate pair that
    still lies in two groups, unless its sketches rule it out. A null text counts as empty; texts without words are alike.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [[word_fingerprint(t.as_py(), s) for s in SEEDS] for t in b.column(1)]
            signed = pa.array(np.array(fps, np.uint64).reshape(-1, len(SEEDS)).view(np.int64).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), signed], ["doc_id", "th", "fps"])

    rows = written(named.mapInArrow(run, "doc_id long, th long, fps array<long>"), "words")
    texts = rows.groupBy("th").agg(F.first("fps").alias("fps")).select("th", F.posexplode("fps").alias("s", "fp"))
    reps = texts.select("s", "fp", F.col("th").alias("rep"))
    keys = [F.xxhash64(F.lit(i), F.col("s"), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(covering_masks(radius))]
    groups = _dealt(reps.select("fp", "rep", F.explode(F.array(*keys)).alias("k")), F.col("rep"))
    pairs = written(groups.mapInArrow(_nearest(radius), "a long, b long").where("a <> b").distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("th")).unionByName(pairs.select(F.col("b").alias("th"))).distinct()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in b.column(1)]
            columns = [b.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(map(len, sets), pa.int64()), pa.array(map(sketch, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["th", "shingles", "n", "sketch"])

    kept = "th long, shingles array<long>, n long, sketch binary"
    sets = named.select("th", "text").join(nodes, "th", "left_semi").mapInArrow(shingled, kept)
    sets = written(sets.groupBy("th").agg(*(F.first(c).alias(c) for c in ("shingles", "n", "sketch"))), "shingles")
    x, y = (sets.select(F.col("th").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(x, "a").join(y, "b")
        common = F.size(F.array_intersect("sa", "sb"))
        ok = (common >= least * (F.size("sa") + F.size("sb") - common)).alias("ok")
        return both.select(*pairs.columns, ok).where("ok").select(*pairs.columns)

    of = written(connected_components(alike(pairs)), "of")
    # a text with any candidate is in a pair
    labelled = written(sets.select("th", "n").join(of.withColumnRenamed("node", "th"), "th", "left").select("th", F.coalesce("component", "th").alias("g")), "labelled")
    members = texts.join(labelled, "th").select("s", "fp", F.col("th").alias("rep"), "g", F.explode(F.array(*keys)).alias("k"))
    held = written(members, "held")
    part, pairs_of = cells(F.col("rep"), F.col("g") == F.col("main"), F.col("n_main"), F.col("n_rest"))
    blocks = held.join(mixed_buckets(held, "k", BLOCK), "k").withColumns({"part": part, "c": F.explode(pairs_of)}).join(sets.select(F.col("th").alias("rep"), "n", "sketch"), "rep")
    blocks = blocks.select("k", "c.i", "c.j", "fp", "rep", "part", "g", "n", "sketch")
    unlike = blocks.groupBy("k", "i", "j").applyInArrow(_unlike(least, radius), "a long, b long, ga long, gb long, d long").distinct()
    found = settled(of, unlike.join(pairs, ["a", "b"], "left_anti"), alike)
    return rows.join(found, rows.th == found.node, "left").select("doc_id", "th", F.coalesce("component", "th").alias("g"))


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one document of each of the similar_groups(): the smallest doc_id (rows without one last), then text hash.

    Of rows equal in doc_id and text one stays.
    """
    with scratch() as kept:
        groups = written(similar_groups(docs, width, least), "groups")
        order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th")
        best = groups.groupBy("g").agg(F.min(order).alias("best"))
        named = groups.join(best, "g")
        stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))
        kept.append(written(named.select("doc_id", "th", stays.alias("stays")).groupBy("doc_id", "th", "stays").agg(F.count(F.lit(1)).alias("n")), "stays"))
    counts = kept[0]
    row_id, row_th, i, t = fresh(docs, "row_id", "row_th", "kept_id", "kept_th")
    rows = docs.withColumns({row_id: F.col("doc_id").cast("long"), row_th: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})

    def among(some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("doc_id").alias(i), F.col("th").alias(t))
        return rows.join(some, F.col(row_id).eqNullSafe(F.col(i)) & (F.col(row_th) == F.col(t)), how)

    once = among(counts.where(~F.col("stays") | (F.col("n") > 1)), "left_anti")
    repeated = among(counts.where(F.col("stays") & (F.col("n") > 1)), "left_semi").dropDuplicates([row_id, row_th])
    return once.unionByName(repeated).select(*docs.columns)
