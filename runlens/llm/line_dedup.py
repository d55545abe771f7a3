"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, union-find. Native SQL throughout.

A line is compared in its normal form (lower case, no white space at its ends) and known by the XXH64
of that. Its shingles are the windows of SHINGLE bytes of its UTF-8 form, a shorter line is one shingle.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, scratch, small, written
from .components import cells, connected_components, mixed_buckets, settled

SHINGLE = 9
#: The least Jaccard similarity, in fifths.
LEAST = 4
#: MinHash values are the cells of a grid of ROWS x COLUMNS; its columns and its diagonals are the bands, two bands
#: share one value at most. A pair of Jaccard similarity 0.8 shares a band with probability 0.982, one of 0.9 with 0.9989.
ROWS, COLUMNS = 3, 4
BANDS = [[r * COLUMNS + (c + slope * r) % COLUMNS for r in range(ROWS)] for slope in (0, 1) for c in range(COLUMNS)]
#: Shingles that one row of the signatures' fold takes together.
TOGETHER = 16
#: Lines of a bucket that one task holds against each other, or against as many others.
BLOCK = 1024
#: Longs of a shingle set's sketch.
SKETCH = 32
#: Shingles that one row of the sketches' fold takes together.
CHUNK = 16
_BLANK = " \t\r\x0b\x0c"


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), text of all rows with a text."""
    text = F.col("text").cast("string")
    return docs.where(text.isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _split(text: str) -> Column:
    return F.split(F.lower(text), "\n")


def _norm(line: Column) -> Column:
    """line without white space at its ends; few have other than spaces there, and spaces alone are cheap to trim."""
    trimmed = F.trim(line)
    rest = reduce(or_, (test(c) for c in _BLANK[1:] for test in (trimmed.startswith, trimmed.endswith)))
    return F.when(rest, F.btrim(line, F.lit(_BLANK))).otherwise(trimmed)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos, norm, k: all lines that are not blank."""
    rows = _rows(docs).select("doc_id", "th", F.posexplode(_split("text")).alias("pos", "line"))
    rows = rows.select("doc_id", "th", "pos", _norm(F.col("line")).alias("norm"))
    return rows.where("norm <> ''").withColumn("k", F.xxhash64("norm"))


def _starts(raw: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.octet_length(raw) - (SHINGLE - 1), F.lit(1)))


def signatures(lines: DataFrame, key: Sequence[str] = ("k",)) -> DataFrame:
    """(key, norm) -> key, bands: the hashes of each line's bands of MinHash values.

    All shingles of a line count, whatever its length. A shingle's value under the j-th permutation is its
    32-bit hash times an odd constant plus another, modulo 2^32: permutations independent enough that also
    lines of few shingles have different minima. Shingles are rows that whole-stage code hashes and folds
    into the minima of their line before anything is shuffled; a line's last shingle fills up its last row.
    """
    rng = random.Random(4)
    constants = [(rng.getrandbits(29) * 2 + 1, rng.getrandbits(32)) for _ in range(ROWS * COLUMNS)]
    raw = lines.select(*key, F.col("norm").cast("binary").alias("raw")).withColumn("most", F.greatest(F.octet_length("raw") - (SHINGLE - 1), F.lit(1)))
    rows = raw.select(*key, "raw", "most", F.explode(F.sequence(F.lit(1), "most", F.lit(TOGETHER))).alias("i"))
    at = [F.least(F.col("i") + d, F.col("most")) for d in range(TOGETHER)]
    h = [F.hash(F.substring("raw", i, F.lit(SHINGLE))).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) for i in at]
    h = rows.select(*key, *(x.alias(f"h{d}") for d, x in enumerate(h)))
    turned = lambda a, b: [(F.col(f"h{d}") * a + b).bitwiseAND(F.lit(0xFFFFFFFF)) for d in range(TOGETHER)]
    lowest = lambda x: x[0] if len(x) == 1 else F.least(*x)
    mins = h.groupBy(*key).agg(*(F.min(lowest(turned(a, b))).alias(f"m{j}") for j, (a, b) in enumerate(constants)))
    bands = [F.xxhash64(F.lit(b), *(f"m{j}" for j in cells)) for b, cells in enumerate(BANDS)]
    return mins.select(*key, F.array(*bands).alias("bands"))


def _shingles(text: Column) -> Column:
    def of(raw: Column) -> Column:
        return F.array_distinct(F.transform(_starts(raw), lambda i: F.xxhash64(F.substring(raw, i, F.lit(SHINGLE)))))

    # bound to a lambda's variable, the bytes are made once and not for each shingle
    return F.transform(F.array(text.cast("binary")), of)[0]


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, ...) whose shingle sets have a similarity of at least LEAST, exactly; 64-bit hashes stand for shingles.

    The longer line's set comes first: where even a shorter line without repeats would have too few
    shingles, its set is not made. Rows are let through by explode(), which unlike a filter is not merged
    with the columns below it, so each set is made once.
    """
    sides = [texts.select(F.col("k").alias(x), F.col("norm").alias(f"n{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    columns, longer = pairs.columns, F.octet_length("na") >= F.octet_length("nb")
    both = both.select(*columns, F.when(longer, F.col("na")).otherwise(F.col("nb")).alias("long"), F.when(longer, F.col("nb")).otherwise(F.col("na")).alias("short"))
    both = both.select(*columns, "short", _shingles(F.col("long")).alias("x"))
    most = F.greatest(F.octet_length("short") - (SHINGLE - 1), F.lit(1))  # shingles of the shorter line
    both = both.select(*columns, "short", "x", F.explode(F.when(5 * most >= LEAST * F.size("x"), F.array(F.lit(True)))).alias("go"))
    both = both.select(*columns, "x", _shingles(F.col("short")).alias("y"))
    common = F.size(F.array_intersect("x", "y"))  # c / (n + m - c) >= LEAST / 5
    alike = F.when((5 + LEAST) * common >= LEAST * (F.size("x") + F.size("y")), F.array(F.lit(True)))
    return both.select(*columns, F.explode(alike).alias("go")).select(*columns)


def _sketches(texts: DataFrame) -> DataFrame:
    """(k, norm) -> k, n (windows of SHINGLE bytes, repeats included), s0, s1, ... (the sketch of its shingles).

    A sketch has the bits of its shingles set, so two sets differ in at least as many shingles as their
    sketches do in bits. Repeats change nothing: shingles are rows that whole-stage code folds.
    """
    raw = texts.select("k", F.col("norm").cast("binary").alias("raw")).withColumn("n", F.greatest(F.octet_length("raw") - (SHINGLE - 1), F.lit(1)))
    rows = raw.select("k", "raw", "n", F.explode(F.sequence(F.lit(1), "n", F.lit(CHUNK))).alias("i"))
    h = [F.hash(F.substring("raw", F.least(F.col("i") + d, F.col("n")), F.lit(SHINGLE))) for d in range(CHUNK)]
    h = rows.select("k", "n", *(x.alias(f"h{d}") for d, x in enumerate(h)))
    word = [F.col(f"h{d}").bitwiseAND(F.lit(SKETCH - 1)).alias(f"w{d}") for d in range(CHUNK)]
    bit = [F.expr(f"shiftleft(1L, shiftright(h{d}, 8) & 63)").alias(f"b{d}") for d in range(CHUNK)]
    h = h.select("k", "n", *word, *bit)
    none = F.lit(0).cast("long")
    of = lambda j: reduce(Column.bitwiseOR, (F.when(F.col(f"w{d}") == j, F.col(f"b{d}")).otherwise(none) for d in range(CHUNK)))
    return h.groupBy("k", "n").agg(*(F.bit_or(of(j)).alias(f"s{j}") for j in range(SKETCH)))


def _side(x: str) -> list[Column]:
    """n and the sketch as side x of a pair; none is null, which spares the pairs' code a test for each."""
    return [F.coalesce(c, F.lit(0)).cast("double" if c == "n" else "long").alias(f"{c}{x}") for c in ("n", *(f"s{j}" for j in range(SKETCH)))]


def _bits() -> Column:
    """Bits in which the sketches of sides a and b differ; doubles are added without tests for overflow, which keeps the code short enough to be compiled."""
    return sum((F.bit_count(F.col(f"s{j}a").bitwiseXOR(F.col(f"s{j}b"))).cast("double") for j in range(SKETCH)), F.lit(0.0))


def _may() -> Column:
    """Sets of n and m shingles with similarity s differ in (n + m)(1 - s) / (1 + s) shingles at most, so the others are not similar for certain."""
    return F.lit(5.0 + LEAST) * _bits() <= F.lit(5.0 - LEAST) * (F.col("na") + F.col("nb"))


def _apart(members: DataFrame, of: DataFrame, texts: DataFrame) -> DataFrame:
    """(band, k) -> (a, b, ga, gb, d): the pairs of a bucket in two components that may be similar, once for each pair.

    Blocks of a bucket meet in pairs, each a group of its own, but those of its largest component never each
    other; lines that share several buckets meet in the first of them. Sketches rule out what is not similar
    within the join, so that its rows follow the similar pairs and not the bucket's pairs.
    """
    of = small(of).select(F.col("node").alias("k"), "component")
    members = written(members.join(of, "k", "left").select("band", "k", F.coalesce("component", "k").alias("g")), "large")
    mixed = members.join(mixed_buckets(members, "band", BLOCK), "band")
    # the buckets of a line are as many as its bands at most
    lines = written(mixed.groupBy("k").agg(F.first("g").alias("g"), F.array_sort(F.collect_list(F.struct("band", "main", "n_main", "n_rest"))).alias("in")), "mixed")
    sketches = written(_sketches(texts.join(small(lines).select("k"), "k", "left_semi")), "sketches")
    words = ["n", *(f"s{j}" for j in range(SKETCH))]
    dealt = lines.join(small(sketches), "k").select("k", "g", *words, "in", F.posexplode("in").alias("at", "b"))
    before = F.transform(F.slice("in", F.lit(1), F.col("at")), lambda x: x["band"]).alias("before")
    in_main = F.col("g") == F.col("b.main")
    part, pairs_of = cells(F.struct("k", F.lit(1)), in_main, F.col("b.n_main"), F.col("b.n_rest"))
    dealt = dealt.select("k", "g", *words, before, "b.band", part.alias("part"), F.explode(pairs_of).alias("c"))
    sides = []
    for x, own in (("a", F.col("part") == F.col("c.i")), ("b", F.col("part") == F.col("c.j"))):
        columns = [F.col(c).alias(f"{c}{x}") for c in ("k", "g", "before")]
        sides.append(dealt.where(own).select("band", "c.i", "c.j", *columns, *_side(x)))
    once = (F.col("x.i") < F.col("x.j")) | (F.col("ka") < F.col("kb"))
    x, y = (side.alias(c) for side, c in zip(sides, "xy", strict=True))
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "i", "j")]
    pairs = x.join(y, [*on, once, F.col("ga") != F.col("gb"), _may(), ~F.arrays_overlap("beforea", "beforeb")])
    turned = F.col("ka") > F.col("kb")
    low, high = (F.struct(F.col(f"k{c}").alias("k"), F.col(f"g{c}").alias("g")) for c in "ab")
    pairs = pairs.select(F.when(turned, high).otherwise(low).alias("p"), F.when(turned, low).otherwise(high).alias("q"), _bits().alias("d"))
    return pairs.select(F.col("p.k").alias("a"), F.col("q.k").alias("b"), F.col("p.g").alias("ga"), F.col("q.g").alias("gb"), "d")


def components(sigs: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(k, bands), equal lines as often as they occur -> (node, component) of the similar lines that share a band.

    texts_of gives the (k, norm) of the keys (k) it is handed, once for each. Every line of a bucket is
    compared with the bucket's leader, the line that occurs most: of a line and its variants mostly the
    line itself. Then every other pair of a bucket that still lies in two components is compared, unless
    sketches rule it out.
    """
    rows = sigs.select("k", F.explode("bands").alias("band"))
    with scratch() as kept:
        # a bucket of equal lines alone has nothing to compare
        often = written(rows.groupBy("band").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high").select("band"), "often")
        members = written(rows.join(small(often), "band").groupBy("band", "k").agg(F.count(F.lit(1)).alias("w")), "members")
        leader = F.max_by("k", F.struct("w", F.xxhash64("k"))).alias("leader")
        buckets = members.groupBy("band").agg(leader)
        shared = written(members.join(buckets.select("band", "leader"), "band").where("k <> leader").select("band", "k", "leader"), "shared")
        keys = written(shared.select("k").unionByName(shared.select(F.col("leader").alias("k"))).distinct(), "keys")
        texts = written(texts_of(keys), "texts")
        pairs = shared.select(F.least("k", "leader").alias("a"), F.greatest("k", "leader").alias("b")).distinct()
        of = written(connected_components(_similar(pairs, texts)), "of")
        kept.append(written(settled(of, _apart(shared.select("band", "k"), of, texts), lambda p: _similar(p, texts)), "components"))
    return kept[0]


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, th, n_lines, at: lines that are not blank, and the positions, from 0 and ascending, of those to drop.

    One line of each component is kept: the first by doc_id (rows without one first), th and position.
    Equal lines are one node; rows equal in doc_id and text are one document and lose the same lines.
    Blank lines are never dropped; null and blank texts have no row here.
    """
    place = ["doc_id", "th", "pos"]
    with scratch() as kept:
        flat = [F.col("bands")[b].alias(f"b{b}") for b in range(len(BANDS))]
        seen = written(signatures(_lines(docs), [*place, "k"]).select(*place, "k", *flat), "seen")

        def texts_of(keys: DataFrame) -> DataFrame:
            firsts = seen.join(small(keys), "k", "left_semi").groupBy("k").agg(F.min(F.struct(*place)).alias("at"))
            at = written(firsts.groupBy("at.doc_id", "at.th").agg(F.collect_list("at.pos").alias("places")), "places")
            rows = _rows(docs).alias("d").join(small(at).alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.th") == F.col("p.th")))
            cut = F.array(F.struct(_split("text").alias("lines"), F.col("places")))
            found = F.flatten(F.transform(cut, lambda c: F.transform(c["places"], lambda i: F.get(c["lines"], i))))
            found = rows.select(F.explode(found).alias("line")).select(_norm(F.col("line")).alias("norm"))
            return found.groupBy(F.xxhash64("norm").alias("k")).agg(F.first("norm").alias("norm"))

        of = components(seen.select("k", F.array(*(f"b{b}" for b in range(len(BANDS)))).alias("bands")), texts_of)
        of = small(of).withColumnRenamed("node", "k")
        named = seen.select(*place, "k").join(of, "k", "left").select(*place, F.coalesce("component", "k").alias("g"))
        order = F.struct(F.col("doc_id").isNotNull().alias("known"), *place)
        best = named.groupBy("g").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "best")
        gone = named.join(small(written(best, "best")), "g").where(order != F.col("best"))
        gone = written(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("pos")).alias("at")), "gone")
        counts = seen.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n_lines")).alias("c")
        same = F.col("c.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("c.th") == F.col("x.th"))
        none = F.array().cast("array<int>")
        rows = counts.join(small(gone).alias("x"), same, "left").select("c.doc_id", "c.th", "n_lines", F.coalesce("at", none).alias("at"))
        kept.append(written(rows, "marked"))
    return kept[0]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept (both without blank lines), dropped: positions from 0, comma-joined; a row for each document."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th")).alias("d")
    by = small(marked(docs)).alias("x")
    found = rows.join(by, F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.th") == F.col("x.th")), "left")
    n, gone = F.coalesce("n_lines", F.lit(0).cast("long")), F.coalesce("at", F.array().cast("array<int>"))
    return found.select(
        "d.doc_id", n.alias("n_lines"), (n - F.size(gone)).alias("n_kept"), F.array_join(gone.cast("array<string>"), ",").alias("dropped")
    )


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the lines to drop taken out of `text`; blank lines and all other columns stay as they are."""
    i, th, at = fresh(docs, "line_doc", "line_text", "line_at")
    by = small(marked(docs)).where(F.size("at") > 0).select(F.col("doc_id").alias(i), F.col("th").alias(th), F.col("at").alias(at))
    text = F.col("text").cast("string")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(th))
    cut = F.array(F.struct(F.split(text, "\n").alias("lines"), F.col(at).alias("at")))

    def left(c: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(c["lines"]) - 1), c["at"])
        return F.array_join(F.transform(stay, lambda p: F.get(c["lines"], p)), "\n")

    new = F.when(F.col(at).isNull(), text).otherwise(F.transform(cut, left)[0])
    return docs.join(by, on, "left").withColumn("text", new).select(*docs.columns)
