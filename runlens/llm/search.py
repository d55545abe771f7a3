"""Ranked lexical search by inverted treaps.

Documents are indexed where they lie, in blocks of bounded size: for each term the block's postings in
order of doc_id, as one row of a written table, without a shuffle. A search turns the postings of the
terms it asks for into treaps, whose search order is the document and whose heap order is the impact of
the term on it, and walks all treaps of a query together: an interval of documents has, for each term,
the root of the treap's part inside it, hence the largest impact there. An interval whose weighted sum
of maxima cannot enter the best k is dropped whole; of the others the root that promises most is taken,
its document scored in all treaps, and the interval split there. Many intervals of many queries take
each step at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, written
from .words import slices, words

#: Documents and bytes of text of a block at most (a longer text is a block of its own); queries and their bytes in a chunk.
BLOCK = 4096
BLOCK_BYTES = 32 << 20
CHUNK = 256
CHUNK_BYTES = 1 << 20
#: Intervals of one query that take a step together.
FRONT = 16
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_INDEX = "docs array<long>, sizes array<int>, terms array<string>, ends array<int>, posted array<int>, tfs array<int>"


def _block(ids: list[pa.Array], found: list[pa.Array], counts: list[np.ndarray]) -> pa.RecordBatch:
    """One row of the index: the documents in order of doc_id (none last), their sizes, and term by term the places and frequencies of postings."""
    docs, sizes = pa.concat_arrays(ids), np.concatenate(counts)
    order = pc.array_sort_indices(docs, null_placement="at_end").to_numpy() if len(docs) else np.zeros(0, np.int64)
    place = np.empty(len(docs), np.int64)
    place[order] = np.arange(len(docs))
    coded = pa.concat_arrays(found).dictionary_encode()
    pairs, tfs = np.unique(coded.indices.to_numpy().astype(np.int64) * max(len(docs), 1) + np.repeat(place, sizes), return_counts=True)
    ends = np.searchsorted(pairs, np.arange(1, len(coded.dictionary) + 1) * max(len(docs), 1))
    lists = [docs.take(pa.array(order)), pa.array(sizes[order].astype(np.int32)), coded.dictionary]
    lists += [pa.array(a.astype(np.int32)) for a in (ends, pairs % max(len(docs), 1), tfs)]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], names=[c.split(" ")[0] for c in _INDEX.split(", ")])


def index(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> a written table of blocks with all documents and all their terms, repeats counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, counts, rows, held = [], [], [], 0, 0
        for part in slices(batches):
            for batch in (part.slice(i, BLOCK) for i in range(0, len(part), BLOCK)):
                size = batch["text"].nbytes
                if rows and (rows + len(batch) > BLOCK or held + size > BLOCK_BYTES):
                    yield _block(ids, found, counts)
                    ids, found, counts, rows, held = [], [], [], 0, 0
                terms, n = words(batch["text"])
                ids.append(batch["doc_id"])
                found.append(terms)
                counts.append(n)
                rows, held = rows + len(batch), held + size
        if rows:
            yield _block(ids, found, counts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, _INDEX), "index", large_rows=True)


def asked(queries: DataFrame) -> DataFrame:
    """(item_id, text) -> a written table (chunk, q, item_id, term, times): the distinct terms of each query row, in chunks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for piece in slices(batches, limit=CHUNK_BYTES):
            for batch in (piece.slice(i, CHUNK) for i in range(0, len(piece), CHUNK)):
                terms, n = words(batch["text"])
                coded = terms.dictionary_encode()
                pairs, times = np.unique(np.repeat(np.arange(len(n)), n) * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_counts=True)
                at = pa.array(pairs // max(len(coded.dictionary), 1))
                names = coded.dictionary.take(pa.array(pairs % max(len(coded.dictionary), 1)))
                columns = [pa.array(np.full(len(at), part)), at, batch["item_id"].take(at), names, pa.array(times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "q", "item_id", "term", "times"])
                part += 1

    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "part long, q long, item_id long, term string, times long")
    # parts are numbered within a task
    return written(found.select(F.concat_ws("-", F.spark_partition_id(), "part").alias("chunk"), "q", "item_id", "term", "times"), "asked")


def weighted(blocks: DataFrame, terms: DataFrame) -> tuple[DataFrame, int, int]:
    """The chunks of queries, one row for each (chunk, qs, items, terms, weights), N and L. A weight holds a term's repeats; what weighs nothing is left out."""
    df_rows = blocks.select(F.explode(F.arrays_zip("terms", "ends", F.concat(F.array(F.lit(0)), "ends").alias("starts"))).alias("t"))
    df_rows = df_rows.select(F.col("t.terms").alias("term"), (F.col("t.ends") - F.col("t.starts")).alias("df"))
    wanted = written(terms.select("term").distinct(), "terms")
    df = df_rows.where("term is not null").join(small(wanted), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    some = F.filter("sizes", lambda n: n > 0)
    n, total = blocks.agg(F.coalesce(F.sum(F.size(some)), F.lit(0)), F.coalesce(F.sum(F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    w = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("times")
    rows = terms.join(df, "term").withColumn("w", w).where("w > 0").groupBy("chunk").agg(F.collect_list(F.struct("q", "item_id", "term", "w")).alias("r"))
    return rows.select("chunk", *(F.col(f"r.{c}").alias(name) for c, name in (("q", "qs"), ("item_id", "items"), ("term", "wanted"), ("w", "weights")))), n, total


class Treaps:
    """Treaps over postings: `doc`, `x` (impact), `left`, `right` by node, `root` by term. The last node stands for none: behind all documents, without impact."""

    def __init__(self, ends: np.ndarray, doc: np.ndarray, x: np.ndarray, docs: int) -> None:
        n = len(doc)
        self.doc, self.x = np.append(doc, docs).astype(np.int32), np.append(x, 0).astype(np.int64)
        self.left, self.right = np.full(n + 1, n, np.int32), np.full(n + 1, n, np.int32)
        self.root = np.full(len(ends), n, np.int32)
        self.none = n
        mixed = np.random.default_rng(11).permutation(n)  # equal impacts in random order, so that many of them make no deep chain
        back = np.argsort(mixed)
        key = np.append((self.x[:n] << 32) | mixed, -1)
        lo, hi = np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)
        into, at = np.zeros(len(ends), np.int8), np.arange(len(ends))  # where each part's root goes: 0 a term's root, 1 left, 2 right
        while True:
            full = hi > lo
            lo, hi, into, at = lo[full], hi[full], into[full], at[full]
            if not len(lo):
                return
            tops = back[np.maximum.reduceat(key, np.stack([lo, hi], 1).ravel())[::2] & 0xFFFFFFFF]
            for kind, where in enumerate((self.root, self.left, self.right)):
                where[at[into == kind]] = tops[into == kind]
            # parts stay in order, so that reduceat sees rising bounds
            lo, hi = np.stack([lo, tops + 1], 1).ravel(), np.stack([tops, hi], 1).ravel()
            into, at = np.tile(np.array([1, 2], np.int8), len(tops)), np.repeat(tops, 2)

    def split(self, node: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For treaps seen through intervals (lo, hi): the impact on document d in between, and the roots inside (lo, d) and (d, hi)."""
        hit, below, above = np.zeros(len(node), np.int64), np.full(len(node), self.none, np.int32), np.full(len(node), self.none, np.int32)
        on = np.flatnonzero(node != self.none)
        cur, t, a, z = node[on], d[on], lo[on], hi[on]
        want_b, want_a = np.ones(len(on), bool), np.ones(len(on), bool)
        passed = np.zeros(len(on), bool)  # d was met: only the two roots are still looked for
        while len(on):
            at = self.doc[cur]
            less, more, same = at < t, at > t, at == t
            take = want_b & less & (at > a)
            below[on[take]] = cur[take]
            want_b &= ~take
            take = want_a & more & (at < z)
            above[on[take]] = cur[take]
            want_a &= ~take
            new = same & ~passed
            hit[on[new]] = self.x[cur[new]]
            nxt = np.where(less, self.right[cur], self.left[cur])
            if same.any():
                # behind d's own node one root may lie on either side: the other side goes on as an entry of its own
                both = np.flatnonzero(same & want_b & want_a)
                nxt[same & ~want_b] = self.right[cur[same & ~want_b]]
                passed |= same
                extra = on[both], self.right[cur[both]], t[both], a[both], z[both]
            else:
                both = ()
            stay = (nxt != self.none) & ~(passed & ~want_b & ~want_a)
            on, cur, t, a, z, want_b, want_a, passed = (v[stay] for v in (on, nxt, t, a, z, want_b, want_a, passed))
            if len(both):
                on, cur, t, a, z = (np.concatenate([v, e]) for v, e in zip((on, cur, t, a, z), extra, strict=True))
                want_b, want_a = np.append(want_b, np.zeros(len(both), bool)), np.append(want_a, np.ones(len(both), bool))
                passed = np.append(passed, np.ones(len(both), bool))
                live = cur != self.none
                on, cur, t, a, z, want_b, want_a, passed = (v[live] for v in (on, cur, t, a, z, want_b, want_a, passed))
        return hit, below, above


def search_block(treaps: Treaps, docs: int, term: np.ndarray, weight: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of the k best documents of each query, if above 0; ties to earlier documents.

    term and weight have a row for each query (padded with weight 0). What is surely below `floor`, a
    score for each query that k documents reach elsewhere, may be missing.
    """
    queries = len(term)
    best, who = np.zeros((queries, k), np.int64), np.full((queries, k), docs, np.int64)
    root = np.where(weight > 0, treaps.root[term], treaps.none)
    q, lo, hi, node = np.arange(queries), np.full(queries, -1), np.full(queries, docs), root
    bound = (weight * treaps.x[node]).sum(1)
    while True:
        # an interval can still matter if its bound passes the k-th best, or ties with it and begins before its document
        least, last = np.maximum(best[q, -1], floor[q] - 1), np.where(best[q, -1] >= floor[q], who[q, -1], -1)
        live = (bound > least) | ((bound == least) & (lo + 1 < last) & (least > 0))
        q, lo, hi, node, bound = q[live], lo[live], hi[live], node[live], bound[live]
        if not len(q):
            keep = best > 0
            at = np.nonzero(keep)
            return at[0], who[at], best[at]
        order = np.lexsort((-bound, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        now, rest = order[rank < FRONT], order[rank >= FRONT]
        qn, ln, hn, nn = q[now], lo[now], hi[now], node[now]
        gain = weight[qn] * treaps.x[nn]
        d = treaps.doc[nn[np.arange(len(now)), gain.argmax(1)]]
        m = nn.shape[1]
        hit, below, above = (v.reshape(len(now), m) for v in treaps.split(nn.ravel(), np.repeat(d, m), np.repeat(ln, m), np.repeat(hn, m)))
        score = (weight[qn] * hit).sum(1)
        # the new documents join the best of their queries
        mixed_q = np.concatenate([np.repeat(np.arange(queries), k), qn])
        mixed_s, mixed_d = np.concatenate([best.ravel(), score]), np.concatenate([who.ravel(), d])
        order = np.lexsort((mixed_d, -mixed_s, mixed_q))
        first = np.searchsorted(mixed_q[order], np.arange(queries))
        pick = order[first[:, None] + np.arange(k)]
        best, who = mixed_s[pick], mixed_d[pick]
        q = np.concatenate([q[rest], qn, qn])
        lo, hi = np.concatenate([lo[rest], ln, d]), np.concatenate([hi[rest], d, hn])
        node = np.concatenate([node[rest], below, above])
        bound = np.concatenate([bound[rest], (weight[qn] * treaps.x[below]).sum(1), (weight[qn] * treaps.x[above]).sum(1)])


def _matrix(qs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct queries, and their terms and weights in rows."""
    order = np.argsort(qs, kind="stable")
    names, first, n = np.unique(qs[order], return_index=True, return_counts=True)
    row, column = np.repeat(np.arange(len(names)), n), np.arange(len(order)) - np.repeat(first, n)
    term, weight = np.zeros((len(names), n.max(initial=1)), np.int64), np.zeros((len(names), n.max(initial=1)), np.int64)
    term[row, column], weight[row, column] = terms[order], weights[order]
    return names, term, weight


def _searching(n: int, total: int, k: int):
    def one(row: dict, floors: dict) -> pa.RecordBatch:
        docs, sizes = row["docs"].values, row["sizes"].values.to_numpy().astype(np.int64)
        ends, posted, tfs = (row[c].values.to_numpy() for c in ("ends", "posted", "tfs"))
        coded = row["wanted"].values.dictionary_encode()
        at = pc.index_in(coded.dictionary, row["terms"].values)
        at = at.fill_null(-1).to_numpy()
        starts = np.concatenate([[0], ends])
        known = np.flatnonzero(at >= 0)
        spans = [(starts[at[i]], ends[at[i]]) for i in known]
        cut = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, np.int64)
        doc, tf = posted[cut].astype(np.int64), tfs[cut].astype(np.int64)
        m = 25 + (75 * sizes[doc] * n) // max(total, 1)
        treaps = Treaps(np.cumsum([b - a for a, b in spans]).astype(np.int64), doc, (1_000_000_000 * tf) // (1000 * tf + 8 * m), len(docs))
        renamed = np.full(len(coded.dictionary), -1)
        renamed[known] = np.arange(len(known))
        term = renamed[coded.indices.to_numpy()]
        here = term >= 0
        qs, items, weights = (row[c].values for c in ("qs", "items", "weights"))
        names, terms, weight = _matrix(qs.to_numpy()[here], term[here], weights.to_numpy()[here])
        chunk = floors.setdefault(row["chunk"].as_py(), {})
        floor = np.array([chunk.get(q, 0) for q in names.tolist()], np.int64)
        q, d, score = search_block(treaps, len(docs), terms, weight, floor, k)
        full = np.flatnonzero(np.bincount(q, minlength=len(names)) == k)
        least = {int(names[i]): int(score[q == i].min()) for i in full}
        chunk.update({i: max(s, chunk.get(i, 0)) for i, s in least.items()})
        item = dict(zip(qs.to_pylist(), items.to_pylist(), strict=True))
        named = names[q]
        columns = [pa.array([row["chunk"].as_py()] * len(q), pa.string()), pa.array(named), pa.array([item[i] for i in named.tolist()], pa.int64()), docs.take(pa.array(d)), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "q", "item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict = {}  # scores that k documents of this task reach already
        for batch in batches:
            for i in range(len(batch)):
                yield one({c: batch[c][i] for c in batch.schema.names}, floors)

    return run


def search(blocks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """index() of documents, (item_id, text) -> item_id, rank, doc_id, score: the k highest scores above 0 of each query row, ties by ascending doc_id (none last).

    Every query meets every block, in chunks of queries. Query rows without a known term, null texts and
    texts without terms have no results; equal query rows have each their own; equal documents are
    documents of their own and tie in any order. An empty index or no queries give no rows.
    """
    chunks, n, total = weighted(blocks, asked(queries))
    chunks = small(written(chunks, "chunks"))
    # a row holds a whole block, and Arrow batches are filled up to thousands of rows unless told otherwise
    conf = queries.sparkSession.conf
    before = conf.get(_BATCH)
    conf.set(_BATCH, "1")
    try:
        found = blocks.crossJoin(chunks).mapInArrow(_searching(n, total, k), "chunk string, q long, item_id long, doc_id long, score long")
        found = written(found, "found")
    finally:
        conf.set(_BATCH, before)
    best = W.partitionBy("chunk", "q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
