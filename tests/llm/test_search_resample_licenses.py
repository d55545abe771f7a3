"""Ranked search, importance resampling and license scans against brute force, their SQL twins, and edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from runlens import scratch
from runlens.llm import licenses, resampling, search, sql, words

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RNG = np.random.default_rng(5)
STOCK = ["".join(RNG.choice(list("abcdefgh"), RNG.integers(1, 4))) for _ in range(150)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(STOCK, n))


def of(text):
    return WORD.findall((text or "").translate(LOWER))


ODD = [(None, "Tie one"), (7, "Tie one"), (7, "Tie one"), (8, None), (9, ""), (10, " .,\x00\t "), (11, "É Ünï中 文\U0001f600 ÉCOLE éCole"), (12, "x" * 70_000 + " end"), (13, "a b c " * 40_000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = ODD + [(100 + i, prose(3 + i % 90, i % 160)) for i in range(300)]
    schema = "doc_id long, text string, q long, term string, score long, rank long, n long, place long"
    return spark.createDataFrame([(*r, 1, "t", 2, 3, 4, 5) for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, prose(30, 1)), (1, prose(30, 1)), (2, "tie ONE"), (3, None), (4, ""), (5, "nowhere"), (None, prose(5, 3)), (6, "école ÉCOLE a a a"), (7, prose(60, 2))]
    return spark.createDataFrame([(*r, "z") for r in rows], "item_id long, text string, doc_id string")


def test_words_are_those_of_the_pattern():
    texts = [t for _, t in ODD] + [prose(50, 1), "A--b_C9 Kelvin İst"]
    flat, sizes = words.words(pa.array(texts))
    assert flat.to_pylist() == [w for t in texts for w in of(t)] and sizes.tolist() == [len(of(t)) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(words.slices(iter([batch]), limit=100))
    assert len(parts) > 3 and [x for p in parts for x in p["text"].to_pylist()] == texts
    sliced = batch.slice(3)["text"]
    assert words.words(sliced)[0].to_pylist() == [w for t in texts[3:] for w in of(t)]


def ranked(rows, queries, k=10):
    posts, sizes = defaultdict(dict), []
    for r, (_, text) in enumerate(rows):
        sizes.append(len(of(text)))
        for t, n in Counter(of(text)).items():
            posts[t][r] = n
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    out = []
    for item, text in queries:
        scores = Counter()
        for t, times in Counter(of(text)).items():
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * len(posts[t]) + 1))) if t in posts else 0
            for r, tf in posts[t].items():
                scores[r] += times * w * ((1_000_000_000 * tf) // (1000 * tf + 8 * (25 + (75 * sizes[r] * n) // total)))
        best = sorted(((-s, rows[r][0] is None, rows[r][0] or 0, rows[r][0]) for r, s in scores.items() if s > 0))[:k]
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(best)]
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("block", "front"), [(8192, 16), (23, 2)])
def test_search_equals_brute_force(docs, items, monkeypatch, block, front):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "CHUNK", 4 if block < 100 else 256)
    rows, queries = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    blocks = search.index(docs)
    assert blocks.select(F.sum(F.size("docs"))).first()[0] == len(rows)
    assert plain(search.search(blocks, items)) == ranked(rows, queries)


def test_tasks_hold_one_block_at_a_time(spark, docs, items, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 23)
    sizes, size, written = {}, "spark.sql.execution.arrow.maxRecordsPerBatch", search.written

    def spy(df, name="t", **options):
        sizes[name] = spark.conf.get(size), options
        return written(df, name, **options)

    monkeypatch.setattr(search, "written", spy)
    before = spark.conf.get(size)
    assert search.search(search.index(docs), items).count() > 0
    assert sizes["index"][1] == {"large_rows": True} and sizes["found"][0] == "1" and spark.conf.get(size) == before


def test_large_rows_have_row_groups_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(scratch, "LARGE", 64 << 10)
    with scratch.scratch():
        rows = scratch.written(spark.range(12, numPartitions=1).select("id", F.expr("transform(sequence(1, 20000), x -> xxhash64(id, x))").alias("v")), large_rows=True)
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in rows.inputFiles()]
        assert [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)] == [1] * 12
        assert rows.selectExpr("sum(id)", "sum(size(v))").first() == (66, 240_000)


def test_treaps_prune_and_split():
    rng = np.random.default_rng(2)
    docs, ends, posted, x = 4000, [], [], []
    for n in (4000, 900, 30, 1):
        posted += sorted(rng.choice(docs, n, replace=False).tolist())
        x += rng.integers(1, 1000, n).tolist()
        ends.append(len(posted))
    x[:2000] = [500] * 2000  # a long run of ties
    t = search.Treaps(np.array(ends), np.array(posted), np.array(x), docs)
    for node in range(len(posted)):
        for child, side in ((t.left[node], -1), (t.right[node], 1)):
            assert child == t.none or (t.x[child] <= t.x[node] and (t.doc[child] - t.doc[node]) * side > 0)
    seen = []
    split = t.split
    t.split = lambda node, *a: seen.append(len(node)) or split(node, *a)
    q, d, score = search.search_block(t, docs, np.array([[0, 1, 2, 3]]), np.array([[1, 5, 90, 400]]), np.zeros(1, np.int64), 10)
    want = np.zeros(docs, np.int64)
    for a, b, w in zip([0, *ends], ends, (1, 5, 90, 400), strict=False):
        want[posted[a:b]] += w * np.array(x[a:b])
    order = np.lexsort((np.arange(docs), -want))[:10]
    assert d.tolist() == order.tolist() and score.tolist() == want[order].tolist()
    assert sum(seen) / 4 < 1000  # of 4,000 documents


def test_search_of_nothing(spark, docs, items):
    assert search.search(search.index(docs.limit(0)), items).count() == 0
    assert search.search(search.index(docs), items.limit(0)).count() == 0
    assert search.search(search.index(docs.where("doc_id in (8, 9, 10)")), items).count() == 0


def test_crc_of_any_length():
    texts = ["", "a", "é", "x" * 64, "y" * 65, "z" * 5000, *STOCK]
    column = pa.array(["skip", *texts]).slice(1)
    assert resampling.crc32(column).tolist() == [zlib.crc32(t.encode()) for t in texts]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_features_equal_brute_force(longest):
    texts = [t for _, t in ODD] + [prose(40, i) for i in range(20)]
    found, sizes = resampling.feature_buckets(pa.array(texts), 97, longest)
    want = [Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 97 for n in range(1, longest + 1) for i in range(len(w) - n + 1)) for w in map(of, texts)]
    ends = np.cumsum(sizes)
    assert [Counter(found[a:b].tolist()) for a, b in zip([0, *ends], ends, strict=False)] == want


def test_resampling_equals_brute_force(docs, items):
    def features(text):
        w = of(text)
        return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    s, t = Counter(f for _, x in rows for f in features(x)), Counter(f for r in items.collect() for f in features(r.text))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)}
    want, drawn = [], []
    for doc, text in rows:
        f = features(text)
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append((doc, len(f), weight, score))
        drawn += [(-score, doc is None, doc or 0)] * (len(of(text)) >= 20)
    got = resampling.resample(docs, items).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    best = sorted(drawn)[: len(drawn) // 4]
    assert sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r["rank"] is not None) == [(i + 1, *b) for i, b in enumerate(best)]


def test_resampling_of_nothing(docs, items):
    assert resampling.resample(docs.limit(0), items).count() == 0
    got = resampling.resample(docs, items.limit(0)).collect()
    assert len(got) == docs.count() and sum(r["rank"] is not None for r in got) > 0


def test_a_row_repeated_often_is_ranked_once_each(spark):
    same = spark.range(20_000).select(F.lit(1).cast("long").alias("doc"), F.lit(5).cast("long").alias("score"), F.lit(True).alias("ok"))
    got = resampling.ranked(same, "score", "doc", "ok", 25)
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 5001))


LICENSED = {
    1: "Released UNDER the MIT-License. More.", 2: "under the mit license under the mit license apache LICENSE, version 2.0", 3: "cc by nc cc by nc by nc", 4: "cc by\x00nd nc mit mit mit",
    5: "under the mit licence", 6: None, 7: "", 8: "...", 9: "cc by nc", 10: "x " * 30_000 + "under the mit license" + " y" * 30_000, 11: "İCC BY NC CC BY NC", 12: "This work is licensed under the GNU General Public License, version 3.",
}


def test_licenses_equal_brute_force(spark):
    rows = [*LICENSED.items(), (None, "cc by nc"), (1, LICENSED[1]), (1, "another text of one id: apache license version 2")]
    docs = spark.createDataFrame([(*r, 1, 2, "l") for r in rows], "doc_id long, text string, pos int, template int, label string").repartition(3)
    want = []
    for doc, text in rows:
        w = of(text)
        at = [(i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((doc, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    got = licenses.digest(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert {r.labels for r in got if r.doc_id == 12} == {"gpl-3"} and {r.score for r in got if r.doc_id in (7, 8)} == {0.0}
    assert licenses.digest(docs.limit(0)).count() == 0
    kept = licenses.labelled(docs.withColumn("licenses", F.lit("mine")))
    assert kept.columns == [*docs.columns, "licenses", "licenses_"] and kept.count() == len(rows)
    assert all(r.licenses_ == ["mit"] for r in kept.where("doc_id = 1 and text like 'Released%'").collect())


def test_notices_with_words_put_in_and_left_out(spark):
    notice = of(next(text for label, text in licenses.NOTICES if label == "isc"))
    more = notice[:10] + ["really"] + notice[10:20] + notice[21:]
    half = notice[: len(notice) // 2]
    apart = notice[: len(notice) // 2] + ["filler"] * 300 + notice[len(notice) // 2 :]
    rows = [(1, "so " * 50 + " ".join(more) + " end" * 9), (2, " ".join(half)), (3, " ".join(apart)), (4, " ".join(notice * 3))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ok = {i: [(s.first, s.last) for s in r.spans if s.ok] for i, r in got.items()}
    n = len(notice)
    assert ok == {1: [(50, 50 + n - 1)], 2: [], 3: [], 4: [(0, n - 1), (n, 2 * n - 1), (2 * n, 3 * n - 1)]}
    assert 0.8 <= got[1].spans[0].share < 1 and 0.4 < got[2].spans[0].share < 0.6


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_importance_resampling", "op13_license_scan"])
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == rows
    assert sql.OP11 and len(rows) > 50


COLUMNS = {
    "op1": {"doc_id", "fingerprint", "component_id"}, "op2": {"doc_id", "held_out", "score", "predicted"}, "op3": {"doc_id"}, "op4": {"doc_id", "dropped"}, "op5": {"vec_id", "n_links", "component_id", "kept"},
    "op6": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op7": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op8": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}, "op9": {"doc_id", "held_out", "lang_pred", "score"},
    "op10": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op11": {"item_id", "rank", "doc_id", "score"}, "op12": {"doc_id", "n_features", "weight", "score", "rank"},
    "op13": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
}


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_every_query_runs_over_its_whole_table(spark, op):
    found = {name: f for name, f in __spark_entry__.queries().items() if name.split("_")[0] == op}
    assert len(found) == 1
    out = next(iter(found.values()))(spark, SF)
    assert COLUMNS[op] <= set(out.columns)
    ids = {"op5": "vec_id", "op11": "item_id"}.get(op, "doc_id")
    source = {"op5": "embeddings", "op11": "benchmark"}.get(op, "documents")
    want = {r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(ids).collect()}
    assert {r[0] for r in out.select(ids).collect()} == want
