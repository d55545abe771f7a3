"""The corpus operators against brute force, exact round trips and edge cases."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from runlens.llm import embedding_dedup, language_id, line_dedup, packing, pii, sentencepiece_codec, sharding, simhash, sketches, toxicity

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
P = pytest.importorskip("public_tokenizers")
RNG = np.random.default_rng(3)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(2, 8))) for _ in range(800)]
EXTRA = "lang string, source string, fp long, k long, n long, row long, part int, g long"


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def edited(text, places):
    w = text.split(" ")
    for p in places:
        w[p] = "edited"
    return " ".join(w)


TEXTS = {
    1: prose(120, 1), 2: edited(prose(120, 1), [50]), 3: prose(120, 1), 4: prose(90, 2), 5: edited(prose(90, 2), [3, 60]), 6: "", 7: None, 8: "  \n\t ",
    9: "one two", 10: "One TWO", 11: prose(3000, 3), 12: "é" * 40_000, 13: "x" * 70_000, 14: prose(40, 4) + "\n" + prose(40, 5), 15: prose(40, 5) + "\n\nsmall\n" + prose(40, 6),
    16: "naïve Ünïcode 中文 \U0001f600 text", 17: prose(9000, 7), 20: prose(60, 8),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 2, 3, 4, 5, 6) for i, t in TEXTS.items()] + [(None, prose(30, 9), None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def components(ids, near):
    label = {i: i for i in ids}
    while True:
        new = {i: min([label[j] for j in ids if near(i, j)] + [label[i]]) for i in ids}
        if new == label:
            return label
        label = new


def test_simhash_equals_brute_force(docs):
    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = by_id(simhash.near_duplicates(docs))
    want = {i: fingerprint(t) for i, t in TEXTS.items()}
    assert {i: int(got[i].fingerprint, 16) for i in TEXTS} == want
    assert {i: got[i].component_id for i in TEXTS} == components(list(TEXTS), lambda i, j: (want[i] ^ want[j]).bit_count() <= 4)
    assert got[1].component_id == got[3].component_id == 1 and got[6].component_id == got[7].component_id == got[8].component_id == 6


def test_exploded_keys_are_not_broadcast(spark):
    rows = spark.range(100).select(F.col("id").alias("fp"), F.col("id").alias("rep"), F.explode(F.sequence(F.lit(1), F.lit(31))).alias("k"))
    assert "Broadcast" not in simhash._dealt(rows, F.col("fp"))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_some_mask_covers_every_difference(radius):
    masks = simhash.covering_masks(radius)
    for _ in range(500):
        bits = RNG.choice(64, radius, replace=False)
        assert any(not any(m >> int(b) & 1 for b in bits) for m in masks)


def test_large_buckets_are_cut_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    fps = sorted({int(x) for x in np.bitwise_xor(np.int64(12345), np.left_shift(np.int64(1), RNG.integers(0, 40, 60)))})
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    from runlens.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.links(reps, 4)).collect()}
    assert got == dict.fromkeys(range(len(fps)), 0)


def test_one_of_each_similar_group_stays(docs):
    kept = sorted(r.doc_id for r in simhash.keep_one(docs.where("doc_id is not null")).collect())
    def shingles(i):
        w = (TEXTS[i] or "").lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def near(i, j):
        a, b = shingles(i), shingles(j)
        return len(a & b) >= 0.8 * len(a | b)

    assert kept == sorted({*components(list(TEXTS), near).values()})
    assert simhash.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("block", [8, 1024])
def test_families_of_one_word_set_are_searched_whole(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    words, rng, rows = prose(150, 11).split(" "), np.random.default_rng(12), []
    for i in range(0, 60, 2):
        order = rng.permutation(words).tolist()
        swapped = order[:70] + order[71:69:-1] + order[72:]
        rows += [(i, " ".join(order)), (i + 1, " ".join(swapped))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))


def test_repeated_rows_and_empty_tables(spark, docs):
    twice = docs.where("doc_id in (4, 20)").unionByName(docs.where("doc_id = 20"))
    assert simhash.near_duplicates(twice).count() == 3 and sorted(r.doc_id for r in simhash.keep_one(twice).collect()) == [4, 20]
    none = docs.limit(0)
    model, labels = P.path("word_bpe_49k.json"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (simhash.near_duplicates(none), simhash.keep_one(none), toxicity.score(none, toxicity.fit(none, labels)), line_dedup.digest(none), line_dedup.dedup(none), sketches.fingerprints(none), sharding.shard(none), packing.pack(none, model), language_id.identify(none), pii.digest(none), pii.redact(none), sentencepiece_codec.digest(none, P.path("piece_bpe_32k.model"))):
        assert out.count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_lines_equal_brute_force(docs):
    def shingles(line):
        b = line.encode()
        return {b[k : k + 9] for k in range(max(1, len(b) - 8))}

    lines = [(i, p, n) for i, t in sorted(TEXTS.items()) for p, x in enumerate((t or "").split("\n")) if (n := x.lower().strip(" \t\r\x0b\x0c"))]
    sets = {n: shingles(n) for _, _, n in lines}
    label = components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    first, dropped = {}, {i: [] for i in TEXTS}
    for i, p, n in lines:
        if first.setdefault(label[n], (i, p)) != (i, p):
            dropped[i].append(p)
    got = by_id(line_dedup.digest(docs.where("doc_id is not null")))
    assert {i: got[i].dropped for i in TEXTS} == {i: ",".join(map(str, d)) for i, d in dropped.items()}
    clean = by_id(line_dedup.dedup(docs))
    assert clean[14].text == TEXTS[14] and clean[15].text == "\nsmall\n" + prose(40, 6) and clean[7].text is None and clean[3].text == ""
    assert line_dedup.dedup(docs).columns == docs.columns


def shingle_sets(texts):
    return [{b[k : k + 9] for k in range(max(1, len(b) - 8))} for b in (t.encode() for t in texts)]


@pytest.mark.parametrize("block", [8, 1024])
def test_lines_of_large_buckets_are_searched_whole(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block, raising=False)
    rng, texts = np.random.default_rng(5), set()
    for family in range(4):
        base = prose(20, 100 + family)
        texts |= {edited(base, rng.choice(20, rng.integers(0, 4), replace=False)).replace("edited", WORDS[rng.integers(800)]) for _ in range(100)}
    texts = sorted(texts)
    lines = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "k long, norm string, w long").repartition(3)
    bands = {r.k: set(r.bands) for r in line_dedup.signatures(lines).groupBy("k").agg(F.flatten(F.collect_list("bands")).alias("bands")).collect()}
    sets = shingle_sets(texts)
    near = {(i, j) for i in range(len(texts)) for j in range(len(texts)) if bands[i] & bands[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    want = components(range(len(texts)), lambda i, j: (i, j) in near)
    sigs = line_dedup.signatures(lines)
    found = line_dedup.components(sigs, lambda keys: lines.join(keys, "k", "left_semi").select("k", "norm"))
    got = {r.node: r.component for r in found.collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == want


def test_chains_of_lines_are_one_component(spark):
    words = prose(40, 21).split(" ")
    chain = [" ".join(words[: 40 - i]) for i in range(0, 24)]  # neighbours are similar, the ends are not
    rows = [(i, t) for i, t in enumerate(chain)] + [(100 + i, chain[0]) for i in range(9)] + [(200 + i, chain[23]) for i in range(9)]
    got = by_id(line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    sets = shingle_sets(chain)
    near = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets, sets[1:], strict=False)]
    assert all(near) and len(sets[0] & sets[23]) < 0.5 * len(sets[0] | sets[23])
    assert sum(r.n_kept for r in got.values()) == got[0].n_kept == 1


def test_lines_of_clashing_columns_long_texts_and_repeated_rows(spark):
    long = "\n".join([prose(12, 31), "own line of the long text", *[prose(12, 31)] * 150_000])
    rows = [(1, long, 1, 2, 3, 4, 5, 6), (1, long, 1, 2, 3, 4, 5, 6), (2, prose(12, 31), 1, 2, 3, 4, 5, 6), (3, None, 1, 2, 3, 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _th int, _at int, line_doc int, line_at int, at int")
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns and out.count() == 4
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert got == {(1, prose(12, 31) + "\nown line of the long text"), (2, ""), (3, None)}
    kept = simhash.keep_one(docs.where("doc_id <> 1"))
    assert kept.columns == docs.columns and kept.count() == 2 and kept.first()["_id"] == 1


def test_recall_of_similar_lines(spark):
    rng = np.random.default_rng(17)
    base = [prose(30, 500 + i) for i in range(300)]
    digits = ["".join(np.random.default_rng(900 + i).choice(list("0123457"), 300)) for i in range(100)]
    near = [edited(t, rng.choice(30, 2, replace=False)) for t in base] + [t[:150] + "9" * int(rng.integers(1, 12)) + t[150 + 5 :] for t in digits]
    lines = spark.createDataFrame(list(enumerate([*base, *digits, *near])), "k long, norm string").repartition(3)
    sets = shingle_sets([*base, *digits, *near])
    true = {i for i in range(400) if len(sets[i] & sets[400 + i]) >= 0.8 * len(sets[i] | sets[400 + i])}
    found = line_dedup.components(line_dedup.signatures(lines), lambda keys: lines.join(keys, "k", "left_semi"))
    got = {r.node for r in found.collect() if r.node != r.component}
    assert len(true) > 100 and len(true & {i - 400 for i in got}) >= 0.95 * len(true)


@pytest.mark.parametrize("size", [5, 10, 20, 50, 200])
def test_pairs_of_similarity_four_fifths_share_a_band(spark, size):
    """size shingles in the union, four fifths of them in both: the chance is 0.982 by the design of the bands."""
    rng = np.random.default_rng(size)
    text = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), size + 8)) for _ in range(1500)]
    rows = [(i, t[: len(t) - size // 5]) for i, t in enumerate(text)] + [(10_000 + i, t) for i, t in enumerate(text)]
    bands = {r.k: set(r.bands) for r in line_dedup.signatures(spark.createDataFrame(rows, "k long, norm string")).collect()}
    assert np.mean([bool(bands[i] & bands[10_000 + i]) for i in range(1500)]) >= 0.97


def test_a_component_that_fills_a_bucket_costs_no_pairs_of_its_own(spark, monkeypatch):
    from runlens.llm import components as C

    rows = [(1, i, 7 if i < 5000 else i) for i in range(5003)] + [(2, i, 9) for i in range(50)]
    members = spark.createDataFrame(rows, "band long, k long, g long")
    mixed = C.mixed_buckets(members, "band", 64).collect()
    assert [(r.band, r.main, r.n_main, r.n_rest) for r in mixed] == [(1, 7, 79, 1)]
    part, pairs = C.cells(F.col("k"), F.col("g") == F.col("main"), F.col("n_main"), F.col("n_rest"))
    dealt = members.join(C.mixed_buckets(members, "band", 64), "band").select("k", "g", part.alias("part"), F.explode(pairs).alias("c")).collect()
    cells = {}
    for r in dealt:
        cells.setdefault((r.c.i, r.c.j), []).append((r.k, r.part))
    met = {(min(a, b), max(a, b)) for (i, j), m in cells.items() for a, x in m for b, y in m if a != b and (i == j or x != y)}
    assert met == {(min(a, b), b) for a in range(5003) for b in range(5000, 5003) if a < b}


def test_the_join_of_a_bucket_lets_through_only_what_whole_sketches_allow(spark):
    """Its rows would grow with the square of a bucket if it compared part of the sketches."""
    from runlens.scratch import scratch, written

    texts = [prose(30, 700 + i) for i in range(30)] + ["-" * 50, "-" * 90]
    texts += [edited(texts[0], [3]), edited(texts[1], [3, 9])]
    sets = shingle_sets(texts)
    with scratch():
        lines = spark.createDataFrame(list(enumerate(texts)), "k long, norm string")
        got = {r.k: r for r in line_dedup._sketches(lines).collect()}
        bits = {i: [r[f"s{j}"] % 2**64 for j in range(line_dedup.SKETCH)] for i, r in got.items()}
        differ = lambda i, j: sum((x ^ y).bit_count() for x, y in zip(bits[i], bits[j], strict=True))
        assert all(differ(i, j) <= len(sets[i] ^ sets[j]) and got[i].n >= len(sets[i]) for i in got for j in got)
        assert differ(30, 31) == 0
        of = written(spark.createDataFrame([], "node long, component long"), "of")
        apart = line_dedup._apart(lines.selectExpr("7L as band", "k"), of, lines)
        assert {(r.a, r.b) for r in apart.collect()} >= {(i, j) for i in got for j in got if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        assert apart.count() < 10
        joins = [x for x in apart._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
        assert max(x.count("bit_count") for x in joins) == line_dedup.SKETCH


def test_two_threads_keep_their_scratch_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    docs = spark.createDataFrame([(i, prose(20, i % 7)) for i in range(40)], "doc_id long, text string")
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(lambda: line_dedup.digest(docs).collect()) for _ in range(2)] + [pool.submit(lambda: simhash.keep_one(docs).collect())]
        assert [len(r.result()) for r in runs] == [40, 40, 7]


def test_long_lines_without_common_characters_are_linked(spark):
    digits = "".join(np.random.default_rng(8).choice(list("0123457"), 400))
    rows = [(1, digits), (2, digits[:200] + "9" + digits[201:]), (3, digits[::-1])]
    got = by_id(line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].n_kept for i in (1, 2, 3)] == [1, 0, 1]


def test_toxic_words_and_passages(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(WORDS, 60))
        toxic = i % 4 == 0
        if toxic:
            words[20:24] = ["Vilewort", "trashling", "vilewort", "trashling"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400)) and got[900].score == got[901].score < 0.5
    span = got[0].passages[0]
    assert rows[0][1][span.start : span.end].split()[0] == "Vilewort" and len(rows[0][1][span.start : span.end].split()) == 4
    assert sorted(r.doc_id for r in toxicity.reject(docs, toxicity.fit(docs, labels)).collect()) == [*(i for i in range(400) if i % 4), 900, 901]


def test_maximal_segments_are_found_in_linear_time():
    import time

    began = time.time()
    found = toxicity.maximal_segments([(-1.5 if i % 2 else 1.0, i, i + 1) for i in range(200_000)])
    assert len(found) == 100_000 and time.time() - began < 5


def test_scores_equal_a_plain_sum_over_passages(spark):
    rows = [(i, " ".join(np.random.default_rng(i).choice(WORDS, 40)) + (" vilewort" * 3 if i % 4 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    a, b, c = model.weights
    got = by_id(toxicity.score(docs, model))
    for i, text in rows[:60]:
        words = [x.lower() for x in re.findall(r"[^\W_]+", text)]
        s = [model.word(w) for w in words]
        best, sums = 0.0, []
        steps = [(v, k, k + 1) for k, v in enumerate(s)]
        sums = [v for v, _, _ in toxicity.maximal_segments(steps)]
        p = lambda v: 1 - np.exp(-model.rate * len(words) * np.exp(-model.decay * v))  # noqa: E731, B023
        x, y = (-np.log(max(p(max(sums)), 1e-12)), np.log1p(sum(v for v in sums if p(v) < toxicity.SIGNIFICANT))) if sums else (0.0, 0.0)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(a + b * x + c * y))), abs=1e-6)


def test_maximal_segments_against_brute_force():
    for seed in range(30):
        s = np.random.default_rng(seed).normal(-0.2, 1, 12)
        got = toxicity.maximal_segments([(float(x), i, i + 1) for i, x in enumerate(s)])
        def best(a, b):  # recursively: the best segment, then what lies beside it
            found = [(s[i:j].sum(), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not found or max(found)[0] <= 0:
                return []
            _, _, i, j = max(found, key=lambda x: (round(x[0], 9), x[1]))
            return [*best(a, i), (i, j), *best(j, b)]
        assert [(a, b) for _, a, b in got] == best(0, len(s))


@pytest.mark.parametrize("chunk", [64, 16_384])
def test_pieces_equal_the_library(docs, monkeypatch, chunk):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_codec, "CHUNK", chunk)
    path = P.path("piece_bpe_32k.model")
    if chunk == 64:  # workers read the module's own value: try the parts here
        c = sentencepiece_codec.Codec(path)
        for t in [*filter(None, TEXTS.values()), "  spaced   out  " * 20, "averyveryunbrokenwordthatgoeson" * 30]:
            text = c.normal(t[:3000])
            spans = []
            for at in range(0, len(text), chunk):
                entry, leave = sentencepiece_codec.chunk_matrix(c, text, at)
                entry = [x for x in entry if x < max(leave)]
                if entry:
                    spans.append({(a, b): (s, f, g, ()) for a, b, s, f, g in c.transfer(text, entry, leave)})
            whole = spans[0]
            for x in spans[1:]:
                whole = c.combine(whole, x)
            (a, b), (_, _, _, cuts) = max(whole.items(), key=lambda x: x[1][0])
            at = [a, *cuts, b]
            ids = b"".join(c.encode_normal(text[x:y]) for x, y in zip(at, at[1:], strict=False))
            assert np.frombuffer(ids, "<u4").tolist() == c.whole.encode(t[:3000])
        return
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(sentencepiece_codec.digest(docs, path))
    for i, t in TEXTS.items():
        ids = lib.encode(t or "")
        assert (got[i].n_pieces, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_copies_of_a_vector_are_one_node(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 32))
    near = a + rng.normal(size=32) * 0.05
    rows = [(i, a.tolist()) for i in range(5, 305)] + [(2, near.tolist()), (1000, b.tolist()), (1001, b.tolist()), (1001, b.tolist())]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got[2] == (300, 2, True) and all(got[i] == (300, 2, False) for i in range(5, 305)) and got[1000] == (1, 1000, True) and got[1001] == (1, 1000, False)


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    base = RNG.normal(size=(40, 16))
    x = np.concatenate([base, base[:5] + RNG.normal(size=(5, 16)) * 0.05, base[0] + RNG.normal(size=(90, 16)) * 0.08]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [None] + [1.0] * 15), (503, [float("nan")] * 16), (504, [1.0, 2.0]), (505, []), (None, x[0].tolist())]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = components(range(len(x)), lambda i, j: near[i, j])
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(x))} == {i: (int(near[i].sum()), label[i], label[i] == i) for i in range(len(x))}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(500, 506)) and got[None].kept is False


def test_deep_trees_find_the_links_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 16)  # a depth of 7
    rng = np.random.default_rng(6)
    base = rng.normal(size=(800, 64))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * rng.uniform(0.05, 0.32, (800, 1))]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = sum(r.n_links for r in embedding_dedup.near_duplicates(table).collect())
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = int((u @ u.T >= 0.95).sum()) - len(x)
    assert true > 1000 and 0.97 * true <= found <= true


def test_first_fit_against_the_plain_scan():
    lengths = np.sort(RNG.integers(1, 100, 200))[::-1]
    bins, offsets = packing.first_fit(lengths, 100)
    room = []
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(100)
        assert (b, o) == (at, 100 - room[at])
        room[at] -= n


def test_packed_ids_are_the_library_s(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack(docs, P.path("word_bpe_49k.json")).toPandas()
    for i, text in TEXTS.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096


@pytest.mark.parametrize("word", ["don't", "It's", "ÀÉÎ", "ß", "naïve,", "x²", "<|endoftext|>", "a_b", "--", "1234", "…", "中文", "é", "ﬁ", "don't<b>", "I'LL", "ǅ", " x"])
def test_words_are_split_as_the_library_does(word):
    w = packing.words(P.path("word_bpe_49k.json"))
    assert np.frombuffer(w.ids(f"a {word} b"), "<u4").tolist() == w.whole.encode(f"a {word} b", add_special_tokens=False).ids


def test_shards_move_only_into_the_new_one(docs):
    got = by_id(sharding.shard(docs))
    assert all((got[i].size, got[i].text_crc32) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in TEXTS.items())
    assert all(r.grown_shard in (r.shard, 40) for r in got.values())
    for s in {r.shard for r in got.values()}:
        slots = sorted(r.slot for r in got.values() if r.shard == s)
        assert slots == list(range(len(slots)))
    def jump(key, n):  # the published loop
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b
    keys = RNG.integers(0, 2**63, 500, dtype=np.uint64)
    assert sharding.jump_hash(keys, 40).tolist() == [jump(int(k), 40) for k in keys]


def test_sketches_estimate_and_merge(docs):
    got, ids = by_id(sketches.fingerprints(docs.where("doc_id is not null"))), sorted(TEXTS)
    for k, i in enumerate(ids):
        text, after = TEXTS[i] or "", TEXTS[ids[(k + 1) % len(ids)]] or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        sets = [{b[j : j + 16] for j in range(max(1, len(b) - 15))} if (b := x.encode()) else set() for x in (text, new)]
        exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0
        assert got[i].near_edited == pytest.approx(exact, abs=0.25)
    assert got[1].fingerprint == got[3].fingerprint and got[6].fingerprint == got[7].fingerprint == ""
    data = TEXTS[17].encode()
    parts = sketches.merge(sketches.bottom(sketches.window_hashes(data[:20_015])), sketches.bottom(sketches.window_hashes(data[20_000:])))
    for i in (1, 4, 17):
        sets = [{x.encode()[j : j + 16] for j in range(len(x.encode()) - 15)} for x in (TEXTS[i], TEXTS[i][: len(TEXTS[i]) - len(TEXTS[i]) // 4])]
        assert got[i].distinct_shingles == pytest.approx(len(sets[0]), rel=0.4) and got[i].contained_edited == pytest.approx(len(sets[0] & sets[1]) / len(sets[0]), abs=0.2)
    assert sketches.containment(sketches.bottom(np.arange(10, dtype=np.uint64)), sketches.bottom(np.arange(5, dtype=np.uint64))) == pytest.approx(0.5)
    assert parts.tolist() == sketches.bottom(sketches.window_hashes(data)).tolist() == sketches.decode(got[17].fingerprint).tolist()
    assert sketches.distinct(parts) == pytest.approx(len({data[j : j + 16] for j in range(len(data) - 15)}), rel=0.4)


def test_languages_words_first_then_grams(spark):
    a, b = ["haus", "und", "nicht", "ich", "schön"], ["house", "and", "not", "with", "the"]
    rows = [(i, " ".join(np.random.default_rng(i).choice(a if i % 2 else b, 30)), "de" if i % 2 else "en") for i in range(90)]
    rows += [(200, "schönheit nichtig", None), (201, None, "en"), (202, "123 !?", "de"), (203, "withthe", None)]
    got = by_id(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i].lang_pred == ("de" if i % 2 else "en") and 0 <= got[i].score <= 1 for i in range(90))
    assert [got[i].lang_pred for i in (200, 201, 202, 203)] == ["de", "und", "und", "en"]


def test_other_numerals_are_no_letters(spark):
    rows = [(i, "haus und hof" if i % 2 else "house and yard", "de" if i % 2 else "en") for i in range(30)]
    rows += [(100 + i, t, None) for i, t in enumerate(["²", "½ ①", "Ⅳ", "x² ½haus", "", None])]
    got = by_id(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert [got[100 + i].lang_pred for i in range(6)] == ["und", "und", "und", "de", "und", "und"]
    assert language_id.letters("A²bc ⅣÉ_é9z") == ["a", "bc", "é", "é", "z"]


def test_language_scores_equal_brute_force():
    import math
    import tracemalloc

    rng = np.random.default_rng(4)
    counts = [(f"l{i:03}", w, int(rng.integers(2, 40))) for i in range(300) for w in rng.choice(WORDS, 20, replace=False)]
    tracemalloc.start()
    model = language_id.Model(counts)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    langs, have = sorted({c[0] for c in counts}), {(w, lang): n for lang, w, n in counts}

    def table(weights):
        sums = {}
        for key, lang, x in weights:
            sums[key, lang] = sums.get((key, lang), 0) + x
        keys = {k for k, _ in sums}
        totals = {lang: sum(x for (_, at), x in sums.items() if at == lang) for lang in langs}
        return keys, lambda k: np.array([math.log(sums.get((k, lang), 0) + 1) - math.log(totals[lang] + len(keys) + 1) for lang in langs])

    words, of_word = table((w, lang, n) for lang, w, n in counts)
    grams = {size: table((f" {w} "[i : i + size], lang, 1 + math.log(n)) for lang, w, n in counts for i in range(len(w) + 3 - size)) for size in range(1, 6)}

    def score(word):
        if word in words:
            return of_word(word)
        for size in range(5, 0, -1):
            known = [g for i in range(len(word) + 3 - size) if (g := f" {word} "[i : i + size]) in grams[size][0]]
            if known:
                return np.mean([grams[size][1](g) for g in known], axis=0)
        return np.zeros(len(langs))

    scorer = language_id.Scorer(model)
    for text in (" ".join(rng.choice(WORDS, 6)) + " abcdxyz zzzz", "qqq", "abc " * 3 + WORDS[0] + "é"):
        total = sum(score(w) for w in text.split())
        lang, p = scorer.predict(text)
        want = np.exp(total - total.max())
        assert lang == langs[int(total.argmax())] and abs(p - want.max() / want.sum()) < 1e-4
    assert have


PII = {
    1: "mail a.b+c@mail-1.example.com, or x@y, a@b.com_c@d.org now", 2: "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 001.002.003.255", 3: "card 4111 1111 1111 1111 or 4111111111111112",
    4: "call +1 (527) 555-9774 or +12 or +1234567890123456", 5: None, 6: "", 7: "1" * 20_000, 8: "a" * 20_000 + "@b", 9: "+1 (527) 555-9774, 4111-1111-1111-1111 a@b.cc 9.9.9.9" * 30,
    10: "tel (527) 555-9774 and on 2024-01-02, version 10.20.30.4", 11: "é\U0001f600 a@b.cc \U0001f600", 12: "1 2 3 4 5 6 7 8 9 " * 3000, 13: "write jane.doe [at] example [dot] com today", 14: "no digits at all",
}


def base_spans(text):
    def luhn(d):
        return sum(x - 9 * (x > 9) for i, c in enumerate(reversed(d)) for x in [int(c) * (1 + i % 2)]) % 10 == 0

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for k, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            yield m.start(), k, m.end(), kind


def test_long_runs_of_letters_count_whole():
    scorer = language_id.Scorer(language_id.Model([("aa", "ab" * 5, 5), ("bb", "cd" * 5, 5)]))
    run = "ab" * 20 + "cd" * 5000
    assert scorer.predict(run)[0] == scorer.predict(f"{run} {run}")[0] == "bb" and scorer.predict("ab" * 30)[0] == "aa"
    assert run not in scorer.row


def test_personal_data_of_secrets_and_clashing_columns(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'set token = "{key}" here', 1, 2, 3, 4), (2, f"see commit {key} for more", 1, 2, 3, 4), (3, None, 1, 2, 3, 4), (4, "plain words only", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int, spans int, _text int, _digit int")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect() if (r.base, r.spans, r["_text"], r["_digit"]) == (1, 2, 3, 4)}
    assert got == {1: 'set token = "[SECRET]" here', 2: rows[1][1], 3: None, 4: rows[3][1]}
    with pytest.raises(ValueError):
        pii.find(docs)


def test_boosted_trees_equal_their_brute_force(spark):
    trees, least = pii.model(spark)
    texts = [t for t, _ in pii.examples(120, seed=99)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii._candidates(docs).select("doc_id", F.explode("further").alias("x"))
    features = rows.select("doc_id", "x", *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{n}") for n, c in pii._numbers(F.col("x")))).collect()
    def walk(tree, f):
        while not isinstance(tree, float):
            tree = tree[2] if f[tree[0]] <= tree[1] else tree[3]
        return tree
    base = {i: list(base_spans(t)) for i, t in enumerate(texts)}
    want = {i: {(f"{k}", a, e) for a, _, e, k in base[i]} for i in base}
    for r in features:
        x, f = r.x, list(r[2:])
        if sum(walk(t, f) for t in trees) >= least and not any(a < x.end and x.start < e for a, _, e, _ in base[r.doc_id]):
            want[r.doc_id].add((pii.KINDS[x.k], x.start, x.end))
    got = {r.doc_id: {(k, int(a), int(e)) for k, a, e in (s.split(":") for s in filter(None, r.spans.split(",")))} for r in pii.digest(docs).collect()}
    assert got == want and sum(map(len, want.values())) > 40


def test_personal_data_base_and_added(spark):
    docs = spark.createDataFrame(list(PII.items()), "doc_id long, text string")
    got = by_id(pii.digest(docs))
    for i, t in PII.items():
        base = sorted(base_spans(t or ""))
        said = ",".join(f"{k}:{a}:{e}" for a, _, e, k in base)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), i
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))
        assert (got[i].n_email, got[i].n_ip) == tuple(sum(x[3] == k for x in base) for k in ("email", "ip"))
    assert got[10].spans == "number:4:18,ip:46:56" and got[13].spans.startswith("address:") and got[14].spans == "" and got[7].spans == got[12].spans == ""
    clean = by_id(pii.redact(docs))
    assert clean[1].text == "mail [EMAIL], or x@y, [EMAIL][EMAIL] now" and clean[11].text == "é\U0001f600 [EMAIL] \U0001f600" and clean[5].text is None and clean[14].text == PII[14]
