"""The pipeline's stages keep their contract, and its end follows from a plain run of the same steps."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from runlens.llm.common import table, written

    docs = table(spark, SF, "documents")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == names, name
        counts.append(out.count())
        docs = out
    tox, lines, near, pii = counts[1:]
    assert counts[0] >= tox == lines >= near == pii > 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert not any("@mail" in t for t in texts.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(texts) and all(p.offset + p.length <= 4096 for p in pieces)


def components(ids, links):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def similar(sets, least):
    """Pairs of keys whose sets have this similarity, by an index of what they share."""
    where, found = {}, set()
    for k in sets:
        for x in sets[k]:
            where.setdefault(x, []).append(k)
    for k in sets:
        shared = {}
        for x in sets[k]:
            for j in where[x]:
                if j > k:
                    shared[j] = shared.get(j, 0) + 1
        found |= {(k, j) for j, c in shared.items() if c >= least * (len(sets[k]) + len(sets[j]) - c)}
    return found


def test_run_equals_a_plain_run(spark):
    from runlens.llm import pii, toxicity
    from runlens.llm.common import table

    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    scanner = toxicity.Scanner(model)
    texts = {r.doc_id: r.text for r in docs.collect() if model.score(*scanner.segments(r.text or "")) < 0.7}
    # lines
    norm = lambda x: x.lower().strip(" \t\r\x0b\x0c")
    lines = sorted({norm(x) for t in texts.values() for x in t.split("\n")} - {""})
    sets = {i: {(b := n.encode())[k : k + 9] for k in range(max(1, len(n.encode()) - 8))} for i, n in enumerate(lines)}
    group = components(sets, similar(sets, 0.8))
    number, seen, kept = {n: i for i, n in enumerate(lines)}, set(), {}
    for d in sorted(texts):
        stay = []
        for x in texts[d].split("\n"):
            g = group[number[norm(x)]] if norm(x) else None
            if g is None or g not in seen:
                stay.append(x)
            seen.add(g)
        kept[d] = "\n".join(stay)
    # near duplicates
    def words(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {b""}

    sets = {d: words(t) for d, t in kept.items()}
    group = components(sets, similar(sets, 0.8))
    kept = {d: t for d, t in kept.items() if group[d] == d}
    # personal data and packing
    frame = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    clean = {}
    for r in pii.find(frame).collect():
        out, at = [], 0
        for s in r.spans:
            if s.start >= at:
                out += [r.text[at : s.start], f"[{pii.KINDS[s.k].upper()}]"]
            at = max(at, s.end)
        clean[r.doc_id] = "".join(out) + r.text[at:]
    from tokenizers import Tokenizer

    import public_tokenizers

    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id: p.doc_tokens for p in got} == want
