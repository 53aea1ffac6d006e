import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import lattice, minhash, ngram_join
from tabsmith.llm.components import components
from tabsmith.llm.rtree import Links
from tabsmith.llm.text import shingle_sets, words

SF = "/root/testdata/sf0.001"


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def alike(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def plain_groups(rows):
    """Brute force: (doc_id, n, component) per row."""
    sets = [sets_of(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][0] is not None and rows[j][0] is not None and alike(sets[i], sets[j]) and comp[i] != comp[j]:
            old, new = comp[j], comp[i]
            comp = [new if c == old else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted(((d, len(s), least.get(c) if d is not None else None) for (d, _), s, c in zip(rows, sets, comp, strict=True)), key=str)


def copies(seed, n, near):
    """Base texts with chains of near copies around the threshold, and a passage that many share."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    passage = rng.choices(vocab, k=40)
    rows = []
    for i in range(n):
        base = rng.choices(vocab, k=rng.choice([3, 6, 20, 60, 150]))
        if i % 3 == 0:
            base = base + passage
        for _ in range(rng.choice([1, 2, near])):
            rows.append((len(rows), " ".join(base)))
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
    return rows


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"mass": 600, "most": 4})])
def test_join_groups_against_brute_force(spark, seed, limits):
    rows = copies(seed, 25, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.join_groups(df.repartition(5), **limits).collect()), key=str)
    assert got == plain_groups(rows)


def test_join_groups_odd(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in ngram_join.join_groups(odd_docs).collect()), key=str)
    assert got == plain_groups(rows)
    assert ngram_join.join_groups(no_docs).count() == 0


def test_packs_number_all_their_sets(spark):
    """More distinct short texts in a partition than 16 bits number; every one has a copy in another task."""
    text = F.when(F.col("id") % 80_000 < 60, "").otherwise(F.concat(F.lit("t"), F.col("id") % 80_000)).alias("text")
    docs = spark.range(0, 160_000, 1, 2).select(F.col("id").alias("doc_id"), text)
    got = ngram_join.shared(docs).agg(F.count(F.lit(1)), F.min("shared"), F.max("shared")).first()
    assert tuple(got) == (79_940, 2, 2)


def test_shared_shingles_are_shuffled_part_by_part(spark, monkeypatch):
    rows = copies(4, 20, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    turns = []
    monkeypatch.setattr(ngram_join, "_spread", lambda *a, made=ngram_join._spread: turns.append(a) or made(*a))
    got = [sorted(map(tuple, ngram_join.shared(docs, r).collect())) for r in (1, 2, 3)]
    assert got[0] == got[1] == got[2] and len(turns) == 6
    assert sorted(map(tuple, ngram_join.shared(docs).collect())) == got[0] and len({t[1] for t in turns[6:]}) > 1


def test_only_texts_of_wanted_rows_meet_them(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    wanted = ngram_join.first_rows(ngram_join.set_rows(docs)).filter("doc_id % 1000 = 7").cache()
    passed = docs.filter(ngram_join._maybe(wanted, 1024))
    assert passed.filter("doc_id % 1000 = 7").count() == 20 and passed.count() < 1000
    assert sorted(r[0] for r in ngram_join.sets_of(docs, wanted).select("doc_id").collect()) == [1000 * i + 7 for i in range(20)]


def test_rtree_finds_all_components():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2 ** 63, rng.integers(1, 80)).astype(np.uint64)
        for _ in range(rng.integers(1, 6)):
            sets.append(np.unique(base))
            base = base.copy()
            base[rng.integers(0, len(base), max(1, len(base) // 12))] = rng.integers(0, 2 ** 63)
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    tree = Links(off, np.concatenate(sets), 3, 4)
    found = tree.run()
    label = np.arange(len(sets))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 4 * both >= 3 * (len(sets[i]) + len(sets[j]) - both):
            label[label == label[j]] = label[i]
    assert all(label[a] == label[b] for a, b in found) and len(np.unique(tree.label)) == len(np.unique(label))
    half = len(sets) // 2
    across = Links(off, np.concatenate(sets), 3, 4, np.arange(len(sets)))
    across.run(np.arange(half), np.arange(half, len(sets)))
    assert all(label[i] == label[j] for i in range(len(sets)) for j in range(len(sets)) if across.label[i] == across.label[j])


def test_words_and_shingles(monkeypatch):
    texts = [None, "", " ", "a", "A b", "one two three four FIVE six", "x\x0by\x1cz é", "  lead", "p q r s t " * 50]
    monkeypatch.setattr("tabsmith.llm.text.CHUNK", 40)
    n = [0] * len(texts)
    for w in words(pa.array(texts)):
        for i in range(w.first, w.last):
            n[i] = int(w.counts[i - w.first])
    assert n == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    sizes = [int(off[i - a + 1] - off[i - a]) for a, b, off, h in shingle_sets(pa.array(texts)) for i in range(a, b)]
    assert sizes == [len(sets_of(t)) for t in texts]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (5, 9), (9, 5), (0, 3)] + [(1000, 1000 + i) for i in range(1, 200)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 9: 5, 0: 0, 3: 0, **{i: 1000 for i in range(1000, 1200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_against_exact(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in minhash.edited_likeness(docs).collect()}
    err = []
    for k, (i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        a, b, c = sets_of(t), sets_of(t[: len(t) - half] + nxt[:half]), sets_of(nxt)
        err += [got[i]["near_edited"] - len(a & b) / len(a | b), got[i]["near_next"] - len(a & c) / len(a | c)]
        assert got[i]["n_chars"] == len(t)
    assert abs(np.mean(err)) < 0.01 and np.abs(err).max() < 0.2
    prints = {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprint(docs).collect()}
    assert prints == {i: r["fingerprint"] for i, r in got.items()}


def test_minhash_odd(spark, odd_docs, no_docs):
    import hashlib
    rows = minhash.edited_likeness(odd_docs).collect()
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd_docs.select("doc_id", "text").collect()))
    want = []
    for k, (_, _, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][2]
        want.append(hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest())
    assert sorted(r["edited_sha256"] for r in rows) == sorted(want)
    by = {r["doc_id"]: r for r in rows}
    assert by[7]["fingerprint"] == by[8]["fingerprint"] and by[4]["fingerprint"] == by[5]["fingerprint"] == by[6]["fingerprint"]
    assert by[4]["near_next"] == 1.0 and by[6]["near_next"] == 0.0
    assert minhash.edited_likeness(no_docs).count() == 0
    one = minhash.edited_likeness(spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_minhash_groups(spark):
    rows = copies(8, 20, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_groups(df).collect()), key=str)
    want = plain_groups(rows)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.95 * len(want)


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.nearest_e8(x)
    whole, half = np.allclose, p * 2 % 2
    assert whole(p * 2, np.round(p * 2)) and np.all(half == half[:, :1]) and np.all(p.sum(1) % 2 == 0)
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS ** 2).sum(1), 2)
    best = ((x[:, None] - p[:, None] - lattice.ROOTS) ** 2).sum(2).min(1)
    assert np.all(((x - p) ** 2).sum(1) <= best + 1e-9)


def plain_links(vecs, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vecs]
    unit = [np.array(v) / np.linalg.norm(v) if k else None for v, k in zip(vecs, ok, strict=True)]
    return {(i, j) for i, j in itertools.combinations(range(len(vecs)), 2)
            if ok[i] and ok[j] and len(vecs[i]) == len(vecs[j]) and unit[i] @ unit[j] >= least}


@pytest.mark.parametrize("most", [4096, 6])
def test_lattice_recall_and_counts(spark, most):
    rng = np.random.default_rng(2)
    vecs = []
    for _ in range(120):
        v = rng.normal(size=24).astype(np.float32).astype(float)
        for _ in range(rng.integers(1, 6)):
            vecs.append(v.tolist())
            v = (v + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.2])).astype(np.float32).astype(float)
    vecs += [None, [], [0.0] * 24, [float("nan")] * 24, [1.0] * 3, [2.0] * 3, [None] * 24, [float("inf")] + [1.0] * 23]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, n long, key long")
    got = {r["vec_id"]: r for r in lattice.near_duplicates(df.repartition(3), most=most).collect()}
    links = plain_links(vecs)
    deg = np.zeros(len(vecs), int)
    for i, j in links:
        deg[i] += 1
        deg[j] += 1
    mine = np.array([got[i]["n_links"] for i in range(len(vecs))])
    assert np.all(mine <= deg) and mine.sum() >= 0.97 * deg.sum()
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    assert got[len(vecs) - 4]["component_id"] == len(vecs) - 4 or got[len(vecs) - 4]["n_links"] == 1
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(len(vecs) - 8, len(vecs) - 4))


@pytest.mark.parametrize("width", [64, 768])
def test_lattice_recall_among_real_and_wide_vectors(spark, width):
    """Links planted at a cosine of 0.95 to 0.99 among the given vectors (64) or random ones (768)."""
    rng = np.random.default_rng(width)
    if width == 64:
        base = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()], float)
    else:
        base = rng.standard_normal((500, width))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.99, (len(base), 1))
    every = np.concatenate([base, cos * base + np.sqrt(1 - cos ** 2) * noise])
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in lattice.near_duplicates(df.repartition(3)).collect()}
    assert links.sum() >= len(every) and all(got[i] <= n for i, n in enumerate(links))
    assert sum(got.values()) >= 0.95 * links.sum()


def test_lattice_repeats_and_empty(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [-2.0, 1.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in lattice.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (3, 3, 1, False), (None, 3, None, False), (4, 0, 4, True), (None, 0, None, False)], key=str)
    assert lattice.near_duplicates(df.limit(0)).count() == 0
