import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import mixing, packing
from tabsmith.llm.order import running_start

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Re-share the excess by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = float(most * sizes[s])
            open_.discard(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 3}, {"x": 5}, {"a": 0, "b": 7}, {"a": 0},
                                   {f"s{i}": (i * 37) % 101 + 1 for i in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_mix_takes_near_targets_and_no_text_too_often(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    src = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    taken, target, size = {}, {}, {}
    for r in rows:
        s = src[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK + 0.02 * target[s] for s in taken)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 128, 1000000007 % 4099):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(13).cast("bigint")).alias("p"))
        assert sorted(r["p"] for r in df.collect()) == list(range(n))


@pytest.mark.parametrize("n", [40_000, 117_345, 500_000])
def test_shards_draw_their_source_counts(spark, n):
    """Shares of 0.2, 0.33 and 0.47 in shards of 1024: mean and variance as drawn, at every slot count."""
    parts = [int(0.2 * n), int(0.33 * n)]
    parts.append(n - sum(parts))
    src = spark.createDataFrame([(s, i, k * 128, float(k * 128)) for i, (s, k) in enumerate(zip("abc", parts, strict=True))],
                                "source string, rank int, source_size long, target double")
    slots = mixing.plan_slots(src)
    assert slots.agg(F.count_distinct("slot"), F.min("slot"), F.max("slot")).first()[:] == (n, 0, n - 1)
    rows = mixing.shard_counts(slots).filter(f"shard < {n // 1024}").collect()
    for s, k in zip("abc", parts, strict=True):
        got = np.array([r["n"] for r in rows if r["source"] == s], float)
        p = k / n
        want = 1024 * p * (1 - p) * (n - 1024) / (n - 1)
        assert len(got) == n // 1024 and abs(got.mean() - 1024 * p) < 5 * (want / len(got)) ** 0.5
        assert abs(got.var() / want - 1) < 5 * (2 / len(got)) ** 0.5


def test_running_start_follows_one_order(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 11).alias("v"))
    a = {r["k"]: r["s"] for r in running_start(df, "g", "k", "v", "s", 500, 1).collect()}
    b = {r["k"]: r["s"] for r in running_start(df.repartition(5), "g", "k", "v", "s", 4, 1).collect()}
    assert a == b
    rows = {r["k"]: (r["g"], r["v"]) for r in df.collect()}
    for g in "012":
        ends = sorted((a[k], a[k] + v) for k, (h, v) in rows.items() if h == g)
        assert ends[0][0] == 0 and all(x[1] == y[0] for x, y in itertools.pairwise(ends))


def test_mixed_texts_hold_what_mix_takes(spark, odd_docs):
    small = odd_docs.filter("doc_id is null or doc_id <> 9")
    for docs in (small, spark.read.parquet(f"{SF}/documents.parquet")):
        want = {}
        for r in mixing.mix(docs).collect():
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
        pieces = mixing.mixed_texts(docs).collect()
        got = {}
        for r in pieces:
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
        texts = {}
        for r in docs.select("doc_id", "text").collect():
            texts.setdefault(r["doc_id"], []).append(r["text"] or "")
        assert all(any(r["text"] in t for t in texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in pieces)


def test_mix_odd_and_empty(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0) and sum(r["size"] == 0 for r in rows) == 3
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_texts(no_docs).count() == 0


def padding(tops, lengths):
    return sum(min(t for t in tops if t >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(30):
        x = sorted(rng.sample(range(60), rng.randint(1, 8)))
        c = [rng.randint(1, 9) for _ in x]
        lengths = [n for n, k in zip(x, c, strict=True) for _ in range(k)]
        for b in (1, 2, 3, 5):
            got = packing.boundaries(x, c, b)
            best = min(padding((*t, x[-1]), lengths) for t in itertools.combinations(x[:-1], min(b, len(x)) - 1))
            assert len(got) <= b and got[-1] == x[-1] and padding(got, lengths) == best
    assert packing.boundaries([], [], 3) == []


def test_long_boundaries_are_optimal():
    rng = random.Random(6)
    for k in (5, 9, 14):
        x = sorted(rng.sample(range(257, 9000), k))
        c = [rng.choice([1, 3, 400]) for _ in x]
        lengths = [n for n, m in zip(x, c, strict=True) for _ in range(m)]
        for b in (2, 3, 4):
            best = min(padding((*t, x[-1]), lengths) for t in itertools.combinations(x[:-1], min(b, k) - 1))
            assert padding(packing.boundaries(x, c, b), lengths) == best
    # every layer in full against the halving
    n = 700
    x, c = np.cumsum(np.array([rng.randint(1, 40) for _ in range(n)])), np.array([rng.choice([1, 5, 900]) for _ in range(n)])
    rows, mass = np.append(0, np.cumsum(c)), np.append(0, np.cumsum(c * x))
    best = x * rows[1:] - mass[1:]
    for _ in range(11):
        best = np.array([min(np.append(0, best)[: j + 1] + x[j] * (rows[j + 1] - rows[: j + 1]) - (mass[j + 1] - mass[: j + 1])) for j in range(n)])
    tops = np.array(packing.boundaries(x, c, 12))
    assert (c * (tops[np.searchsorted(tops, x)] - x)).sum() == best[-1]


def test_pack_pads_to_lengths_that_exist(spark):
    """A third of all documents have 5461 words: no padding, and three in a batch of 16384."""
    n = F.when(F.col("id") % 3 == 0, 5461).otherwise(F.col("id") * 20)
    rows = packing.pack(spark.range(600).select(F.col("id").alias("doc_id"), n.alias("n")), length=F.col("n")).collect()
    assert {r["bucket"] for r in rows} <= {r["n_tokens"] for r in rows}
    many = [r for r in rows if r["n_tokens"] == 5461]
    assert {(r["bucket"], r["padding"]) for r in many} == {(5461, 0)} and max(r["place"] for r in many) == 2


def test_pack_fills_batches(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df, budget in ((docs, 4096), (odd_docs, 64)):
        rows = packing.pack(df, budget=budget).collect()
        assert len(rows) == df.count()
        batches = {}
        for r in rows:
            assert r["n_tokens"] <= r["bucket"] and r["padding"] == r["bucket"] - r["n_tokens"]
            batches.setdefault((r["bucket"], r["batch"]), []).append(r["place"])
        for (bucket, batch), places in batches.items():
            fit = max(1, budget // max(1, bucket))
            assert sorted(places) == list(range(len(places))) and len(places) <= fit
            # only a bucket's last batch may be short
            assert len(places) == fit or (bucket, batch + 1) not in batches
    assert packing.pack(no_docs).count() == 0


def test_op10_matches_sql_is_registered():
    from tabsmith.llm import queries
    assert "op10_mixing" in queries.ORACLE and os.path.isdir(SF)
