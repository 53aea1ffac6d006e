import zlib
from hashlib import sha256

import pytest

from tabsmith.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def folded(nodes):
    """Top of a row of digests, and per place the siblings as (left, right) lists."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, mine = [], []
        for lo in range(0, len(nodes), 8):
            run = nodes[lo: lo + 8]
            for k in range(len(run)):
                for place in owners[lo + k]:
                    paths[place].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(h("".join(run)))
            mine.append([p for o in owners[lo: lo + 8] for p in o])
        nodes, owners = above, mine
    return nodes[0], paths


def plain(rows):
    """The contract, straight; rows are (doc_id, text, lang, source, n_chars)."""
    by = {}
    for d, t, g, s, n in rows:
        by.setdefault(g, []).append((d, leaf(d, s, g, n, t), (d, s, g, n, t)))
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        by[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[g] = folded([x[1] for x in by[g]])
    root, tops = folded([subs[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (d, own, f), path in zip(by[g], subs[g][1], strict=True):
            path = path + tops[k]
            now = own
            if d is not None and zlib.crc32(str(d).encode()) % 3 == 0:
                low = None if f[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in f[4])
                now = leaf(*f[:4], low)
            for left, right in path:
                now = h(left + now + right)
            out.append((d, own, subs[g][0], root, h("".join(a + b for a, b in path)), now, now == root))
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 511, 512, 513])
def test_sweeps_of_a_segment(n):
    nodes = [h(str(i)) for i in range(n)]
    root, paths = folded(nodes)
    levels = merkle.levels_of(n)
    assert merkle.top(nodes, levels) == root
    made = merkle.backward(nodes, levels, "")
    assert [[tuple(s.split("|")) for s in p.split("/")] if p else [] for p in made] == paths
    assert all(merkle.fold(x, p) == root for x, p in zip(nodes, made, strict=True))


def test_manifest_equals_plain(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in odd_docs.collect()]
    assert got(merkle.manifest(odd_docs)) == sorted(plain(rows), key=str)
    assert merkle.manifest(no_docs).count() == 0


def test_many_segments_one_hot_language(spark):
    # 9001 rows of one language: three segments, two rounds; 70 small languages: two levels above them
    rows = [(i, f"Text {i % 97} É", "xx" if i < 9001 else f"l{i % 70}", None if i % 5 else "s", i) for i in range(9400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert got(merkle.manifest(df)) == sorted(plain(rows), key=str)


def test_one_document(spark):
    rows = [(5, "A", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(merkle.manifest(df)) == plain(rows)
    assert got(merkle.manifest(df))[0][4] == h("")
