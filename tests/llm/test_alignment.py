import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    import os

    import sentencepiece
    from tokenizers import Tokenizer
    if not os.path.isdir(alignment.FOLDER):
        pytest.skip("no tokenizer files")
    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.FILE_A}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.FILE_B}")


def spans(text, libraries):
    """Both token rows as (id, first byte, end byte), or None; from the libraries' own vocabularies."""
    a, b = libraries
    signs = alignment.byte_of_sign()
    whole, out = (" " + text).encode(), []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    parts_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
    parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    for ids, parts in ((ids_a, parts_a), (ids_b, parts_b)):
        if b"".join(parts) != whole:
            return None
        ends = np.cumsum([len(p) for p in parts]).tolist()
        out.append([(i, e - len(p), e) for i, p, e in zip(ids, parts, ends, strict=True)])
    return out


def brute(rows, libraries):
    """The contract, straight: every A token against every B token."""
    import hashlib
    from collections import Counter
    linked, made = [], []
    for _, text in rows:
        got = spans(text, libraries) if text else None
        if not got:
            linked.append([])
            made.append((0, 0, 0, ""))
            continue
        a, b = got
        linked.append([(x, y) for x, s, e in a for y, t, f in b if max(s, t) < min(e, f)])
        cuts, pos, groups = sorted({e for *_, e in a} & {e for *_, e in b}), 0, []
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if pos <= s and e <= c) for side in (a, b)))
            pos = c
        made.append((len(a), len(b), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for ps in linked for p in set(ps))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    return sorted((i or 0, *m[:3], len(ps), sum(count[p] == most[p[0]] for p in ps), sum(count[p] for p in ps), m[3])
                  for (i, _), m, ps in zip(rows, made, linked, strict=True))


def flat(df):
    return sorted((r["doc_id"] or 0, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


def test_alignment_equals_brute_force(spark, libraries):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 1500).select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in rows]
    assert len(rows) > 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert flat(alignment.align(df)) == brute(rows, libraries)


def test_alignment_odd_rows(spark, odd_docs, no_docs, libraries):
    got = alignment.align(odd_docs)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    short = odd_docs.filter("doc_id is null or doc_id <> 9")
    assert flat(alignment.align(short)) == brute([(r["doc_id"], r["text"]) for r in short.collect()], libraries)
    zero = {r["doc_id"]: r for r in got.collect()}
    assert zero[4]["n_links"] == zero[5]["n_a"] == 0 and zero[5]["groups_sha256"] == ""
    assert got.count() == len(rows)
    assert alignment.align(no_docs).count() == 0


def test_alignment_signs_and_special_strings(spark, libraries):
    texts = ["<|endoftext|> <s> </s> <0x41> <unk>", "▁ is not a space", "  two  spaces \n\t", "é\U0001F600 漢字", "it's we'll they've", "x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, texts[0]), (9, texts[0])]
    assert flat(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, libraries)


def test_chunks_planes_and_bits(spark, libraries, monkeypatch):
    # small chunks and containers: several chunks a task, bits and slots, planes of many repeats
    monkeypatch.setattr(alignment, "SLOTS", 64)
    monkeypatch.setattr(alignment, "SPARSE", 8)
    rows = [(i, "a a a a a " * (1 + i % 7) + f"word{i % 11} tail") for i in range(150)]
    pair = alignment.Pair(*[open(f"{alignment.FOLDER}/{f}", "rb").read() for f in (alignment.FILE_A, alignment.FILE_B)])
    links, total, by_plane = alignment.Index(), {}, {}
    got = pair.align([t for _, t in rows[:64]])
    links.add(got["text"], got["pair"])
    for plane, pairs, counts, slots in links.planes():
        for lo, c, p in zip(np.cumsum(counts) - counts, counts, pairs, strict=True):
            for s in slots[lo: lo + c].tolist():
                total[int(s), int(p)] = total.get((int(s), int(p)), 0) + (1 << max(plane, 0))
        by_plane[plane] = (pairs, counts, slots)
    from collections import Counter
    assert total == dict(Counter(zip(got["text"].tolist(), got["pair"].tolist(), strict=True)))
    batches = [b for plane, x in by_plane.items() for b in alignment._containers(5, pair.width, plane, *x) if b.num_rows]
    assert {b.column("dense")[0].as_py() for b in batches} == {False, True}
    # the postings return count 3 of every pair, as if each were its A id's best
    right = pa.Table.from_batches(batches).select(["plane", "dense", "docs"])
    right = right.append_column("n_docs", pa.array([3] * len(right), pa.int64())).append_column("is_best", pa.array([True] * len(right)))
    left = pa.table({"slot": pa.array(range(64), pa.int32()), "doc_id": range(64), **{k: got[k] for k in ("n_a", "n_b", "n_groups", "n_links")},
                     "groups_sha256": [""] * 64})
    scored = alignment._scores(left, right)
    assert scored["n_best"].to_pylist() == got["n_links"].tolist()
    assert scored["count_sum"].to_pylist() == (3 * got["n_links"]).tolist()


def test_long_runs(spark, libraries):
    texts = [" " * 300_000, "a" * 200_000, "word " * 60_000]
    rows = alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == 3 and all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] for r in rows)
    assert all(r["n_a"] > 0 for r in rows)
