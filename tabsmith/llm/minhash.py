"""Document fingerprints: MinHash over word shingles.

A signature holds, for each of ``PERMS`` universal hash functions ``a x + b`` modulo 2^64 (a odd; the
high bits are the value), the smallest value over the text's shingles.  The fingerprint is the
signature's top ``BITS`` bits per slot in hex; the likeness of two fingerprints, the share of
equal slots, estimates the Jaccard similarity of the shingle sets.

``near_groups`` joins signature bands in Spark: texts that share a band form candidate clusters,
whose pairs are verified by exact Jaccard similarity on the shingles (``ngram_join``).

Cases: null texts count as empty; a text without words has the all-ones signature, like only to
another such text; fewer words than the width: the whole sequence is one shingle; rows follow each
other by doc_id (null first) and equal ids by text, and repeated rows follow themselves; a single
row is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm import ngram_join
from tabsmith.llm.ranges import bounds, part_of, parts_of
from tabsmith.llm.text import random64, shingle_sets
from tabsmith.session import cut_lineage

PERMS = 128
BITS = 16
BANDS = 32
SLICE = 1 << 14
U = np.uint64
FULL = U(2 ** 64 - 1)


def coefficients(perms: int = PERMS) -> tuple[np.ndarray, np.ndarray]:
    return random64(perms, 11) | U(1), random64(perms, 12)


def signatures(column, perms: int = PERMS) -> np.ndarray:
    """(texts, perms) smallest hash values; texts without shingles keep the largest value."""
    a, b = coefficients(perms)
    out = np.full((len(column), perms), FULL, U)
    for first, _, off, h in shingle_sets(column):
        # slices that stay in the processor's cache; a text may go on in the next slice
        for s in range(0, len(h), SLICE):
            x = h[s: s + SLICE]
            lo = int(np.searchsorted(off, s, side="right")) - 1
            cut = np.unique(np.clip(off[lo:], s, s + len(x)))
            cut = cut[cut < s + len(x)]
            rows = first + np.searchsorted(off, cut, side="right") - 1
            y = np.empty_like(x)
            for p in range(perms):
                np.multiply(x, a[p], out=y)
                np.add(y, b[p], out=y)
                out[rows, p] = np.minimum(out[rows, p], np.minimum.reduceat(y, cut - s))
    return out


def slots(sig: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (sig >> U(64 - bits)).astype(np.dtype(f"<u{bits // 8}"))


def fingerprints(sig: np.ndarray, bits: int = BITS) -> list[str]:
    """Hex text of the slots, big end first."""
    return [row.astype(row.dtype.newbyteorder(">")).tobytes().hex() for row in slots(sig, bits)]


def likeness(x: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Share of equal slots; 0 if just one of the two texts has no shingles."""
    same = (slots(x, bits) == slots(y, bits)).mean(1)
    return np.where((x == FULL).all(1) != (y == FULL).all(1), 0.0, same)


def fingerprint(docs: DataFrame, perms: int = PERMS) -> DataFrame:
    """Per row: doc_id, fingerprint."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fingerprints(signatures(b.column(1), perms)), pa.string())],
                names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def followed(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Sorted partitions (part, place, doc_id, text) in which every row is followed by its next document.

    Rows are dealt by ranges of doc_id.  The first row of every range is also the last of the range
    before (place 1), and the very first the last of all, so no row needs another task's rows.
    """
    parts = parts or parts_of(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = bounds(rows, F.col("doc_id"), parts)
    part = part_of(F.col("doc_id"), cuts)
    # one row per range: its first id, null if it holds a null id
    first = F.when(F.count(F.lit(1)) == F.count("doc_id"), F.min("doc_id"))
    lows = {r["part"]: r["low"] for r in rows.select("doc_id", part.alias("part")).groupBy("part").agg(first.alias("low")).collect()}
    have = sorted(lows)
    if not have:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("place"), "doc_id", "text")
    before = {p: have[i - 1] for i, p in enumerate(have)}
    every = range(len(cuts) + 1)
    low = F.array(*[F.lit(lows.get(p)).cast("bigint") for p in every])[F.col("part")]
    known = F.array(*[F.lit(before.get(p)).cast("int") for p in every])[F.col("part")]
    rows = rows.withColumn("part", part)
    here, there = F.struct("part", F.lit(0).alias("place")), F.struct(known.alias("part"), F.lit(1).alias("place"))
    rows = rows.withColumn("to", F.when(F.col("doc_id").eqNullSafe(low), F.array(here, there)).otherwise(F.array(here)))
    rows = rows.select("doc_id", "text", F.explode("to").alias("to")).select("to.part", "to.place", "doc_id", "text")
    return rows.repartition(parts, "part").sortWithinPartitions("part", "place", "doc_id", "text")


def _edited(perms: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])
    piece = 1 << 22

    def rows_of(batches):
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)

    def made(held: list, nexts: list[str]):
        texts = [r[1] for r in held]
        edited = []
        for t, nxt in zip(texts, nexts, strict=True):
            half = len(t) // 2
            edited.append(t[: len(t) - half] + nxt[:half])
        sig = signatures(pa.array([*texts, nexts[-1]], pa.large_string()), perms)
        after = sig[1:].copy()
        for i, (t, nxt) in enumerate(zip(texts, nexts, strict=True)):
            if i + 1 < len(texts) and texts[i + 1] is not nxt:
                after[i] = signatures(pa.array([nxt], pa.large_string()), perms)[0]
        sig, sig2 = sig[:-1], signatures(pa.array(edited, pa.large_string()), perms)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in held], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
             pa.array(fingerprints(sig)), pa.array(fingerprints(sig2)), pa.array(likeness(sig, sig2)),
             pa.array(likeness(sig, after))], schema=schema)

    def run(batches):
        held, nexts, size, last = [], [], 0, None
        for part, place, doc_id, text in rows_of(batches):
            if last is not None and last[0] == part:
                held.append((last[1], last[2]))
                nexts.append(text)
                size += len(text)
                if size >= piece:
                    yield made(held, nexts)
                    held, nexts, size = [], [], 0
            # a range ends with its first guest; rows with the same id as it are further guests
            last = (part if place == 0 else None, doc_id, text)
        if held:
            yield made(held, nexts)

    return run


def edited_likeness(docs: DataFrame, perms: int = PERMS) -> DataFrame:
    """Per row: fingerprints of the text and of its edited text, and their likeness.

    The edited text has the last half of the code points (rounded down) replaced by the first as
    many, or all, of the next document's.  Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    return followed(docs).select("part", "place", "doc_id", "text").mapInArrow(
        _edited(perms), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double")


def near_groups(docs: DataFrame, perms: int = PERMS, bands: int = BANDS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id of the links that bands find and Jaccard (0.75) verifies."""

    def run(batches):
        for b in batches:
            sig = signatures(b.column(0), perms)
            sid = np.zeros(len(sig), np.int64)
            for i, j, off, h in shingle_sets(b.column(0)):
                sid[i:j] = ngram_join.set_ids(off, h)
            width = perms // bands
            some = np.flatnonzero(sid != 0)
            for k in range(bands):
                key = (sig[some, k * width: (k + 1) * width] * (random64(width, 13) | U(1))).sum(1, dtype=U) + U(k)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sid[some])], names=["sig", "sid"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    bands_ = docs.filter("doc_id is not null").select("text").mapInArrow(run, "sig bigint, sid bigint").distinct()
    near = cut_lineage(ngram_join.clusters_of(bands_))
    rows = cut_lineage(ngram_join.set_rows(docs))
    reps = cut_lineage(ngram_join.first_rows(rows))
    sets = cut_lineage(ngram_join.sets_of(docs, reps.join(near, "sid", "left_semi")))
    return ngram_join.grouped(rows, reps, sets, near).drop("sid", "root")
