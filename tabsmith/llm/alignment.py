"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Every text is encoded by A (byte-level BPE, of a space and the text) and by B (sentencepiece, which
adds the space itself).  Both token rows cover the same bytes: where an A token and a B token both
end, a group ends; an A and a B token whose byte ranges overlap are linked.  The links are as
many as the distinct ends of either row, so they are listed, not searched.

The corpus-wide statistics go through an inverted index.  A task deals its documents into chunks of at
most ``SLOTS`` documents and about ``MASS`` links, and keeps per chunk and pair (A id, B id) a
compressed bitmap of the documents that link it: the sorted 16-bit slots, or plain bits where these are fewer
bytes.  Links that a document repeats are kept as multiplicity planes: plane k has the documents
whose number of links less one has bit k.  The bitmaps of one pair in different chunks hold different
documents, so their OR is their union and its popcount the sum of theirs: only (pair, popcount)
is shuffled for the document counts.  Counts travel back to the chunks, where postings return scores: every
document of a bitmap receives the pair's count, every one of plane k 2^k times the count.

Postings of one chunk are bounded, a pair has one row per chunk, an A id at most B's vocabulary of
pairs; no group grows with the corpus.  Both tokenizers' files are read by the driver (a few MB) and
broadcast as bytes.

Cases: texts that are null, empty, or whose tokens of either side do not join to the space and the
text (a normalisation of B, say) have no tokens: zeros and an empty groups_sha256.  Repeated rows
(also of one doc_id) count as documents each; an empty table gives an empty result; null doc_ids and
other columns pass by.  Strings of special tokens are plain text.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.session import checkpoint_dir

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Documents and (about) links of one chunk.
SLOTS = 1 << 13
MASS = 6_000_000
#: Bytes of text that are encoded at once; a longer text is encoded alone.
TEXTS = 1 << 19
#: A container of more documents is kept as bits.
SPARSE = SLOTS // 16
#: Texts with longer runs of white space are encoded by the slower library: the pattern engine's stack has its limit.
LONG_SPACE = 50_000
#: How a text is split before the merges of A: contractions, words, numbers, other signs, white space.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_sign() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 signs stand for themselves, the other bytes for U+0100 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    other = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, file_a: bytes, file_b: bytes):
        import sentencepiece
        import tiktoken

        signs = byte_of_sign()
        model = json.loads(file_a)
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(signs[c] for c in entry): i for entry, i in model["model"]["vocab"].items() if entry not in special}
        # the file's ids ascend with its merges, so they serve as merge ranks
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.file_a, self.slow_a, self.spaces = file_a, None, re.compile(r"\s{%d}" % LONG_SPACE)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.width = len(self.bytes_b)
        n = max(len(self.bytes_a), self.width)
        #: ids as text with what follows: nothing, the next id, the B side, the next group
        self.signs = np.array([f"{i}{end}" for end in ("", ",", "|", ";") for i in range(n)], object)
        self.n = n

    def encode_a(self, text: str) -> list:
        if len(text) < LONG_SPACE or not self.spaces.search(text):
            return self.a.encode_ordinary(text)
        if self.slow_a is None:
            from tokenizers import Tokenizer
            self.slow_a = Tokenizer.from_buffer(self.file_a)
            self.slow_a.encode_special_tokens = True
        return self.slow_a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list) -> tuple[list, list]:
        """Ids of A and B per text; both empty where the tokens do not restore the text."""
        ids_a, ids_b = [], []
        known = [t for t in texts if t]
        rows_b = iter(self.b.encode(known, num_threads=1) if known else ())
        for t in texts:
            a, b = [], []
            if t:
                whole = b" " + t.encode()
                b = next(rows_b)
                if b"".join([self.bytes_b[i] for i in b]) == whole:
                    a = self.encode_a(" " + t)
                    if b"".join([self.bytes_a[i] for i in a]) != whole:
                        a = []
                if not a:
                    b = []
            ids_a.append(a)
            ids_b.append(b)
        return ids_a, ids_b

    def align(self, texts: list) -> dict:
        """Per text n_a, n_b, n_groups, n_links, groups; and the links: (text, pair) arrays, pair = A id * width + B id."""
        ids_a, ids_b = self.encode(texts)
        n_a = np.array([len(x) for x in ids_a], np.int64)
        n_b = np.array([len(x) for x in ids_b], np.int64)
        a = np.fromiter((i for x in ids_a for i in x), np.int64, int(n_a.sum()))
        b = np.fromiter((i for x in ids_b for i in x), np.int64, int(n_b.sum()))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        # place of every A end among the B ends, and whether it is one of them
        at = np.searchsorted(end_b, end_a)
        common = end_b[np.minimum(at, len(end_b) - 1)] == end_a if len(end_b) else np.zeros(len(end_a), bool)
        single = np.ones(len(b), bool)
        single[at[common]] = False
        # ends in byte order: those of A, and those of B that are no ends of A
        only_b = np.flatnonzero(single)
        in_a = np.searchsorted(end_a, end_b[only_b])
        place_a = np.arange(len(a)) + np.searchsorted(only_b, at)
        left, right = np.empty(len(a) + len(only_b), np.int64), np.empty(len(a) + len(only_b), np.int64)
        left[place_a], right[place_a] = a, b[np.minimum(at, len(b) - 1)] if len(b) else a
        place_b = in_a + np.arange(len(only_b))
        left[place_b], right[place_b] = a[np.minimum(in_a, len(a) - 1)] if len(a) else 0, b[only_b]
        text_a = np.repeat(np.arange(len(texts)), n_a)
        text_b = np.repeat(np.arange(len(texts)), n_b)
        text = np.empty(len(left), np.int64)
        text[place_a], text[place_b] = text_a, text_b[only_b]
        n_groups = np.bincount(text_a[common], minlength=len(texts))
        # groups as text: A's ids of a group, then B's
        closed_a = np.concatenate([[0], np.cumsum(common)[:-1]]) if len(a) else np.zeros(0, np.int64)
        closed_b = np.concatenate([[0], np.cumsum(~single)[:-1]]) if len(b) else np.zeros(0, np.int64)
        spot_a = np.arange(len(a)) + np.searchsorted(closed_b, closed_a)
        spot_b = np.arange(len(b)) + np.searchsorted(closed_a, closed_b, side="right")
        mark_a = np.where(common, 2, 1)
        mark_b = np.where(single, 1, 3)
        out = np.empty(len(a) + len(b), np.int64)
        out[spot_a] = a + self.n * mark_a
        out[spot_b] = b + self.n * mark_b
        cuts = np.cumsum(n_a + n_b)
        out[cuts[n_a > 0] - 1] %= self.n
        words, groups, lo = self.signs[out].tolist(), [], 0
        for hi in cuts.tolist():
            groups.append("".join(words[lo:hi]))
            lo = hi
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups, "groups": groups,
                "text": text, "pair": left * self.width + right}


_LOADED: dict = {}


def _pair(files) -> Pair:
    """The tokenizers of this worker, built once per broadcast."""
    if files.value[0] not in _LOADED:
        _LOADED.clear()
        _LOADED[files.value[0]] = Pair(*files.value[1:])
    return _LOADED[files.value[0]]


class Index:
    """Links of one chunk: ``add`` takes keys pair * SLOTS + slot with their multiplicity, ``rows`` gives the index."""

    def __init__(self):
        self.keys, self.times, self.mass = [], [], 0

    def add(self, slot: np.ndarray, pair: np.ndarray) -> None:
        keys = pair * SLOTS + slot
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys.append(keys[first])
        self.times.append(np.diff(np.append(first, len(keys))).astype(np.int32))
        self.mass += len(keys)

    def planes(self):
        """(plane, pairs, popcounts, slots), the plane of all documents (-1) first; slots ascend within a pair."""
        keys, times = np.concatenate(self.keys), np.concatenate(self.times) - 1
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        yield -1, *self._split(keys)
        keys, times = keys[times > 0], times[times > 0]
        for plane in range(int(times.max(initial=0)).bit_length()):
            has = keys[times >> plane & 1 == 1]
            if len(has):
                yield plane, *self._split(has)

    @staticmethod
    def _split(keys: np.ndarray) -> tuple:
        pair = keys // SLOTS
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        return pair[first], np.diff(np.append(first, len(pair))), (keys % SLOTS).astype("<u2")


DOC = "slot int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
POSTING = "a int, b int, plane int, n int, dense boolean, docs binary"
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
_FIELDS = [f.split() for f in f"chunk bigint, {DOC}, {POSTING}".split(", ")]


def _batch(size: int, **columns) -> pa.RecordBatch:
    """A batch of the index table; columns that are not given are null."""
    made = [columns.get(name, pa.nulls(size, _TYPES[kind])) for name, kind in _FIELDS]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, _TYPES[kind]) for x, (_, kind) in zip(made, _FIELDS, strict=True)],
                                      names=[name for name, _ in _FIELDS])


def _containers(chunk: int, width: int, plane: int, pairs: np.ndarray, counts: np.ndarray, slots: np.ndarray):
    """Batches of the bitmaps of one plane."""
    def rows(which: np.ndarray, dense: bool, docs: pa.Array):
        n = len(which)
        return _batch(n, chunk=np.full(n, chunk), a=(pairs[which] // width).astype(np.int32), b=(pairs[which] % width).astype(np.int32),
                      plane=np.full(n, plane, np.int32), n=counts[which].astype(np.int32), dense=np.full(n, dense), docs=docs)

    few = np.flatnonzero(counts <= SPARSE)
    inside = np.repeat(counts <= SPARSE, counts)
    at = np.concatenate([[0], np.cumsum(counts[few])]).astype(np.int32) * 2
    yield rows(few, False, pa.BinaryArray.from_buffers(pa.binary(), len(few), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(slots[inside].tobytes())]))
    many = np.flatnonzero(counts > SPARSE)
    start = np.concatenate([[0], np.cumsum(counts)])
    for lo in range(0, len(many), 512):
        part = many[lo: lo + 512]
        bits = np.zeros((len(part), SLOTS), np.uint8)
        for row, k in enumerate(part):
            bits[row, slots[start[k]: start[k + 1]]] = 1
        packed = np.packbits(bits, axis=1)
        at = (np.arange(len(part) + 1) * (SLOTS // 8)).astype(np.int32)
        yield rows(part, True, pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(packed.tobytes())]))


def index(docs: DataFrame, files) -> DataFrame:
    """The index table: per document chunk and slot with its counts (a is null), per pair, chunk and plane its bitmap."""

    def run(batches):
        pair = _pair(files)
        chunk, slot, links = TaskContext.get().partitionId() << 32, 0, Index()

        def closed():
            for plane in links.planes() if links.keys else ():
                yield from _containers(chunk, pair.width, *plane)

        for b in batches:
            texts, ids = b.column(0).to_pylist(), b.column(1)
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and j - i < SLOTS - slot and (j == i or size + len(texts[j] or "") <= TEXTS):
                    size += len(texts[j] or "")
                    j += 1
                got = pair.align(texts[i:j])
                yield _batch(j - i, chunk=np.full(j - i, chunk), slot=np.arange(slot, slot + j - i, dtype=np.int32), doc_id=ids.slice(i, j - i),
                             **{k: got[k] for k in ("n_a", "n_b", "n_groups", "n_links")},
                             groups_sha256=[hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got["groups"]])
                links.add(got["text"] + slot, got["pair"])
                slot += j - i
                i = j
                if slot >= SLOTS or links.mass >= MASS:
                    yield from closed()
                    chunk, slot, links = chunk + 1, 0, Index()
        yield from closed()

    rows = docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id"))
    return rows.mapInArrow(run, f"chunk bigint, {DOC}, {POSTING}")


def _scores(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a chunk with n_best and count_sum from its scored postings."""
    total, best = np.zeros(SLOTS), np.zeros(SLOTS)  # integers below 2^53
    weight = np.left_shift(1, np.maximum(right["plane"].to_numpy(), 0)).astype(float)
    count, top = weight * right["n_docs"].to_numpy(), weight * right["is_best"].to_numpy()
    dense = right["dense"].to_numpy()
    for kind in (False, True):
        rows = np.flatnonzero(dense == kind)
        if not len(rows):
            continue
        column = right["docs"].combine_chunks().cast(pa.large_binary()).take(pa.array(rows))
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(column.buffers()[2], np.uint8)[at[0]: at[-1]]
        if kind:
            for lo in range(0, len(rows), 256):
                part = rows[lo: lo + 256]
                bits = np.unpackbits(data[lo * SLOTS // 8: (lo + len(part)) * SLOTS // 8].reshape(len(part), -1), axis=1)
                total += count[part] @ bits
                best += top[part] @ bits
        else:
            slots, times = data.view("<u2"), np.diff(at) // 2
            total += np.bincount(slots, np.repeat(count[rows], times), SLOTS)
            best += np.bincount(slots, np.repeat(top[rows], times), SLOTS)
    slot = left["slot"].to_numpy()
    out = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(best[slot].astype(np.int64)))
    out = out.append_column("count_sum", pa.array(total[slot].astype(np.int64)))
    return out.append_column("groups_sha256", left["groups_sha256"])


def pair_counts(index_rows: DataFrame) -> DataFrame:
    """(a, b, n_docs, is_best): documents that link the pair, and whether no pair of the same A id is in more."""
    counts = index_rows.filter("plane = -1").groupBy("a", "b").agg(F.sum("n").alias("n_docs"))
    best = counts.groupBy("a").agg(F.max("n_docs").alias("_most"))
    return counts.join(best, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("_most")).alias("is_best"))


def align(docs: DataFrame, folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The index is written as Parquet into the shared checkpoint folder and read by both passes, so texts are encoded once.
    """
    spark = docs.sparkSession
    data = [open(f"{folder}/{name}", "rb").read() for name in (file_a, file_b)]
    files = spark.sparkContext.broadcast((uuid.uuid4().hex, *data))
    path = f"{checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    index(docs, files).write.parquet(path)
    files.destroy()
    postings = spark.read.parquet(path).filter("a is not null")
    scored = postings.join(pair_counts(postings).hint("merge"), ["a", "b"])
    scored = scored.select("chunk", "plane", "dense", "docs", "n_docs", "is_best")
    known = spark.read.parquet(path).filter("a is null").select("chunk", *[f.split()[0] for f in DOC.split(", ")])
    out = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return known.groupBy("chunk").cogroup(scored.groupBy("chunk")).applyInArrow(_scores, out)
