"""Merkle manifest of a dataset by time-forward processing.

A document's leaf is the SHA-256 of its fields; per language the leaves, by ascending doc_id, are
folded eight by eight (a run's digests in order, the last run may be shorter) until one node is left, the subroot; the
subroots, by language, are folded likewise into the root.  Every document gets the digest of its
proof: the siblings of its nodes up to the root, in order.

The tree is worked as time-forward processing.  A node's label is its time: the place of the last leaf
below it, then its level, so children come before their parent.  Going forward, every node sends its
digest to its parent's label; going back, from the root, every node sends each child the
siblings of that child and its own proof, the suffix of the child's.  The messages lie in a priority queue by label.
The queue is external: leaves are numbered by a distributed sort and cut into segments of ``SPAN`` = 8^4
places; messages that leave a segment are rows, shuffled and sorted by label with Spark's spilling sort, and
become the leaves (forward) or the first row (back) of a segment in the next round.  Inside a
segment a heap holds the few messages under way.  A language with any share of the rows is spread over all
tasks; rounds are as many as log_4096 of the longest language.

Cases: leaves of one doc_id (repeated rows) follow in order of their digest, equal ones are
interchangeable; null doc_ids come first; null fields are ``-``; a null language is a language of its own and comes first;
null doc_ids are not tampered with; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.ranges import parts_of
from tabsmith.session import cut_lineage

FAN = 8
#: Levels and places of a segment.
LEVELS = 4
SPAN = FAN ** LEVELS
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


# --- inside a segment ---------------------------------------------------------------------------


def levels_of(n: int) -> int:
    """Levels that a segment of a group of ``n`` nodes has: all, or as many as lead to one node."""
    levels = 0
    while levels < LEVELS and FAN ** levels < n:
        levels += 1
    return levels


def forward(leaves: list[str], levels: int) -> Iterator[tuple[tuple[int, int], list[str], str]]:
    """(label, child digests, digest) of every inner node, in time order; the last one is the top."""
    queue: list = []
    last = len(leaves) - 1

    def send(level: int, index: int, value: str) -> None:
        if level < levels:
            above = index // FAN
            heapq.heappush(queue, (min((above + 1) * FAN ** (level + 1) - 1, last), level + 1, index, value))

    for place, leaf in enumerate(leaves):
        send(0, place, leaf)
        while queue and queue[0][0] <= place:
            end, level = queue[0][:2]
            children = []
            while queue and queue[0][:2] == (end, level):
                children.append(heapq.heappop(queue)[3])
            value = digest("".join(children))
            yield (end, level), children, value
            send(level, end // FAN ** level, value)


def top(leaves: list[str], levels: int) -> str:
    value = leaves[0]
    for _, _, value in forward(leaves, levels):
        pass
    return value


def backward(leaves: list[str], levels: int, suffix: str) -> list[str]:
    """The path of every leaf: ``left|right`` siblings level by level, joined by ``/``, then the segment's own path."""
    nodes = {label: children for label, children, _ in forward(leaves, levels)}
    paths = [""] * len(leaves)
    last = len(leaves) - 1
    queue = [(-last, -levels, suffix)]
    while queue:
        end, level, path = heapq.heappop(queue)
        end, level = -end, -level
        if level == 0:
            paths[end] = path
            continue
        children = nodes[end, level]
        first = end // FAN ** level * FAN
        for i in range(len(children)):
            step = f"{''.join(children[:i])}|{''.join(children[i + 1:])}"
            below = min((first + i + 1) * FAN ** (level - 1) - 1, last)
            heapq.heappush(queue, (-below, -(level - 1), f"{step}/{path}" if path else step))
    return paths


def proof(path: str) -> str:
    """Digest of a path's siblings in order."""
    return digest(path.replace("|", "").replace("/", ""))


def fold(leaf: str, path: str) -> str:
    """Root that a leaf and its path lead to."""
    for step in path.split("/") if path else ():
        left, _, right = step.partition("|")
        leaf = digest(left + leaf + right)
    return leaf


# --- between segments ---------------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its group ``g`` by ``order``, and ``n``, the group's rows.

    A distributed sort; its partitions are kept in the checkpoint, so places do not move.  Rows equal in all of
    ``order`` are told apart by their place in the checkpointed input.
    """
    rows = cut_lineage(rows).withColumn("_tie", F.monotonically_increasing_id())
    keys = ["g", *order, "_tie"]
    rows = rows.repartitionByRange(parts_of(rows.sparkSession), *keys).sortWithinPartitions(*keys).drop("_tie")
    # partition number above, place inside the partition in the low 33 bits
    rows = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("g", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                       F.sum("_rows").over(Window.partitionBy("g")).alias("n"))
    # one row per partition and group in it; small tables are broadcast by their measured size
    return rows.join(runs, ["g", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _segments(batches, width: int) -> Iterator[list[tuple]]:
    """Rows of one (g, seg) at a time; the first two columns are g and seg."""
    rows = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(width)], strict=True))
    for _, run in groupby(rows, key=lambda r: r[:2]):
        yield list(run)


def _by_segment(rows: DataFrame) -> DataFrame:
    parts = parts_of(rows.sparkSession)
    return rows.repartition(parts, "g", "seg").sortWithinPartitions("g", "seg", "pos")


def _up(nodes: DataFrame) -> DataFrame:
    """(g, pos, n, node): the tops of the segments of ``nodes``."""

    def run(batches):
        for rows in _segments(batches, 5):
            g, seg, _, n, _ = rows[0]
            value = top([r[4] for r in rows], levels_of(n))
            yield pa.RecordBatch.from_pydict({"g": [g], "pos": [seg], "n": [-(-n // SPAN)], "node": [value]},
                                             schema=pa.schema([("g", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())]))

    rows = nodes.select("g", F.floor(F.col("pos") / SPAN).cast("bigint").alias("seg"), "pos", "n", "node")
    return _by_segment(rows).mapInArrow(run, "g string, pos bigint, n bigint, node string")


def rise(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of the forward sweep: ``nodes``, the tops of their segments, and so on; the last has one node per group."""
    rounds = [nodes]
    while True:
        rounds.append(cut_lineage(_up(rounds[-1])))
        if rounds[-1].filter("n > 1").isEmpty():
            return rounds


def _with_paths(nodes: DataFrame, above: DataFrame, extra: list[str]) -> DataFrame:
    """Rows of both, by segment: a segment's path (``above``: g, pos, path, subroot, root) comes before its nodes."""
    seg = F.floor(F.col("pos") / SPAN).cast("bigint").alias("seg")
    mine = nodes.select("g", seg, "pos", "n", "node", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("subroot"),
                        F.lit(None).cast("string").alias("root"), *extra)
    kinds = dict(nodes.dtypes)
    theirs = above.select("g", F.col("pos").alias("seg"), F.lit(-1).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("n"),
                          F.lit(None).cast("string").alias("node"), "path", "subroot", "root", *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    return _by_segment(mine.unionByName(theirs))


def fall(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(g, pos, node, path, subroot, root) of ``nodes``, from the paths of their segments."""
    schema = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("node", pa.string()), ("path", pa.string()),
                        ("subroot", pa.string()), ("root", pa.string())])

    def run(batches):
        for rows in _segments(batches, 8):
            (g, _, _, _, _, path, subroot, root), rows = rows[0], rows[1:]
            paths = backward([r[4] for r in rows], levels_of(rows[0][3]), path)
            yield pa.RecordBatch.from_pydict({"g": [g] * len(rows), "pos": [r[2] for r in rows], "node": [r[4] for r in rows], "path": paths,
                                              "subroot": [subroot] * len(rows), "root": [root] * len(rows)}, schema=schema)

    return _with_paths(nodes, above, []).mapInArrow(run, "g string, pos bigint, node string, path string, subroot string, root string")


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, node, tampered): leaf of every document; tampered is null where nothing is tampered with.

    ``g`` stands for the language: ``-`` for null, which sorts before ``=`` and the language.
    """
    doc_id = F.col("doc_id").cast("bigint")
    parts = [doc_id, F.col("source"), F.col("lang"), F.col("n_chars").cast("bigint")]
    text = F.col("text")
    odd = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("g"), doc_id.alias("doc_id"),
                       leaf_of(*parts, text).alias("node"),
                       F.when(odd, leaf_of(*parts, F.translate(text, UPPER, UPPER.lower()))).alias("tampered"))


def manifest(docs: DataFrame) -> DataFrame:
    """Per document doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf where there is one), verified."""
    rounds = rise(numbered(leaves(docs), ["doc_id", "node"]))
    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "node")
    tops = rise(numbered(subroots, ["of"]))
    # back: the root's path is empty; then the languages' tree, then the documents'
    down = tops[-1].select("g", "pos", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for nodes in reversed(tops[:-1]):
        down = fall(nodes, down)
    names = tops[0].select(F.col("pos"), F.col("of"))
    down = down.select("pos", "path", F.col("node").alias("subroot"), "root").join(names, "pos")
    down = cut_lineage(down.select(F.col("of").alias("g"), F.lit(0).cast("bigint").alias("pos"), "path", "subroot", "root"))
    for nodes in reversed(rounds[1:-1]):
        down = fall(nodes, down).select("g", "pos", "path", "subroot", "root")
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                        ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])

    def run(batches):
        for rows in _segments(batches, 10):
            (*_, path, subroot, root, _, _), rows = rows[0], rows[1:]
            paths = backward([r[4] for r in rows], levels_of(rows[0][3]), path)
            folded = [fold(r[4] if r[9] is None else r[9], p) for r, p in zip(rows, paths, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": [r[8] for r in rows], "leaf": [r[4] for r in rows], "subroot": [subroot] * len(rows),
                                              "root": [root] * len(rows), "proof_sha256": [proof(p) for p in paths], "folded_root": folded,
                                              "verified": [f == root for f in folded]}, schema=schema)

    out = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_paths(rounds[0], down, ["doc_id", "tampered"]).mapInArrow(run, out)
