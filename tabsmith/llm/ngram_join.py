"""N-gram Jaccard join: groups of documents whose shingle sets are alike.

1. One pass over the texts gives every row's set size and set id (a 64-bit hash of its sorted
   shingles).  Equal sets are one set from here on.
2. A set with a link shares at least the part ``t`` of its shingles with other sets.  ``shared`` counts,
   for every set, the shingles that some other set holds; sets below ``t`` are done.  Each task sends
   a shingle once, however many of its sets hold it, so a passage that a third of all texts
   share costs one entry per task.
3. Blocking without loss: if the shingles of a set are ordered rarest bucket first, two sets with
   Jaccard >= t share one of their first ``n - ceil(t n) + 1`` shingles.  Frequent passages come last
   in that order, so sharing one does not make a block.  Sets that share such a shingle, directly
   or through others, form a cluster; every link lies inside a cluster.
4. Inside a cluster the count-vector R-tree (``rtree``) finds the pairs whose groups of shingles
   can overlap enough, and verifies them on the shingles.  A cluster above ``MASS`` shingles or ``SETS``
   sets is cut into chunks that are searched one per task; then the roots of the chunks'
   components are joined in the same way, and last every set outside its cluster's largest
   component is searched against all chunks, so that no link between components is lost.
5. Components of the links; a component's id is its smallest doc_id.

An R-tree over the whole corpus alone would compare nearly all sets: in the many dimensions that
long texts need, boxes of unrelated texts do not separate.  Hence steps 2 and 3.

Cases: null or empty text: no shingles, linked with nothing; fewer words than the width: the whole
sequence is the one shingle; rows with a null doc_id are counted but linked with nothing;
repeated rows are linked as equal sets; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.components import components
from tabsmith.llm.ranges import parts_of
from tabsmith.llm.rtree import Links
from tabsmith.llm.text import mix64, shingle_sets
from tabsmith.session import cut_lineage, release

NUM, DEN = 3, 4
MASS = 4_000_000
SETS = 8192
U = np.uint64
#: Rows of one task that are brought together before they go to the shuffle.
FLUSH = 500_000
#: Passes over the texts that count shared shingles, each of its part of the hashes.
ROUNDS = 2
#: Bits of the filter that keeps most rows out of a join, per wanted row and at most.
FILTER_BITS, FILTER_MOST = 16, 1 << 27


def set_ids(off: np.ndarray, h: np.ndarray) -> np.ndarray:
    """64-bit id of each set, as int64; of an empty set 0."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix64(h ^ U(0x5851F42D4C957F2D)))])
    n = np.diff(off)
    ids = mix64((total[off[1:]] - total[off[:-1]]) + n.astype(U) * U(0x9E3779B97F4A7C15))
    return np.where(n > 0, ids, U(0)).view(np.int64)


def frequency_buckets(mass: int) -> int:
    """A power of two near a quarter of the shingles, 4096 to 4 million (a table of 16 MB at most)."""
    return 1 << int(min(22, max(12, np.ceil(np.log2(max(1, mass) / 4)))))


def set_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sid) of every row."""
    return with_sets(docs.select("doc_id", "text"), keep=("doc_id",))


def with_sets(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of every row, with the size ``n`` and the id ``sid`` of its set."""

    def run(batches):
        for b in batches:
            for i, j, off, h in shingle_sets(b.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, j - i) for c in b.columns[1:]] + [pa.array(np.diff(off)), pa.array(set_ids(off, h))], names=[*keep, "n", "sid"])

    kept = docs.select(*keep).schema
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields] + ["n bigint", "sid bigint"])
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, ddl)


def squeeze(x: np.ndarray) -> bytes:
    """Ascending 32-bit values as differences, byte by byte place, so that the shuffle's codec finds the zeros."""
    return np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, 4).T).tobytes()


def unsqueeze(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


BLOBS = "part int, pack bigint, kind int, a binary, b binary, c binary"
#: Sets that close a pack, and the most it can hold: they are numbered by 16 bits.
PACK_SETS = 60_000
MOST_SETS = 1 << 16


def _spread(ranges: int, turn: int = 0, rounds: int = 1):
    """text -> blobs (part, pack, kind, a, b, c) of a pack of sets, with the ranges of hashes that are this turn's.

    kind 0, one per range of hashes: the top bits of every shingle of the pack, once (a), the number
    of a set that holds it (b), and whether several sets of the pack do (c).  kind 1: the set ids
    of the pack by number (a) and how many of their shingles another set of the pack holds (b).
    """
    schema = pa.schema([("part", pa.int32()), ("pack", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
    width = 2 ** 64 // ranges + 1
    # 32 bits of the place inside the range
    shift = U(max(0, (width - 1).bit_length() - 32))
    low, high = ranges * turn // rounds, ranges * (turn + 1) // rounds

    def pack(hashes: list, docs: list, sids: list, number: int):
        h, doc = np.concatenate(hashes), np.concatenate(docs)
        o = np.argsort(h, kind="stable")
        h, doc = h[o], doc[o]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(first)
        runs = np.diff(np.append(at, len(h)))
        many = runs > 1
        own = np.bincount(doc, weights=np.repeat(many, runs), minlength=len(sids)).astype(np.int64)
        rows = [(low + number % (high - low), number, 1, np.array(sids, np.int64).tobytes(), own.tobytes(), b"")]
        h, doc = h[at], doc[at].astype(np.uint16)
        cut = np.searchsorted(h, np.array([width * r for r in range(low + 1, high)], U))
        for r, (x, y) in enumerate(zip(np.append(0, cut), np.append(cut, len(h)), strict=True), low):
            if y > x:
                place = ((h[x:y] - U(width * r)) >> shift).astype(np.uint32)
                rows.append((r, number, 0, squeeze(place), doc[x:y].tobytes(), np.packbits(many[x:y]).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        from pyspark import TaskContext
        number, seen = TaskContext.get().partitionId() << 24, {}
        hashes, docs, size = [], [], 0
        for b in batches:
            for _, _, off, h in shingle_sets(b.column(0)):
                ids, n = set_ids(off, h), np.diff(off)
                s = 0
                while s < len(n):
                    # a chunk can have more sets than the pack has numbers left
                    e = min(len(n), s + MOST_SETS - len(seen))
                    num = np.full(e - s, -1, np.int64)
                    for i in np.flatnonzero(n[s:e] > 0):
                        if (x := int(ids[s + i])) not in seen:
                            num[i] = seen[x] = len(seen)
                    doc, some = np.repeat(num, n[s:e]), h[off[s]: off[e]]
                    keep = doc >= 0
                    keep &= (some >= U(width * low)) & (some <= U(min(width * high, 1 << 64) - 1))
                    hashes.append(some[keep])
                    docs.append(doc[keep])
                    size += int(keep.sum())
                    s = e
                    if size >= FLUSH or len(seen) >= PACK_SETS:
                        yield pack(hashes, docs, list(seen), number)
                        number, hashes, docs, size, seen = number + 1, [], [], 0, {}
        if size:
            yield pack(hashes, docs, list(seen), number)

    return run


def _credit(batches):
    """Blobs of one range of hashes -> per pack, the sets' numbers (a) and how many of their shingles another pack holds (b)."""
    schema = pa.schema([("pack", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
    for t in groups(batches, "part"):
        kind, packs = t["kind"].to_numpy(), t["pack"].to_numpy()
        a, b, c = (t[x].to_pylist() for x in "abc")
        out = [(int(packs[i]), 1, a[i], b[i]) for i in np.flatnonzero(kind == 1)]
        at = np.flatnonzero(kind == 0)
        if len(at):
            n = [len(a[i]) // 4 for i in at]
            place = np.concatenate([unsqueeze(a[i]) for i in at])
            who = np.concatenate([np.frombuffer(b[i], np.uint16).astype(np.int64) + (k << 16) for k, i in enumerate(at)])
            many = np.concatenate([np.unpackbits(np.frombuffer(c[i], np.uint8), count=m) for i, m in zip(at, n, strict=True)]).astype(bool)
            o = np.argsort(place, kind="stable")
            place, who, many = place[o], who[o], many[o]
            first = np.ones(len(place), bool)
            first[1:] = place[1:] != place[:-1]
            cut = np.flatnonzero(first)
            runs = np.diff(np.append(cut, len(place)))
            # the pack has counted the shingles that several of its own sets share
            ask = np.repeat(runs > 1, runs) & ~many
            key, times = np.unique(who[ask], return_counts=True)
            ends = np.searchsorted(key, np.arange(len(at) + 1) << 16)
            out += [(int(packs[i]), 0, (key[x:y] & 0xFFFF).astype(np.uint16).tobytes(), times[x:y].astype(np.uint32).tobytes())
                    for i, x, y in zip(at, ends[:-1], ends[1:], strict=True) if y > x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _total(batches):
    """All rows of a pack -> (sid, shared)."""
    for t in groups(batches, "pack"):
        kind, a, b = t["kind"].to_numpy(), t["a"].to_pylist(), t["b"].to_pylist()
        own = int(np.flatnonzero(kind == 1)[0])
        total = np.frombuffer(b[own], np.int64).copy()
        for i in np.flatnonzero(kind == 0):
            total[np.frombuffer(a[i], np.uint16)] += np.frombuffer(b[i], np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a[own], np.int64)), pa.array(total)], names=["sid", "shared"])


def shared(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(sid, shared): at least the number of a set's shingles that another set holds too.

    A set with copies counts in each pack that holds one, and its copies count as other sets: the
    figure may be too high, which only lets a set through to the next step.

    The shingles take more room than the texts' files: each pass shuffles its part of the hashes only, whose files go before the next.
    """
    parts = parts_of(docs.sparkSession)
    texts, some, found = docs.filter("doc_id is not null").select("text"), -(-2 * parts // (rounds + 1)), None
    for turn in range(rounds):
        rows = texts.mapInArrow(_spread(4 * parts, turn, rounds), BLOBS)
        rows = rows.repartition(some, "part").sortWithinPartitions("part").mapInArrow(_credit, "pack bigint, kind int, a binary, b binary")
        rows = rows.repartition(some, "pack").sortWithinPartitions("pack").mapInArrow(_total, "sid bigint, shared bigint")
        rows = cut_lineage(rows.groupBy("sid").agg(F.sum("shared").alias("shared")))
        release(docs.sparkSession)
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("sid").agg(F.sum("shared").alias("shared"))


def bucket_ranks(sets: DataFrame, mass: int) -> np.ndarray:
    """Rank of every shingle bucket by its frequency in ``sets``."""
    buckets = frequency_buckets(mass)

    def run(batches):
        count = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(count, (np.frombuffer(x.as_buffer(), U) >> U(8)).astype(np.int64) & (buckets - 1), 1)
        hit = np.flatnonzero(count)
        for s in range(0, len(hit), 100_000):
            x = hit[s: s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(count[x])], names=["bucket", "n"])

    freq = sets.select("hashes").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    count = np.zeros(buckets, np.int64)
    for b in freq.toArrow().to_batches():
        count[np.asarray(b.column(0))] = np.asarray(b.column(1))
    return np.unique(count, return_inverse=True)[1].astype(np.int32)


def _prefixes(order, num: int, den: int):
    """(sid, hashes) -> (signature, sid): the rarest shingles of every set, brought together per task.

    ``order``: broadcast rank of each frequency bucket.  Of the sets of a task that share a
    signature only the smallest id stands for it in the shuffle; the others are tied to that one by
    a signature that no other task uses.
    """
    schema = pa.schema([("sig", pa.int64()), ("sid", pa.int64())])

    def together(sig: np.ndarray, sid: np.ndarray, salt: int) -> pa.RecordBatch:
        o = np.lexsort((sid, sig))
        sig, sid = sig[o], sid[o]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        lead = sid[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
        pair = np.unique(np.stack([lead[~first], sid[~first]], 1), axis=0)
        pair = pair[pair[:, 0] != pair[:, 1]]
        tie = mix64(pair[:, 0].copy().view(U) ^ U(salt)).view(np.int64)
        _, one = np.unique(tie, return_index=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([sig[first], tie, tie[one]])),
             pa.array(np.concatenate([sid[first], pair[:, 1], pair[one, 0]]))], schema=schema)

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId() + 1
        rank, sigs, sids, held, flushed = order.value, [], [], 0, 0
        for b in batches:
            for sid, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = np.frombuffer(raw.as_buffer(), U)
                take = len(h) - -(-len(h) * num // den) + 1
                # rank first, then the hash itself (it is sorted): one global order of all shingles
                o = np.argsort(rank[(h >> U(8)).astype(np.int64) & (len(rank) - 1)], kind="stable")[:take]
                sigs.append(h[o].view(np.int64))
                sids.append(np.full(take, sid, np.int64))
                held += take
            if held >= FLUSH:
                flushed += 1
                yield together(np.concatenate(sigs), np.concatenate(sids), part * 1_000_003 + flushed)
                sigs, sids, held = [], [], 0
        if held:
            yield together(np.concatenate(sigs), np.concatenate(sids), part * 1_000_003)

    return run


def _maybe(wanted: DataFrame, bits: int):
    """Condition on doc_id that all rows of ``wanted`` meet and few others: its hash is a set bit of a bounded bitmap."""
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(bits - 1))
    words = wanted.select(place.alias("_p")).groupBy(F.shiftright("_p", 5).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_p & 31 as int))")).alias("bits"))
    table = np.zeros(bits // 32, np.uint32)
    for b in words.toArrow().to_batches():
        table[np.asarray(b.column(0))] = np.asarray(b.column(1))
    sent = wanted.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def has(p: pa.Array) -> pa.Array:
        p = np.asarray(p)
        return pa.array((sent.value[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) > 0)

    return has(place)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (doc_id, sid, n) with ``hashes``, the set's sorted shingles as bytes."""
    bits = 1 << int(np.ceil(np.log2(max(1024, min(FILTER_MOST, FILTER_BITS * wanted.count())))))
    # the texts of other rows would be shuffled for nothing
    rows = docs.select("doc_id", "text").filter("doc_id is not null").filter(_maybe(wanted, bits))
    rows = rows.join(wanted.select("doc_id", "sid", "n"), "doc_id")

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            sid = np.asarray(b.column(1))
            for i, j, off, h in shingle_sets(b.column(0)):
                # of rows with the same doc_id, one whose text has the set
                ok = [x for x in np.flatnonzero(set_ids(off, h) == sid[i:j]) if not (sid[i + x] in seen or seen.add(sid[i + x]))]
                at = pa.array(ok, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, j - i).take(at) for c in b.columns[1:]]
                    + [pa.array([h[off[x]: off[x + 1]].tobytes() for x in ok], pa.binary())], names=["sid", "doc_id", "n", "hashes"])

    # equal doc_ids meet in one partition, so ``seen`` sees all rows of a set
    return rows.select("text", "sid", "doc_id", "n").mapInArrow(run, "sid bigint, doc_id bigint, n bigint, hashes binary")


def groups(batches, key: str):
    """Runs of equal ``key`` in batches sorted by it, as tables."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if held and k[s] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = k[s]
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _search(num: int, den: int):
    """Sorted (task, sid, hashes, role, label): links (a, b) inside each task.

    role 0: all sets of the task against each other; role 1 are targets and role 2 queries,
    labelled with their components so far.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        a, b = [], []
        for t in groups(batches, "task"):
            sid = t["sid"].to_numpy()
            if len(sid) < 2:
                continue
            role, label = t["role"].to_numpy(), t["label"].to_numpy()
            raw = t["hashes"].to_pylist()
            off = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)
            found = Links(off, np.frombuffer(b"".join(raw), U), num, den, None if role[0] == 0 else label)
            got = found.run() if role[0] == 0 else found.run(np.flatnonzero(role == 2), np.flatnonzero(role == 1))
            a += [int(sid[x]) for x, _ in got]
            b += [int(sid[y]) for _, y in got]
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=schema)
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=schema)

    return run


def _find(sets: DataFrame, wanted: DataFrame, num: int, den: int) -> DataFrame:
    """Links of the sets that ``wanted`` (sid, task, role, label) brings together by task."""
    rows = wanted.join(sets.select("sid", "hashes"), "sid")
    return rows.repartition("task").sortWithinPartitions("task", "role").mapInArrow(_search(num, den), "a bigint, b bigint")


def _cut(members: DataFrame, mass: int, most: int) -> DataFrame:
    """Add chunk and chunks: clusters above the limits are dealt by a hash of the set id."""
    size = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / mass), F.ceil(F.count(F.lit(1)) / most)).cast("bigint").alias("chunks"))
    return members.join(size, "cluster").withColumn("chunk", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("chunks")))


def _labels(members: DataFrame, links: DataFrame) -> DataFrame:
    """Sets with ``label``: the component so far."""
    comp = components(links)
    out = members.join(comp.withColumnRenamed("node", "sid"), "sid", "left")
    return out.withColumn("label", F.coalesce("component", "sid")).drop("component")


def links_in_clusters(sets: DataFrame, members: DataFrame, num: int, den: int, mass: int = MASS, most: int = SETS) -> DataFrame:
    """Links that connect all sets of a cluster (``members``: sid, n, cluster) that links connect."""
    cut = cut_lineage(_cut(members, mass, most))
    task = F.xxhash64("cluster", "chunk")
    plain = cut.select("sid", task.alias("task"), F.lit(0).alias("role"), F.lit(0).cast("bigint").alias("label"))
    links = cut_lineage(_find(sets, plain, num, den))
    big = cut.filter("chunks > 1").select("sid", "n", "cluster")
    if big.isEmpty():
        return links
    # the roots of the chunks' components, until they fit one chunk or no more of them join
    while True:
        now = cut_lineage(_labels(big, links))
        roots = now.filter("sid = label").select("sid", "n", "cluster")
        many = roots.groupBy("cluster").count().filter("count > 1").select("cluster")
        level = cut_lineage(_cut(roots.join(many, "cluster", "left_semi"), mass, most))
        if level.isEmpty():
            return links
        new = cut_lineage(_find(sets, level.select(
            "sid", F.xxhash64("cluster", "chunk").alias("task"), F.lit(0).alias("role"),
            F.lit(0).cast("bigint").alias("label")), num, den))
        found = not new.isEmpty()
        links = cut_lineage(links.unionByName(new)) if found else links
        if not found or level.filter("chunks > 1").isEmpty():
            break
    # what is not in a cluster's largest component is searched against every chunk
    now = _labels(big, links)
    sizes = now.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"))
    top = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("parts"))
    now = cut_lineage(_cut(now.join(top.filter("parts > 1"), "cluster"), mass, most))
    asks = now.filter("label <> top")
    if asks.isEmpty():
        return links
    ask_parts = _cut(asks.drop("chunk", "chunks"), mass, most).select(
        "cluster", "sid", "label", F.col("chunk").alias("part"), F.col("chunks").alias("parts_"))
    span = now.groupBy("cluster").agg(F.max("chunks").alias("chunks"))
    queries = (ask_parts.join(span, "cluster").withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
               .select("sid", F.xxhash64("cluster", "chunk", "part").alias("task"), F.lit(2).alias("role"), "label"))
    per = ask_parts.groupBy("cluster").agg(F.max("parts_").alias("parts_"))
    marks = (now.join(per, "cluster").withColumn("part", F.explode(F.expr("sequence(0L, parts_ - 1)")))
             .select("sid", F.xxhash64("cluster", "chunk", "part").alias("task"), F.lit(1).alias("role"), "label"))
    return cut_lineage(links.unionByName(_find(sets, marks.unionByName(queries), num, den)))


def clusters_of(signatures: DataFrame) -> DataFrame:
    """(sid, cluster) of the sets that share a signature with another, directly or through others."""
    lead = F.min("sid").over(Window.partitionBy("sig"))
    pairs = signatures.withColumn("lead", lead).filter("sid <> lead").select(
        F.col("sid").alias("a"), F.col("lead").alias("b")).distinct()
    return components(pairs).select(F.col("node").alias("sid"), F.col("component").alias("cluster"))


def first_rows(rows: DataFrame) -> DataFrame:
    """(sid, doc_id, n): the smallest doc_id of every set."""
    return (rows.filter("doc_id is not null and n > 0").groupBy("sid")
            .agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))


def grouped(rows: DataFrame, reps: DataFrame, sets: DataFrame, near: DataFrame, num: int = NUM, den: int = DEN,
            mass: int = MASS, most: int = SETS) -> DataFrame:
    """Per row of ``rows`` (doc_id, n, sid): its component by the links inside the clusters ``near`` (sid, cluster).

    ``sid`` and ``root``, the smallest set of the component, tell components of the same smallest doc_id apart.
    """
    links = links_in_clusters(sets, sets.select("sid", "n").join(near, "sid"), num, den, mass, most)
    release(sets.sparkSession)
    comp = components(links).withColumnRenamed("node", "sid")
    named = reps.join(comp, "sid", "left").withColumn("root", F.coalesce("component", "sid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.select("sid", "root").join(least, "root").select("sid", "root", "component_id")
    out = rows.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
                      .otherwise(F.col("doc_id")).alias("component_id"), "sid", "root")


def join_groups(docs: DataFrame, num: int = NUM, den: int = DEN, mass: int = MASS, most: int = SETS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return set_groups(docs, num, den, mass, most).drop("sid", "root")


def set_groups(docs: DataFrame, num: int = NUM, den: int = DEN, mass: int = MASS, most: int = SETS) -> DataFrame:
    """``join_groups`` with the row's set ``sid`` and ``root``, the smallest set of its component."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = cut_lineage(set_rows(docs))
    reps = cut_lineage(first_rows(rows))
    # each step's shuffle files go before the next step writes its own
    may = cut_lineage(reps.join(shared(docs), "sid").filter(F.col("shared") * den >= F.col("n") * num))
    release(docs.sparkSession)
    sets = cut_lineage(sets_of(docs, may))
    release(docs.sparkSession)
    size = sets.agg(F.sum("n")).first()[0] or 0
    order = docs.sparkSession.sparkContext.broadcast(bucket_ranks(sets, size))
    near = clusters_of(sets.select("sid", "hashes").mapInArrow(_prefixes(order, num, den), "sig bigint, sid bigint"))
    release(docs.sparkSession)
    return grouped(rows, reps, sets, near, num, den, mass, most)
