"""Embedding near-duplicates by E8 lattice hashing.

Every table projects the unit vectors on ``DIMS`` random orthonormal directions and decodes each
run of eight scaled coordinates to its nearest point of the E8 lattice; the points together are
the vector's cell.  A vector is home in its cell and a guest in the cells of its ``PROBES`` next
nearest lattice points.  Inside a cell, homes meet homes and guests; every pair is verified by
cosine in double precision.

Equal vectors are one vector with a count from the start, so copies make no pairs.  A pair that
several tables or cells find is counted only in the first one: both ends' cells follow from the
vectors, so a task knows without asking whether an earlier cell also holds the pair, and sends
counts instead of pairs.  Links go on only as a forest per cell.  A cell above ``MOST`` members is cut
into chunks, and each pair of chunks is a task.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are their own component; vectors of different lengths never link; a row with a null
id is counted by others but has a null component; repeated rows are linked copies; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.components import components
from tabsmith.llm.ngram_join import groups
from tabsmith.llm.text import mix64, random64
from tabsmith.session import cut_lineage

TABLES = 4
DIMS = 16
PROBES = 8
#: Lattice scale: projected coordinates are divided by it.  Linked vectors are sqrt(2 - 2 * 0.95) = 0.32
#: apart at most.  On random pairs of 64-dimensional vectors at cosine 0.951, four tables of two E8 runs
#: with eight probes find 99.6 of 100 pairs, at 0.98 all (tests measure recall against brute force).
CELL = 0.85
LEAST = 0.95
MOST = 4096
U = np.uint64


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = [s for i, j in combinations(range(8), 2) for a in (1, -1) for b in (1, -1)
           for s in [np.eye(8)[i] * a + np.eye(8)[j] * b]]
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = roots()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and mend an odd sum at the worst coordinate."""
    r = np.round(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    if len(odd):
        d = x[odd] - r[odd]
        k = np.abs(d).argmax(1)
        r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 shifted by one half in every coordinate."""
    a = nearest_d8(x)
    b = nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def frame(table: int, length: int, dims: int) -> np.ndarray:
    """``dims`` orthonormal directions of a table."""
    g = np.random.Generator(np.random.PCG64([table, length, dims]))
    return np.linalg.qr(g.standard_normal((length, max(1, min(dims, length)))))[0]


KEYS = random64(64, 8) | U(1)


def cells(unit: np.ndarray, table: int, dims: int = DIMS, probes: int = PROBES, cell: float = CELL) -> np.ndarray:
    """(vectors, 1 + probes) cell keys: the home cell, then the next nearest lattice points' cells."""
    x = unit @ frame(table, unit.shape[1], dims)
    shift = np.random.Generator(np.random.PCG64([table, 99])).random(x.shape[1])
    x = x * (np.sqrt(unit.shape[1] / 8) / cell) + shift
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))
    n, runs = len(x), x.shape[1] // 8
    home, near, step = [], [], []
    for r in range(runs):
        y = x[:, r * 8: r * 8 + 8]
        p = nearest_e8(y)
        cost = 2 - 2 * (y - p) @ ROOTS.T  # squared distance to p + root, less that to p
        k = min(probes, len(ROOTS) - 1)
        best = np.argpartition(cost, k, axis=1)[:, :k] if k else np.zeros((n, 0), np.int64)
        home.append(p)
        near.append(best)
        step.append(np.take_along_axis(cost, best, 1))

    def key(points: np.ndarray, r: int) -> np.ndarray:
        w = np.round(points * 2).astype(np.int64).view(U)
        return mix64((w * KEYS[r * 8 + np.arange(8)]).sum(-1, dtype=U) + U(r))

    base = [key(p, r) for r, p in enumerate(home)]
    out = [sum(base[1:], base[0])]
    if probes:
        alt = [key(home[r][:, None, :] + ROOTS[near[r]], r) - base[r][:, None] for r in range(runs)]
        alt, cost = np.concatenate(alt, 1), np.concatenate(step, 1)
        pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out += list((out[0][:, None] + np.take_along_axis(alt, pick, 1)).T)
    return mix64(np.stack(out, 1) + U((table * 0x9E3779B97F4A7C15 + unit.shape[1]) % 2 ** 64))


def vectors_of(column) -> list:
    """Vectors of an Arrow list column as float64 (None: cannot link)."""
    out = []
    for v in column:
        x = None
        if v.is_valid and len(v.values):
            arr = v.values
            if arr.null_count == 0:
                x = np.asarray(arr.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(x).all() or not x.any():
                    x = None
        out.append(x)
    return out


def units(raw: list[bytes], wide: bool) -> np.ndarray:
    """Vectors of one length, scaled to length one in double precision."""
    x = np.frombuffer(b"".join(raw), np.float64 if wide else np.float32).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _vectors(wide: bool):
    """(id, embedding) -> (id, ok, key, vec): vec the components' bytes, key their hash."""
    schema = pa.schema([("id", pa.int64()), ("ok", pa.bool_()), ("key", pa.int64()), ("vec", pa.binary())])

    def run(batches):
        for b in batches:
            vecs, keys = [], []
            for x in vectors_of(b.column(1)):
                if x is None:
                    vecs.append(None)
                    keys.append(0)
                    continue
                bits = mix64((x + 0.0).view(U)) * (U(2) * np.arange(len(x), dtype=U) + U(1))
                keys.append(int(mix64(np.array([bits.sum(dtype=U)])).view(np.int64)[0]))
                vecs.append(x.astype(np.float64 if wide else np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([v is not None for v in vecs]), pa.array(keys, pa.int64()), pa.array(vecs, pa.binary())],
                schema=schema)

    return run


def _by_length(raw: list[bytes]) -> dict[int, np.ndarray]:
    n = np.array([len(x) for x in raw])
    return {int(k): np.flatnonzero(n == k) for k in np.unique(n)}


def _cells(tables: int, dims: int, probes: int, cell: float, wide: bool):
    """(key, vec) -> (cell, tab, home, key): where every vector is home or a guest."""
    schema = pa.schema([("cell", pa.int64()), ("home", pa.bool_()), ("key", pa.int64()), ("tab", pa.int32())])

    def run(batches):
        for b in batches:
            key, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            for _, at in _by_length(raw).items():
                unit = units([raw[i] for i in at], wide)
                for t in range(tables):
                    c = cells(unit, t, dims, probes, cell).view(np.int64)
                    w = c.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.ravel()), pa.array(np.tile(np.arange(w) == 0, len(at))),
                         pa.array(np.repeat(key[at], w)), pa.array(np.full(c.size, t, np.int32))], schema=schema)

    return run


def _meet(dims: int, probes: int, cell: float, least: float, wide: bool):
    """Tasks of (task, tab, cell, key, n, home, part, both, vec) -> links' counts (key, n) and a forest (key, other).

    ``both`` is false in a task that holds one chunk against itself, true if parts 0 and 1 meet.
    """
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def first_here(own: list[np.ndarray], i: np.ndarray, j: np.ndarray, at: int) -> np.ndarray:
        """Of linked pairs, those that no earlier table or cell holds; own: the members' cells by table."""
        ok = np.ones(len(i), bool)
        for t, c in enumerate(own):
            a, b = c[i], c[j]
            # homes meet in a cell if either's home is among the other's cells
            in_a = (b == a[:, :1]).any(1)  # meet in a's home
            in_b = (a == b[:, :1]).any(1)  # meet in b's home
            if t < len(own) - 1:
                ok &= ~(in_a | in_b)
            else:
                low = np.minimum(np.where(in_a, a[:, 0], U(2 ** 64 - 1)), np.where(in_b, b[:, 0], U(2 ** 64 - 1)))
                ok &= low == np.uint64(at % 2 ** 64)
        return ok

    def run(batches):
        out = {"key": [], "n": [], "other": []}
        for t in groups(batches, "task"):
            if t.num_rows < 2:
                continue
            raw = t["vec"].to_pylist()
            tab, at, both = int(t["tab"][0].as_py()), int(t["cell"][0].as_py()), bool(t["both"][0].as_py())
            key, n = t["key"].to_numpy(), t["n"].to_numpy()
            home, part = t["home"].to_numpy(zero_copy_only=False), t["part"].to_numpy()
            for _, ids in _by_length(raw).items():
                unit = units([raw[i] for i in ids], wide)
                count, parent, own = np.zeros(len(ids), np.int64), np.arange(len(ids)), None
                step = max(1, (1 << 22) // max(1, len(ids)))
                # two guests make no pair: only those at home are multiplied with all
                own_home = np.flatnonzero(home[ids])
                for s in range(0, len(own_home), step):
                    cos = unit[own_home[s: s + step]] @ unit.T
                    i, j = np.nonzero(cos >= least)
                    i = own_home[i + s]
                    one, two = ids[i], ids[j]
                    # of two at home, who meet twice, the first meeting counts
                    ok = (part[one] != part[two]) & (~home[two] | (part[one] < part[two])) if both else (i != j) & (~home[two] | (i < j))
                    i, j = i[ok], j[ok]
                    if not len(i):
                        continue
                    own = own or [cells(unit, t, dims, probes, cell) for t in range(tab + 1)]
                    new = first_here(own, i, j, at)
                    i, j = i[new], j[new]
                    np.add.at(count, i, n[ids[j]])
                    np.add.at(count, j, n[ids[i]])
                    for a, b in zip(i.tolist(), j.tolist(), strict=True):
                        while parent[a] != a:
                            parent[a] = a = parent[parent[a]]
                        while parent[b] != b:
                            parent[b] = b = parent[parent[b]]
                        parent[a] = b
                hit = np.flatnonzero(count)
                for a in hit.tolist():
                    r = a
                    while parent[r] != r:
                        r = parent[r]
                    out["key"].append(int(key[ids[a]]))
                    out["n"].append(int(count[a]))
                    out["other"].append(int(key[ids[r]]))
            if len(out["key"]) > 50_000:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out = {"key": [], "n": [], "other": []}
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST,
                    tables: int = TABLES, dims: int = DIMS, probes: int = PROBES, cell: float = CELL,
                    most: int = MOST) -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id, kept."""
    wide = vectors.schema[vec_col].dataType.simpleString() != "array<float>"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("e"))
    rows = cut_lineage(rows.mapInArrow(_vectors(wide), "id bigint, ok boolean, key bigint, vec binary"))
    same = cut_lineage(rows.filter("ok").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("vec").alias("vec")))
    at = cut_lineage(same.select("key", "vec").mapInArrow(
        _cells(tables, dims, probes, cell, wide), "cell bigint, home boolean, key bigint, tab int"))
    # a cell without two members, one of them at home, makes no pair
    full = (at.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.max("home").alias("h")).filter("c > 1 and h")
            .select("cell", F.ceil(F.col("c") / most).cast("bigint").alias("chunks")))
    meet = at.join(full, "cell").withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(5)), F.col("chunks")))
    # chunk i of a cell goes to the tasks (i, j) of all chunks j
    meet = meet.withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)"))).select(
        F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("task"), "tab", "cell", "key",
        "home", (F.col("chunk") > F.col("other")).cast("int").alias("part"), (F.col("chunk") != F.col("other")).alias("both"))
    meet = meet.join(same.select("key", "n", "vec"), "key")
    found = (meet.repartition("task").sortWithinPartitions("task")
             .mapInArrow(_meet(dims, probes, cell, least, wide), "key bigint, n bigint, other bigint"))
    found = cut_lineage(found)
    counts = found.groupBy("key").agg(F.sum("n").alias("m"))
    comp = components(found.select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = same.select("key", "n", "least").join(comp.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left")
    named = named.withColumn("root", F.coalesce("component", "key"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select(
        "key", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"), "component_id")
    out = rows.select("id", "ok", "key").join(named.withColumn("ok", F.lit(True)), ["key", "ok"], "left")
    comp_id = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
                      comp_id.alias("component_id"), F.coalesce(comp_id == F.col("id"), F.lit(False)).alias("kept"))
