"""Mixing sources to target weights (native DataFrame operations only).

Each source's texts are laid end to end in a pseudorandom document order and cut into blocks of
``block`` words.  The mix has one slot per drawn block.  All slots are put in the order of a keyed
hash and cut into output shards, so a shard's source counts are drawn like multinomial ones with the
sources' totals held fixed; the k-th slot of a source reads block ``perm(k mod B)`` of its
``k div B``-th pass, where ``perm`` is that source's index permutation.  Blocks join slots by
(source, index).

Cases: null and empty texts have size 0 and are never taken; a null source is a source of its
own, last in order; an empty table gives an empty result; repeated rows are separate rows, of
which equal ones are interchangeable; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.order import running_start
from tabsmith.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK = 128
SHARD_SLOTS = 1024
CHUNK = 4096
SEED = 20
#: Multipliers of the index permutations: primes, so one that does not divide the length is coprime to it.
PRIMES = (1000000007, 998244353, 1000000009, 754974721, 469762049)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def permuted(index: Column, n: Column, shift: Column) -> Column:
    """A permutation of 0..n-1: index -> (a * index + shift) mod n with a coprime to n."""
    a = F.lit(PRIMES[-1])
    for p in reversed(PRIMES[:-1]):
        a = F.when(n % F.lit(p) != 0, F.lit(p)).otherwise(a)
    wide = index.cast("decimal(19,0)") * a.cast("decimal(10,0)") + shift.cast("decimal(19,0)")
    return F.when(n == 1, F.lit(0)).otherwise((wide % n.cast("decimal(19,0)")).cast("bigint")).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """One row per source: rank, source_size, target.

    ``weights`` repeat over the sources in code-point order, null last.  A target above ``most``
    times its source stops there and its excess goes to the others by weight, until none is above.
    That fixed point is ``min(most * size, level * weight)``; ``level`` follows from the sources in
    the order in which they reach their limit.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = src.withColumn("_w", w).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), "rank")
    everything = Window.partitionBy()
    src = (src.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
           .withColumn("_capped", F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("_rest", F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_rest"))
           .withColumn("_place", F.row_number().over(by)))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_place", "_level"))
    src = src.withColumn("_at", F.min(fits).over(everything)["_level"])
    return src.select("source", "rank", "source_size",
                      F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap"))).alias("target"))


def draws(src: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row (source, block, pass, number) per block that the mix draws; numbers run through all sources.

    A source gets as many draws as its target holds blocks of its mean length.
    """
    src = _counted(src, block)
    seen = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("_from", F.coalesce(F.sum("_n").over(seen), F.lit(0)).cast("bigint")).filter("_n > 0")
    few = src.withColumn("_c", F.explode(F.expr(f"sequence(0L, (_n - 1) div {CHUNK}L)")))
    few = few.repartition(F.col("rank"), F.col("_c"))
    out = few.withColumn("_k", F.explode(F.expr(f"sequence(_c * {CHUNK}L, least(_n, (_c + 1) * {CHUNK}L) - 1)")))
    return out.select(
        "source",
        permuted(F.col("_k") % F.col("_blocks"), F.col("_blocks"),
                 (F.col("rank") * 104729 + seed).cast("bigint")).alias("block"),
        F.expr("_k div _blocks").alias("pass"), (F.col("_from") + F.col("_k")).alias("number"))


def _counted(src: DataFrame, block: int) -> DataFrame:
    """Add each source's blocks and draws; sources without words are left out."""
    src = src.withColumn("_blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("bigint")).filter("_blocks > 0")
    return src.withColumn("_n", F.round(F.col("target") * F.col("_blocks") / F.col("source_size")).cast("bigint"))


def plan_slots(src: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The draws dealt out: one row (source, shard, slot, block, pass) per slot of the mix.

    A draw's slot is its place in the order of a keyed hash of its number; ``shard_slots`` slots make
    a shard.
    """
    n = _counted(src, block).agg(F.sum("_n")).first()[0] or 0
    rows = draws(src, block, seed).withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    rows = running_start(rows, "_all", "number", "_one", "slot", n, seed * 7919)
    return rows.select("source", F.expr(f"slot div {shard_slots}L").alias("shard"), "slot", "block", "pass")


def shard_counts(slots: DataFrame) -> DataFrame:
    """(shard, source, n): how many blocks of each source a shard holds."""
    return slots.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n"))


def placed(sizes: DataFrame, n_rows: int, seed: int = SEED) -> DataFrame:
    """Add ``start``: the word offset of each document in its source's stream."""
    return running_start(sizes, "source", "doc_id", "size", "start", n_rows, seed)


def spans(at: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per (document, block of its source that it touches): block, lo, hi in words of the text."""
    at = at.filter("size > 0").withColumn(
        "block", F.explode(F.expr(f"sequence(start div {block}L, (start + size - 1) div {block}L)")))
    return (at.withColumn("lo", F.expr(f"greatest(block * {block}L - start, 0L)"))
            .withColumn("hi", F.expr(f"least((block + 1) * {block}L - start, size)")))


def with_sizes(docs: DataFrame) -> tuple[DataFrame, int]:
    sizes = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return sizes, sizes.count()


def mix(docs: DataFrame, weights=WEIGHTS, most: int = 3, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    sizes, n_rows = with_sizes(docs)
    src = cut_lineage(targets(sizes, weights, most))
    times = draws(src, block, seed).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    at = placed(sizes, n_rows, seed)
    pieces = spans(at, block).alias("p")
    # the planner takes exploded tables for small: a merge join, whatever it thinks
    taken = (pieces.join(times.hint("merge").alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))
                         & (F.col("p.block") == F.col("t.block")))
             .groupBy("p.source", "p.doc_id", "p.start")
             .agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken")).alias("k"))
    out = at.alias("a").join(taken.hint("merge"), F.col("a.source").eqNullSafe(F.col("k.source"))
                             & F.col("a.doc_id").eqNullSafe(F.col("k.doc_id"))
                             & (F.col("a.start") == F.col("k.start")) & (F.col("a.size") > 0), "left")
    out = out.join(src.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source")))
    return out.select("a.doc_id", "a.size", "s.source_size", "s.target",
                      F.coalesce("k.taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_texts(docs: DataFrame, weights=WEIGHTS, most: int = 3, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself: one row per piece of a document in a slot.

    Columns of ``documents`` (doc_id, text, lang, source, n_chars) plus shard, slot and place (the
    piece's first word in its block).  A piece runs from its first word up to the next piece's
    first word, so the pieces of one pass over a text join to the whole text.
    """
    words = r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
    sizes, n_rows = with_sizes(docs)
    src = cut_lineage(targets(sizes, weights, most))
    slots = plan_slots(src, block, seed=seed)
    at = placed(sizes, n_rows, seed).filter("size > 0")
    # repeated ids: equal (id, source, size) rows are paired by their place among themselves
    same = Window.partitionBy("doc_id", "source", "size")
    at = at.withColumn("_i", F.row_number().over(same.orderBy("start")))
    rows = docs.select("doc_id", "text", "lang", "source", word_count(F.col("text")).alias("size")).filter("size > 0")
    rows = rows.withColumn("_i", F.row_number().over(same.orderBy("text", "lang")))
    rows = rows.alias("r").join(at.hint("merge").alias("a"), F.col("r.doc_id").eqNullSafe(F.col("a.doc_id"))
                                & F.col("r.source").eqNullSafe(F.col("a.source"))
                                & (F.col("r.size") == F.col("a.size")) & (F.col("r._i") == F.col("a._i")))
    rows = rows.select("r.doc_id", "r.text", "r.lang", "r.source", "a.size", "a.start")
    rows = rows.withColumn("_w", F.regexp_extract_all("text", F.lit(words), F.lit(0)))
    rows = rows.withColumn("_skip", (F.size("_w") - F.col("size")).cast("int"))
    cut = F.expr(f"""transform(sequence(start div {block}L, (start + size - 1) div {block}L), b -> named_struct(
        'block', b, 'place', greatest(start - b * {block}L, 0L),
        'text', array_join(slice(_w, if(b * {block}L <= start, 1, cast(b * {block}L - start as int) + 1 + _skip),
            cast(least((b + 1) * {block}L - start, size) - greatest(b * {block}L - start, 0L) as int)
            + if(b * {block}L <= start, _skip, 0)), '')))""")
    pieces = rows.withColumn("_p", F.explode(cut)).select(
        "doc_id", "lang", "source", F.col("_p.block").alias("block"), F.col("_p.place").alias("place"),
        F.col("_p.text").alias("text")).alias("p")
    out = pieces.join(slots.hint("merge").alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))
                      & (F.col("p.block") == F.col("t.block")))
    return out.select("p.doc_id", "p.text", "p.lang", "p.source",
                      F.char_length("p.text").cast("bigint").alias("n_chars"), "t.shard", "t.slot", "p.place")
