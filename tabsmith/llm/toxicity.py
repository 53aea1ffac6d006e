"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of three rows of hashed tables: two independent hashes of the word (a
clash in one is not a clash in both) and a hash of its first bytes, for forms not seen in training.
Filters of one, two and three words run over the whole text; each filter keeps its greatest value,
and a logistic layer turns these into a score.  Rows of the tables start at zero, so words that
training never saw say nothing, however long the text is.

The classifier is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` rows of each label,
in a fixed pseudorandom order of doc_id, of texts up to ``TRAIN_CHARS`` code points.  Rows with
``crc32(doc_id as text) mod 5 = 0`` are held out and never looked at; all others train the model that scores.
Thresholds are cross-fitted: for each of the remainders 1 to 4 a further model trains on the other three and
scores the labelled rows of that remainder, all of them and of any length.  The threshold of each language has the
best F1 over these scores in steps of 1/``BINS``; the driver sees the counts by language, label and step.
All models are trained in tasks, side by side, and come back as a few MB.  Scoring covers whole texts of any length.

A language needs ``LEAST_TOXIC`` rows of either label for a threshold of its own.

Cases: null and empty texts get the score of a text without words; a null or unknown language has
the threshold of all languages; labels other than 0 and 1 are left out, of contradicting labels the
greater counts; without labels of both kinds every score is 0 (or 1, if all are toxic); an empty
table gives an empty result; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.text import IS_LETTER, mix64, words
from tabsmith.session import cut_lineage

ROWS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIX = 4
SAMPLE = 3000
TRAIN_CHARS = 30_000
#: Passes over the sample: as many as make ``STEPS`` batches, within these limits.
EPOCHS = (8, 40)
STEPS = 1200
#: The remainders whose labelled rows may be learned from.
FOLDS = (1, 2, 3, 4)
#: Labelled rows of either label that a threshold of its own takes.
LEAST_TOXIC = 20
#: Steps of the thresholds.
BINS = 1000
#: Bits of the filter of labelled ids.
BITS = 1 << 23
BATCH = 32
RATE = 0.02
SEED = 9
#: Share of the words that a training step leaves out, and documents of the sample that a table row must occur in to
#: be trained: else a few hundred texts are learned by heart, each by words of its own.
DROP = 0.5
LEAST_DOCS = 8
#: Table row of a word that is left out; it stays zero.
SILENT = ROWS - 1
PAD = max(WIDTHS) - 1
U = np.uint64


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def features(column):
    """Chunks of (first, last, ids, offsets): ids (positions, 3) into the tables; every text ends with
    ``PAD`` empty positions, whose id is ``ROWS``."""
    for w in words(column, PREFIX, IS_LETTER):
        ids = np.stack([mix64(w.hash ^ U(1)) % U(ROWS), mix64(w.hash ^ U(2)) % U(ROWS), mix64(w.prefix ^ U(3)) % U(ROWS)], 1)
        n = w.last - w.first
        off = np.concatenate([[0], np.cumsum(w.counts + PAD)])
        out = np.full((int(off[-1]), 3), ROWS, np.int32)
        out[np.arange(len(w.doc)) + PAD * (w.doc - w.first)] = ids
        yield w.first, w.first + n, out, off


class Model:
    """Tables, filters and output layer; ``fit`` trains, ``scores`` applies."""

    def __init__(self, constant: float | None = None):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.constant = constant
        self.table = np.zeros((ROWS + 1, DIM), np.float32)
        self.filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.5).astype(np.float32) for w in WIDTHS]
        self.bias = [np.full(FILTERS, 0.01, np.float32) for _ in WIDTHS]
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.5).astype(np.float32)
        self.out_bias = np.float32(0)

    def _conv(self, x: np.ndarray, i: int, pad: np.ndarray) -> np.ndarray:
        """Filter values of the windows that start at every position; at padding just the bias.

        A window from a text's last word ends in its own padding, so none reaches the next text.
        """
        k = self.filters[i]
        y = x @ k[0]
        for j in range(1, WIDTHS[i]):
            y[:-j] += x[j:] @ k[j]
        y[pad] = 0
        return y + self.bias[i]

    def scores(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        pooled = np.full((n, FILTERS * len(WIDTHS)), -np.inf, np.float32)
        # a long chunk in slices that overlap by the padding, so no window is cut
        step = 1 << 16
        for s in range(0, len(ids), step):
            e = min(len(ids), s + step)
            block = ids[s: min(len(ids), e + PAD)]
            x = self.table[block[:, 0]]
            x += self.table[block[:, 1]]
            x += self.table[block[:, 2]]
            pad = block[:, 0] == ROWS
            lo = int(np.searchsorted(off, s, side="right")) - 1
            cut = off[lo:int(np.searchsorted(off, e, side="left"))]
            cut = np.maximum(cut, s)
            rows = np.arange(lo, lo + len(cut))
            for i in range(len(WIDTHS)):
                best = np.maximum.reduceat(self._conv(x, i, pad)[: e - s], cut - s, axis=0)
                f = slice(i * FILTERS, (i + 1) * FILTERS)
                pooled[rows, f] = np.maximum(pooled[rows, f], best)
        z = np.maximum(pooled, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """Adagrad on the logistic loss with word dropout; gradients reach only the positions that pooling kept."""
        rng = np.random.Generator(np.random.PCG64(SEED + 1))
        sums = {"table": np.full(self.table.shape, 1e-6, np.float32), "out": np.full(self.out.shape, 1e-6), "ob": 1e-6}
        f_sums = [(np.full(k.shape, 1e-6), np.full(FILTERS, 1e-6)) for k in self.filters]
        count = np.zeros(ROWS + 1, np.int64)
        for x in docs:
            count[np.unique(x)] += 1
        seen = count >= LEAST_DOCS
        seen[SILENT:] = False
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        batches = -(-len(docs) // BATCH)
        for _ in range(min(EPOCHS[1], max(EPOCHS[0], STEPS // max(1, batches)))):
            order = rng.permutation(len(docs))
            for s in range(0, len(order), BATCH):
                pick = order[s: s + BATCH]
                ids = np.concatenate([docs[i] for i in pick])
                gone = (rng.random(len(ids)) < DROP) & (ids[:, 0] != ROWS)
                ids = np.where(gone[:, None], SILENT, ids)
                off = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
                x = self.table[ids].sum(1)
                pad = ids[:, 0] == ROWS
                pooled, where = [], []
                for i in range(len(WIDTHS)):
                    c = self._conv(x, i, pad)
                    at = np.stack([c[a:b].argmax(0) + a for a, b in zip(off[:-1], off[1:], strict=True)])
                    where.append(at)
                    pooled.append(c[at, np.arange(FILTERS)])
                act = np.concatenate(pooled, 1)
                h = np.maximum(act, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30)))
                g = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                g_act = g[:, None] * self.out * (act > 0)
                g_out, g_ob = h.T @ g, g.sum()
                rows, grads = [], []
                for i, w in enumerate(WIDTHS):
                    gi = g_act[:, i * FILTERS: (i + 1) * FILTERS]
                    g_word = gi * ~pad[where[i]]
                    gk = np.zeros_like(self.filters[i])
                    for j in range(w):
                        at = np.minimum(where[i] + j, len(x) - 1)
                        gk[j] = np.einsum("bfd,bf->df", x[at], g_word)
                        gx = g_word[:, :, None] * self.filters[i][j].T[None]
                        rows.append(ids[at].reshape(-1))
                        grads.append(np.repeat(gx.reshape(-1, DIM), 3, axis=0))
                    self._step(self.filters[i], gk, f_sums[i][0])
                    self._step(self.bias[i], gi.sum(0), f_sums[i][1])
                rows, grads = np.concatenate(rows), np.concatenate(grads)
                live = seen[rows] & (np.abs(grads).max(1) > 0)
                if live.any():
                    u, inv = np.unique(rows[live], return_inverse=True)
                    total = np.zeros((len(u), DIM), np.float32)
                    np.add.at(total, inv, grads[live])
                    sums["table"][u] += total ** 2
                    self.table[u] -= RATE * 5 * total / np.sqrt(sums["table"][u])
                self._step(self.out, g_out, sums["out"])
                sums["ob"] += float(g_ob) ** 2
                self.out_bias -= np.float32(RATE * g_ob / np.sqrt(sums["ob"]))

    @staticmethod
    def _step(value: np.ndarray, grad: np.ndarray, total: np.ndarray) -> None:
        total += grad.astype(np.float64) ** 2
        value -= (RATE * grad / np.sqrt(total)).astype(value.dtype)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of every labelled id."""
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return ids.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """(ids, toxic, doc_id, fold) of the bounded training sample; ids are the word ids of ``features``."""
    ids = labelled(labels).filter(remainder(F.col("doc_id")) != 0)
    order = [F.xxhash64("doc_id"), "doc_id"]
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    text = text.filter(F.coalesce(F.char_length("text"), F.lit(0)) <= TRAIN_CHARS)
    few = None
    for label in (0, 1):
        part = ids.filter(F.col("toxic") == label).orderBy(*order).limit(per_label)
        few = part if few is None else few.unionByName(part)

    def run(batches):
        for b in batches:
            for first, last, x, off in features(b.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[off[i]: off[i + 1]].tobytes() for i in range(last - first)], pa.binary())]
                    + [b.column(c).slice(first, last - first) for c in (1, 2)], names=["ids", "toxic", "doc_id"])

    # at most 2 * per_label ids are broadcast
    rows = text.join(F.broadcast(few), "doc_id").select("text", "toxic", "doc_id")
    rows = rows.mapInArrow(run, "ids binary, toxic int, doc_id bigint")
    return rows.withColumn("fold", remainder(F.col("doc_id")).cast("int"))


def steps(score: np.ndarray) -> np.ndarray:
    """Step of each score: the number of the greatest threshold that it reaches."""
    return np.searchsorted(np.arange(BINS + 1) / BINS, score, side="right") - 1


def threshold_of(clean: np.ndarray, toxic: np.ndarray) -> float | None:
    """Threshold with the best F1 for the rows of either label by step; of equal ones the nearest to 0.5."""
    if toxic.sum() < LEAST_TOXIC or clean.sum() < LEAST_TOXIC:
        return None
    hits, wrong = np.cumsum(toxic[::-1])[::-1], np.cumsum(clean[::-1])[::-1]
    f1 = 2 * hits / (hits + wrong + toxic.sum())
    best = np.flatnonzero(f1 == f1.max())
    return float(best[np.argmin(np.abs(best - BINS / 2))] / BINS)


def best_threshold(score: np.ndarray, y: np.ndarray) -> float | None:
    """``threshold_of`` the scores of rows with labels ``y``."""
    at = steps(score)
    return threshold_of(np.bincount(at[y == 0], minlength=BINS + 1), np.bincount(at[y == 1], minlength=BINS + 1))


def scored(rows: DataFrame, models, fold: str | None = None) -> DataFrame:
    """``rows``, whose first column is the text, with the score in its place; ``models`` (by number) is broadcast.

    ``fold`` names the column with a row's model; without it model 0 scores.
    """
    at = None if fold is None else rows.columns.index(fold)

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            which = np.zeros(b.num_rows, int) if at is None else b.column(at).to_numpy()
            for first, last, ids, off in features(b.column(0)):
                for k in np.unique(which[first:last]):
                    mine = which[first:last] == k
                    out[first:last][mine] = models.value[k].scores(ids, off)[mine]
            yield pa.RecordBatch.from_arrays([pa.array(out), *b.columns[1:]], names=["score", *b.schema.names[1:]])

    return rows.mapInArrow(run, ", ".join(["score double"] + [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]))


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of a hash of every id, 1 MB whatever their number."""
    h = F.pmod(F.xxhash64(column), F.lit(BITS)) + 1        # Spark's bitmaps count from one
    got = ids.groupBy(F.bitmap_bucket_number(h).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("m")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in got:
        out[(r["b"] - 1) * 4096: r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def crossfit(docs: DataFrame, labels: DataFrame, models) -> DataFrame:
    """(score, doc_id, lang, fold, toxic) of all labelled rows that are not held out, by the model that has not seen their fold.

    A bitmap of the labelled ids' hashes keeps nearly all other rows from being scored; only (id, score) is joined
    with the labels, so no text is shuffled.
    """
    known = labelled(labels)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(known, "doc_id"))

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        at = h.to_numpy()
        return pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    rows = docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id"), "lang").filter("doc_id is not null")
    rows = rows.filter(maybe(F.pmod(F.xxhash64("doc_id"), F.lit(BITS))))
    rows = rows.withColumn("fold", remainder(F.col("doc_id")).cast("int")).filter("fold <> 0")
    return scored(rows, models, "fold").join(known, "doc_id").select("score", "doc_id", "lang", "fold", "toxic")


def calibrate(docs: DataFrame, labels: DataFrame, models) -> tuple[dict, float]:
    """Thresholds by language and of all languages, from the cross-fitted scores; ``models`` is broadcast."""
    rows = crossfit(docs, labels, models)
    # the greatest threshold k / BINS that the score reaches, as the comparison with it decides
    k = F.round(F.col("score") * BINS).cast("int")
    rows = rows.withColumn("step", k - (F.col("score") < k / F.lit(float(BINS))).cast("int"))
    hist = rows.groupBy("lang", "step").agg(
        F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    hist = cut_lineage(hist)
    enough = hist.groupBy("lang").agg(F.sum("clean").alias("_c"), F.sum("toxic").alias("_t"))
    enough = enough.filter(f"lang <> '' and _c >= {LEAST_TOXIC} and _t >= {LEAST_TOXIC}").select("lang")
    own = hist.join(enough, "lang", "left_semi").collect()
    every = hist.groupBy("step").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()

    def threshold(rows: list) -> float | None:
        counts = np.zeros((2, BINS + 1), np.int64)
        for r in rows:
            counts[:, r["step"]] += (r["clean"], r["toxic"])
        return threshold_of(*counts)

    by = {x: threshold([r for r in own if r["lang"] == x]) for x in sorted({r["lang"] for r in own})}
    whole = threshold(every)
    return by, 0.5 if whole is None else whole


def fitted(ids: list[bytes], y: np.ndarray) -> Model:
    """The model of a sample; of one label only, a constant."""
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y[0]) if len(y) else 0.0)
    model = Model()
    model.fit([np.frombuffer(x, np.int32).reshape(-1, 3) for x in ids], y.astype(np.float32))
    return model


def _packed(model: Model) -> bytes:
    return zlib.compress(pickle.dumps(model), 1)          # most rows of the table are still zero


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> dict[int, Model]:
    """Model 0, of the whole sample, and models 1 to 4, each of the sample without the rows of that fold.

    Each is trained in a task of its own from at most 2 * per_label rows.
    """
    rows = cut_lineage(sample(docs, labels, per_label))
    others = F.filter(F.array(*[F.lit(k) for k in (0, *FOLDS)]), lambda k: k != F.col("fold"))

    def fit(table: pa.Table) -> pa.Table:
        order = sorted(range(len(table)), key=lambda i: (table["doc_id"][i].as_py(), table["ids"][i].as_py()))
        ids, y = table["ids"].to_pylist(), table["toxic"].to_numpy()
        model = fitted([ids[i] for i in order], y[order])
        return pa.table({"model": pa.array([table["model"][0].as_py()], pa.int32()), "data": pa.array([_packed(model)], pa.binary())})

    made = rows.withColumn("model", F.explode(others)).groupBy("model").applyInArrow(fit, "model int, data binary").collect()
    models = {k: Model(constant=0.0) for k in (0, *FOLDS)}
    return models | {r["model"]: pickle.loads(zlib.decompress(r["data"])) for r in made}


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), per_label: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, lang, held_out, score, predicted (score of 0.5 or more), threshold (of its language), toxic; and ``keep``."""
    sc = docs.sparkSession.sparkContext
    models = train(docs, labels, per_label)
    by, every = {}, 0.5
    if models[0].constant is None:
        folds = sc.broadcast({k: models[k] for k in FOLDS})  # tables of a fixed size, 4 MB each
        by, every = calibrate(docs, labels, folds)
        folds.destroy()
    model = sc.broadcast({0: models[0]})
    del models
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(F.col("text").alias("_text"), doc_id.alias("_doc_id"), F.col("lang").alias("_lang"),
                       *[F.col(c).alias(f"_keep_{c}") for c in keep])
    limit = F.lit(every)
    if by:
        known = F.create_map(*[F.lit(x) for k, v in by.items() for x in (k, v)])
        limit = F.coalesce(known[F.col("_lang")], limit)
    out = scored(rows, model)
    return out.select(F.col("_doc_id").alias("doc_id"), F.col("_lang").alias("lang"), F.coalesce(remainder(F.col("_doc_id")) == 0, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), limit.alias("threshold"),
                      (F.col("score") >= limit).alias("toxic"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
