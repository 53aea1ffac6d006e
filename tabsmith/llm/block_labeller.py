"""Main text of web pages: a recurrent block labeller.

``html_blocks`` cuts a page into leaf blocks.  Each block is a vector: hashed tag-path tokens, hashed
words, and a few measures (length, link share, punctuation).  A bidirectional LSTM in numpy reads
all blocks of a page forwards and backwards, so every block is classified with the whole page as
its context; the blocks that are the article's are joined in page order by one space.

The labeller is trained in every run on made pages (``page_maker``) and on a bounded sample of the
given pages (``SAMPLE`` page_ids in a fixed pseudorandom order, pages of up to ``SAMPLE_CHARS`` code
points): there, blocks inside ``article`` or ``main``, but not inside menus, adverts and the like, count
as the article's.  Pages without such a tag teach nothing, but are labelled like all others.

Cases: null and empty pages have an empty text; pages without markup are one block; unclosed
tags, comments, scripts and character references are handled by the reader; an empty table
gives an empty result; repeated rows are labelled each; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.html_blocks import Leaf, leaves
from tabsmith.llm.page_maker import labelled
from tabsmith.llm.text import IS_LETTER, words

PATHS, WORDS, EMBED, HIDDEN = 1024, 4096, 16, 16
MEASURES = 6
MADE = 400
SAMPLE = 300
SAMPLE_CHARS = 40_000
EPOCHS = 7
BATCH = 48
RATE = 0.01
SEED = 1
#: Padded block places of one pass through the network.
PLACES = 1 << 16
OUTSIDE = frozenset("nav header footer aside form button select .ad .ads .advert .sidebar .comments .comment .menu .related "
                    ".cookie .notice .banner .share .newsletter".split())


class Bags:
    """Blocks of many pages as hashed bags: path ids and word ids with offsets, and measures."""

    def __init__(self, pages: list[list[Leaf]]):
        blocks = [x for p in pages for x in p]
        self.lengths = np.array([len(p) for p in pages], np.int64)
        known: dict[tuple, list[int]] = {}
        path = []
        for x in blocks:
            if x.path not in known:
                # the last tags count once more, by place
                tokens = [*x.path, *(f"{i}:{t}" for i, t in enumerate(reversed(x.path[-3:])))] or ["-"]
                known[x.path] = [zlib.crc32(t.encode("utf-8", "replace")) % PATHS for t in tokens]
            path.append(known[x.path])
        self.path = np.array([i for p in path for i in p], np.int64)
        self.path_off = np.concatenate([[0], np.cumsum([len(p) for p in path])]).astype(np.int64)
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w in words(pa.array([x.text for x in blocks], pa.large_string()), alphabet=IS_LETTER):
            ids.append((w.hash % np.uint64(WORDS)).astype(np.int64))
            counts.append(w.counts)
        self.word = np.concatenate(ids)
        n_words = np.concatenate(counts)
        self.word_off = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        n = np.array([len(x.text) for x in blocks], np.float64)
        stops = np.array([sum(x.text.count(c) for c in ".,;!?") for x in blocks], np.float64)
        linked = np.array([x.link_chars for x in blocks], np.float64)
        place = np.concatenate([np.arange(k) / max(1, k - 1) for k in self.lengths] or [np.zeros(0)])
        end = np.array([x.text[-1] in ".!?" for x in blocks], np.float64)
        self.measures = np.stack([np.log1p(n_words) / 3, np.log1p(n) / 5, linked / np.maximum(n, 1),
                                  10 * stops / np.maximum(n, 1), place, end], 1).astype(np.float32)


def bag_mean(table: np.ndarray, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean row of every bag; an empty bag is zero."""
    n = np.diff(off)
    out = np.zeros((len(n), table.shape[1]), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(table[ids], off[some], axis=0) / n[some, None]
    return out


def bag_grad(shape: tuple, ids: np.ndarray, off: np.ndarray, grad: np.ndarray) -> np.ndarray:
    n = np.diff(off)
    share = (grad / np.maximum(n, 1)[:, None]).repeat(n, axis=0)
    return np.stack([np.bincount(ids, weights=share[:, k], minlength=shape[0]) for k in range(shape[1])], 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self):
        g = np.random.Generator(np.random.PCG64(SEED))
        d = 2 * EMBED + MEASURES
        def norm(*shape, by):
            return (g.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
        self.p = {"path": norm(PATHS, EMBED, by=4), "word": norm(WORDS, EMBED, by=16), "out": norm(2 * HIDDEN, by=HIDDEN),
                  "out_b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": norm(d, 4 * HIDDEN, by=d), f"h{side}": norm(HIDDEN, 4 * HIDDEN, by=HIDDEN),
                       f"b{side}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}

    def inputs(self, bags: Bags) -> np.ndarray:
        return np.concatenate([bag_mean(self.p["path"], bags.path, bags.path_off),
                               bag_mean(self.p["word"], bags.word, bags.word_off), bags.measures], 1)

    @staticmethod
    def _pad(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(time, page) places of all blocks in order, forwards and backwards, and the mask."""
        page = np.repeat(np.arange(len(lengths)), lengths)
        t = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return t, lengths[page] - 1 - t, page

    def _run(self, x: np.ndarray, side: str, keep: bool):
        """States over (time, page, d); gates are kept for training."""
        steps, n = x.shape[:2]
        z_all = (x.reshape(steps * n, -1) @ self.p[f"x{side}"] + self.p[f"b{side}"]).reshape(steps, n, -1)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        hs, kept = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = z_all[t] + h @ self.p[f"h{side}"]
            s = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN: 2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
            before, c = c, f * c + i * u
            tc = np.tanh(c)
            if keep:
                kept.append((i, f, o, u, before, tc, h))
            h = o * tc
            hs[t] = h
        return hs, kept

    def _back(self, x: np.ndarray, side: str, kept: list, g_hs: np.ndarray, grads: dict) -> np.ndarray:
        steps, n = x.shape[:2]
        g_z = np.empty((steps, n, 4 * HIDDEN), np.float32)
        g_h, g_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        g_w = np.zeros_like(self.p[f"h{side}"])
        for t in range(steps - 1, -1, -1):
            i, f, o, u, before, tc, h = kept[t]
            g = g_hs[t] + g_h
            g_c = g_c + g * o * (1 - tc * tc)
            g_z[t] = np.concatenate([g_c * u * i * (1 - i), g_c * before * f * (1 - f), g * tc * o * (1 - o), g_c * i * (1 - u * u)], 1)
            g_w += h.T @ g_z[t]
            g_h, g_c = g_z[t] @ self.p[f"h{side}"].T, g_c * f
        flat = g_z.reshape(steps * n, -1)
        grads[f"h{side}"], grads[f"b{side}"] = g_w, flat.sum(0)
        grads[f"x{side}"] = x.reshape(steps * n, -1).T @ flat
        return (flat @ self.p[f"x{side}"].T).reshape(x.shape)

    def _forward(self, bags: Bags, keep: bool = False):
        x = self.inputs(bags)
        fwd, bwd, page = self._pad(bags.lengths)
        shape = (int(bags.lengths.max(initial=0)), len(bags.lengths), x.shape[1])
        xf, xb = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
        xf[fwd, page], xb[bwd, page] = x, x
        hf, kf = self._run(xf, "f", keep)
        hb, kb = self._run(xb, "b", keep)
        h = np.concatenate([hf[fwd, page], hb[bwd, page]], 1)
        return sigmoid(h @ self.p["out"] + self.p["out_b"]), (fwd, bwd, page, xf, xb, kf, kb, h)

    def fit(self, pages: list[tuple[list[Leaf], list[int]]]) -> None:
        """Adam on the mean logistic loss of the blocks."""
        g = np.random.Generator(np.random.PCG64(SEED + 1))
        first = {k: np.zeros(v.shape) for k, v in self.p.items()}
        second = {k: np.zeros(v.shape) for k, v in self.p.items()}
        # pages of like length share a batch
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        batches = [[pages[i] for i in order[s: s + BATCH]] for s in range(0, len(order), BATCH)]
        ready = [(Bags([p for p, _ in b]), np.array([y for _, ys in b for y in ys], np.float32)) for b in batches]
        step = 0
        for _ in range(EPOCHS):
            for k in g.permutation(len(ready)):
                bags, y = ready[k]
                if not len(y):
                    continue
                step += 1
                prob, (fwd, bwd, page, xf, xb, kf, kb, h) = self._forward(bags, keep=True)
                d = ((prob - y) / len(y)).astype(np.float32)
                grads = {"out": h.T @ d, "out_b": np.array([d.sum()])}
                g_h = d[:, None] * self.p["out"]
                gf, gb = np.zeros((*xf.shape[:2], HIDDEN), np.float32), np.zeros((*xf.shape[:2], HIDDEN), np.float32)
                gf[fwd, page], gb[bwd, page] = g_h[:, :HIDDEN], g_h[:, HIDDEN:]
                g_x = self._back(xf, "f", kf, gf, grads)[fwd, page] + self._back(xb, "b", kb, gb, grads)[bwd, page]
                grads["path"] = bag_grad(self.p["path"].shape, bags.path, bags.path_off, g_x[:, :EMBED])
                grads["word"] = bag_grad(self.p["word"].shape, bags.word, bags.word_off, g_x[:, EMBED: 2 * EMBED])
                norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
                for name, grad in grads.items():
                    grad = grad * min(1.0, 1.0 / max(norm, 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * grad
                    second[name] = 0.99 * second[name] + 0.01 * grad * grad
                    self.p[name] -= (RATE * (first[name] / (1 - 0.9 ** step))
                                     / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[list[Leaf]]) -> list[np.ndarray]:
        """Probability of every block; pages of like length go through the network together."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        s = 0
        while s < len(order):
            e = s + 1
            while e < len(order) and (e + 1 - s) * len(pages[order[e]]) <= PLACES:
                e += 1
            pick = order[s:e]
            prob, _ = self._forward(Bags([pages[i] for i in pick]))
            at = 0
            for i in pick:
                out[i] = prob[at: at + len(pages[i])]
                at += len(pages[i])
            s = e
        return out


def weak_labels(page: list[Leaf]) -> list[int] | None:
    """Labels that the page's own tags tell, or None."""
    if not any("article" in x.path or "main" in x.path for x in page):
        return None
    return [int(("article" in x.path or "main" in x.path) and not OUTSIDE.intersection(x.path)) for x in page]


def train(pages: DataFrame) -> Labeller:
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").filter(F.char_length("html") <= SAMPLE_CHARS)
    # ids first: only the sample's pages travel
    ids = rows.select("page_id").filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    rows = rows.join(F.broadcast(ids), "page_id").collect()  # SAMPLE ids at most
    examples = labelled(MADE, SEED)
    for r in sorted(rows, key=lambda r: (r["page_id"], r["html"])):
        page = leaves(r["html"])
        y = weak_labels(page)
        if y:
            examples.append((page, y))
    model = Labeller()
    model.fit(examples)
    return model


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Per row: page_id, url, text (the article's blocks, joined by one space), n_blocks, n_kept."""
    model = pages.sparkSession.sparkContext.broadcast(model or train(pages))  # tables of a fixed size, under 1 MB

    def texts(found: list[list[Leaf]]):
        out = []
        for page, prob in zip(found, model.value.label(found), strict=True):
            kept = [x.text for x, p in zip(page, prob, strict=True) if p >= 0.5]
            out.append((" ".join(kept), len(page), len(kept)))
        return out

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                made = texts([leaves(x) for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([m[0] for m in made], pa.string()),
                     pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())],
                    names=["page_id", "url", "text", "n_blocks", "n_kept"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id bigint, url string, text string, n_blocks bigint, n_kept bigint")
