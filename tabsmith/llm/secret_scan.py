"""Secrets by grammar inference over labelled credentials.

Three base patterns give spans of the kinds ``assign``, ``access`` and ``hex``.  Credentials that they do not know
are found by their format: for every labelled format a probabilistic automaton is inferred (``automata``), and every
candidate, a run of credential characters or a piece of one between ``=``, ``/`` and full stops, is scored by all of them.  A
candidate is added under the format that explains it best, if

* its log-likelihood a character is not below that of nearly all labelled examples of the format
  that were kept from the inference (their ``ODD`` quantile, less ``SLACK``),
* its length is within the examples' range, widened by ``STRETCH``, and
* the format explains it better than the automaton of ordinary candidates by ``MARGIN`` nats.

Labelled credentials are the values that the base patterns find in the corpus (formats ``like_assign``,
``like_access``, ``like_hex``) and examples made from publicly documented formats (``FORMATS``).  Ordinary
candidates come from the corpus, less those that already fit a format.  Both samples are bounded (``SAMPLE`` and
``ORDINARY`` distinct values in the order of a hash, of at most ``LONGEST`` characters); base spans and scores
cover all texts whole.  The texts are scanned once: spans and candidates are kept in the checkpoint.

Cases: null and empty texts have no spans; offsets are code points, ends exclusive; a candidate that
overlaps a base span is not added; repeated rows are scanned each; without labelled values of a base kind that
kind has no automaton; an empty table gives an empty result; null doc_ids stay; other columns are ignored.
"""

from __future__ import annotations

import pickle
import random
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.automata import Automaton
from tabsmith.session import cut_lineage

KINDS = ("assign", "access", "hex")
#: The base patterns; the word of an assignment is of any case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6
# a run is taken whole, so asking for its least length at once is the same as dropping short runs
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
PIECES = (re.compile(r"[^=/]{16,}"), re.compile(r"[^=/.]{16,}"))
EDGE = "=/.-"

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALNUM = UPPER + LOWER + DIGITS
URL64 = ALNUM + "-_"
XDIGITS = DIGITS + "abcdef"
#: Publicly documented credential formats as parts, a literal or (alphabet, least and greatest length).
FORMATS = {
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), (ALNUM, 36, 36)),
    "github_fine": (("github_pat_",), (ALNUM, 22, 22), ("_",), (ALNUM, 59, 59)),
    "gitlab": (("glpat-",), (URL64, 20, 20)),
    "slack": (("xoxb-", "xoxp-", "xoxa-"), (DIGITS, 10, 13), ("-",), (DIGITS, 10, 13), ("-",), (ALNUM, 24, 24)),
    "stripe": (("sk_live_", "rk_live_", "sk_test_"), (ALNUM, 24, 34)),
    "google": (("AIza",), (URL64, 35, 35)),
    "sendgrid": (("SG.",), (URL64, 22, 22), (".",), (URL64, 43, 43)),
    "npm": (("npm_",), (ALNUM, 36, 36)),
    "pypi": (("pypi-AgEIcHlwaS5vcmc",), (URL64, 50, 90)),
    "hugging": (("hf_",), (UPPER + LOWER, 34, 34)),
    "ocean": (("dop_v1_", "doo_v1_"), (XDIGITS, 64, 64)),
    "twilio": (("SK", "AC"), (XDIGITS, 32, 32)),
    "shopify": (("shpat_", "shpss_"), (XDIGITS, 32, 32)),
    "openkey": (("sk-",), (ALNUM, 48, 48)),
    "access_temporary": (("ASIA",), (UPPER + DIGITS, 16, 16)),
    "jwt": (("eyJ",), (ALNUM, 17, 60), (".eyJ",), (URL64, 20, 120), (".",), (URL64, 43, 43)),
}
#: Bounds of the samples: labelled values of a format, made examples of a format, ordinary candidates, characters of one.
SAMPLE = 400
MADE = 300
ORDINARY = 2000
LONGEST = 256
ODD = 0.05
SLACK = 0.35
STRETCH = 0.1
MARGIN = 2.0
SEED = 12
ORDINARY_KIND = "ordinary"


def made(kind: str, n: int = MADE, seed: int = SEED) -> list[str]:
    """Examples of a documented format."""
    rng = random.Random(f"{seed}:{kind}")
    out = []
    for _ in range(n):
        word = ""
        for part in FORMATS[kind]:
            word += "".join(rng.choices(part[0], k=rng.randint(*part[1:]))) if isinstance(part[-1], int) else rng.choice(part)
        out.append(word)
    return out


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the base patterns, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e, v) for s, k, e, v in sorted(out)]


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """(start, word) of all runs and their pieces, without trailing signs, that overlap no taken span."""
    out = []
    taken = sorted(taken)
    k = 0
    for m in RUN.finditer(text):
        words = {}
        pieces = [(m.start(), m[0])]
        if not m[0].isalnum():
            pieces += [(m.start() + p.start(), p[0]) for cut in PIECES for p in cut.finditer(m[0])]
        for at, piece in pieces:
            word = piece.lstrip("=/.+")
            at += len(piece) - len(word)
            word = word.rstrip(EDGE)
            if len(word) >= 16:
                words[at, word] = None
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        near = []
        j = k
        while j < len(taken) and taken[j][0] < m.end():
            near.append(taken[j])
            j += 1
        out += [(at, w) for at, w in words if not any(s < at + len(w) and at < e for s, e in near)]
    return out


SCAN = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                  ("base_spans", pa.string()), ("known", pa.string()), ("runs", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """Per document the base spans, their values as ``kind value ...`` and the candidates as ``start word ...``."""

    def run(batches):
        for b in batches:
            rows = []
            for text, doc_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = base_spans(text) if text else []
                runs = candidates(text, [(s, e) for s, _, e, _ in found]) if text else []
                kinds = [k for _, k, _, _ in found]
                rows.append((doc_id, *[kinds.count(k) for k in KINDS], ",".join(f"{k}:{s}:{e}" for s, k, e, _ in found),
                             " ".join(f"{k} {v}" for _, k, _, v in found), " ".join(f"{s} {w}" for s, w in runs)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(SCAN)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, SCAN, strict=True)], schema=SCAN)

    rows = docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id"))
    return rows.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, known string, runs string")


def _values(found: DataFrame) -> DataFrame:
    """Distinct (kind, value) of labelled values and ordinary candidates."""

    def run(batches):
        for b in batches:
            seen = set()
            for known, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                known, runs = known.split(), runs.split()
                seen.update((f"like_{k}", v) for k, v in zip(known[::2], known[1::2], strict=True) if len(v) <= LONGEST)
                seen.update((ORDINARY_KIND, w) for w in runs[1::2] if len(w) <= LONGEST)
            yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in seen], "value": [v for _, v in seen]},
                                             schema=pa.schema([("kind", pa.string()), ("value", pa.string())]))

    return found.filter("known <> '' or runs <> ''").select("known", "runs").mapInArrow(run, "kind string, value string").distinct()


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Automaton of one kind from three quarters of its values; the rest sets the least likelihood a character."""
    kind = rows["kind"].iloc[0]
    values = sorted(rows["value"])
    random.Random(SEED).shuffle(values)
    cut = max(1, len(values) * 3 // 4) if len(values) > 3 else len(values)
    model = Automaton(values[:cut])
    rest = values[cut:] or values
    model.least, model.most = min(map(len, values)), max(map(len, values))
    model.floor = sorted(model.loglike(v) / (len(v) + 1) for v in rest)[int(len(rest) * ODD)] - SLACK
    return pd.DataFrame({"kind": [kind], "model": [pickle.dumps(model)]})


def fits(model: Automaton, word: str) -> float | None:
    """Log-likelihood of a word that is typical of the format, else None."""
    if not model.least * (1 - STRETCH) <= len(word) <= model.most * (1 + STRETCH):
        return None
    like = model.loglike(word)
    return like if like / (len(word) + 1) >= model.floor else None


def _sampled(values: DataFrame, kind: str, n: int) -> DataFrame:
    return values.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(n)


def train(found: DataFrame) -> dict[str, Automaton]:
    """Automata by format, and that of ordinary candidates; inferred in one task each, a few KB each."""
    spark = found.sparkSession
    values = cut_lineage(_values(found))
    examples = spark.createDataFrame([(k, v) for k in FORMATS for v in made(k)], "kind string, value string")
    for kind in KINDS:
        examples = examples.unionByName(_sampled(values, f"like_{kind}", SAMPLE))
    out = "kind string, model binary"
    models = {r["kind"]: pickle.loads(r["model"]) for r in examples.groupBy("kind").applyInPandas(_fit, out).collect()}

    def plain(batches):
        for b in batches:
            keep = [all(fits(m, w) is None for m in models.values()) for w in b.column(1).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    ordinary = _sampled(values, ORDINARY_KIND, ORDINARY).mapInArrow(plain, "kind string, value string")
    models |= {r["kind"]: pickle.loads(r["model"]) for r in ordinary.groupBy("kind").applyInPandas(_fit, out).collect()}
    return models


class Scorer:
    """Format of a candidate by likelihood; candidates repeat, so answers are kept."""

    def __init__(self, models: dict[str, Automaton]):
        self.formats = [(k, m) for k, m in sorted(models.items()) if k != ORDINARY_KIND]
        self.ordinary = models.get(ORDINARY_KIND) or Automaton([])
        self.known: dict[str, tuple[str, float] | None] = {}

    def format_of(self, word: str) -> tuple[str, float] | None:
        """(format, nats over the ordinary) or None."""
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            likes = [(like, k) for k, m in self.formats if (like := fits(m, word)) is not None]
            best = max(likes, default=None)
            gain = best[0] - self.ordinary.loglike(word) if best else 0.0
            self.known[word] = (best[1], gain) if best and gain >= MARGIN else None
        return self.known[word]

    def added(self, runs: str) -> list[tuple[int, str, int]]:
        """(start, format, end) of the candidates that are secrets; of overlapping ones that with the greater gain."""
        parts = runs.split()
        hits = []
        for start, word in zip(map(int, parts[::2]), parts[1::2], strict=True):
            if got := self.format_of(word):
                hits.append((-got[1], start, got[0], start + len(word)))
        out: list[tuple[int, str, int]] = []
        for _, start, kind, end in sorted(hits):
            if not any(s < end and start < e for s, _, e in out):
                out.append((start, kind, end))
        return sorted(out)


def find(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_assign, n_access, n_hex, base_spans, spans (``kind:start:end``, comma-joined), n_added."""
    found = cut_lineage(scan(docs))
    models = docs.sparkSession.sparkContext.broadcast(train(found))  # a few KB a format

    def run(batches):
        scorer = Scorer(models.value)
        for b in batches:
            spans, n = [], []
            for base, runs in zip(b.column("base_spans").to_pylist(), b.column("runs").to_pylist(), strict=True):
                added = scorer.added(runs) if runs else []
                n.append(len(added))
                if added:
                    own = [(int(s), KINDS.index(k), k, int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                    every = sorted(own + [(s, len(KINDS), k, e) for s, k, e in added])
                    base = ",".join(f"{k}:{s}:{e}" for s, _, k, e in every)
                spans.append(base)
            keep = b.select(["doc_id", "n_assign", "n_access", "n_hex", "base_spans"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(spans, pa.string()), pa.array(n, pa.int64())],
                                             names=[*keep.schema.names, "spans", "n_added"])

    out = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string, n_added bigint"
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_spans", "runs").mapInArrow(run, out)
