import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import block_labeller, page_maker, pii, toxicity
from tabsmith.llm.html_blocks import leaves

SF = "/root/testdata/sf0.01"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            x = [int(c) for c in reversed(d)]
            luhn = sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(x)) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(v) <= 255 for v in m[0].split(".")),
                    "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def odd_texts():
    rng = random.Random(3)
    out = ["a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "é😀 a@b.co +1 (555) 555-2485 4242 4242 4242 4242 4242424242424242",
           "+49 (0)30 12-34.56 +1+2 34567890 99999999999.1.1.1", "a..b@@c.d e@f.g@h.i", " ".join(map(str, range(2000))), "x" * 20000 + "@", "", None,
           "+" + "1 " * 20000 + "9", "call 555 123-4567 or (212) 555-0199, john at example dot com, j [at] x [dot] org"]
    return out + ["".join(rng.choices("a@.+1234567890- ()x%", k=60)) for _ in range(300)]


def test_pii_base_spans(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, start long")
    for r in pii.find(df).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_spans"] == want
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(list(filter(None, want.split(","))))


def test_pii_redact(spark, odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in pii.redact(odd_docs).collect()}
    assert rows[10]["text"] == "[EMAIL], [PHONE], [IP], [CARD]" and rows[10]["n_chars"] == len(rows[10]["text"])
    assert rows[5]["text"] in (None, "") and len(rows[9]["text"]) == 150000
    assert pii.find(odd_docs).count() == odd_docs.count()
    assert pii.find(no_docs).count() == 0 and pii.redact(no_docs).count() == 0


def test_pii_em_learns_reliable_labelers():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.5
        # labelers right in 95, 85, 60 and 90 of 100 cases; the third mostly keeps silent
        v = tuple(2 if j == 2 and rng.random() < 0.7 else int((rng.random() < p) == y) for j, p in enumerate((0.95, 0.85, 0.6, 0.9)))
        counts[(0, *v)] = counts.get((0, *v), 0) + 1
    m = pii.SpanClassifier(counts)
    rel = [m.reliability[0][j][1][1] / (m.reliability[0][j][1][1] + m.reliability[0][j][1][0]) for j in range(4)]
    assert rel[0] > 0.9 and rel[1] == pytest.approx(0.85, abs=0.05) and rel[2] < 0.75 and m.prior[0] == pytest.approx(0.5, abs=0.05)
    odds = lambda v: m.weights[(0, "bias", 0)] + sum(m.weights[(0, n, x)] for n, x in zip(pii.LABELERS, v, strict=True))
    assert odds((1, 1, 2, 1)) > 0 > odds((0, 0, 2, 0))
    assert pii.SpanClassifier({}).weights == {}


def test_toxicity_held_out(spark):
    # enough labels for a firm figure; a part of the toxic labels marks texts like any other, so 1 is out of reach
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(r["score"], truth[r["doc_id"]], r["toxic"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    pos, neg = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert len(pos) > 50 and np.mean([a > b for a in pos for b in neg]) > 0.9
    assert np.mean([t for _, y, t in held if not y]) < 0.05         # clean documents stay


def test_toxicity_few_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(s, truth[i]) for i, s in rows.items() if zlib.crc32(str(i).encode()) % 5 == 0 and i in truth]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    # two standard deviations of a chance AUC with these counts above one half
    chance = ((len(pos) + len(neg) + 1) / (12 * len(pos) * len(neg))) ** 0.5
    assert np.mean([a > b for a in pos for b in neg]) > min(0.9, 0.5 + 2 * chance)
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs.repartition(3), labels).collect()}
    assert all(again[i] == pytest.approx(s, abs=1e-6) for i, s in rows.items())


def test_bitmap_of_labelled_ids(spark):
    ids = spark.range(0, 50_000, 7)
    bits = toxicity.bitmap(ids, "id")
    at = np.array([r[0] for r in ids.select(F.pmod(F.xxhash64("id"), F.lit(toxicity.BITS))).collect()])
    assert (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all()
    assert int(np.unpackbits(bits).sum()) == len(set(at.tolist()))
    assert not toxicity.bitmap(ids.limit(0), "id").any()


def test_toxicity_odd(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(odd_docs, none).collect()} == {0.0}
    few = spark.createDataFrame([(1, 1, 1), (7, 1, 0), (7, 0, 0), (12, None, None), (None, 1, 1), (3, 0, 5)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd_docs, few, keep=("source",)).collect()
    assert len(rows) == odd_docs.count() and len({round(r["score"], 9) for r in rows if r["doc_id"] in (4, 5, 6)}) == 1
    assert toxicity.score(no_docs, few).count() == 0


def test_scores_do_not_depend_on_slices():
    m = toxicity.Model()
    rng = np.random.default_rng(0)
    m.table[:-1] = rng.normal(size=m.table[:-1].shape)
    n = [3, 2, 70000, 2, 140000, 5]
    ids = np.concatenate([np.vstack([rng.integers(0, toxicity.ROWS, (k - 2, 3)), np.full((2, 3), toxicity.ROWS)]) for k in n]).astype(np.int32)
    off = np.concatenate([[0], np.cumsum(n)])
    whole = m.scores(ids, off)
    alone = [m.scores(ids[a:b], np.array([0, b - a]))[0] for a, b in zip(off[:-1], off[1:], strict=True)]
    assert np.allclose(whole, alone, atol=1e-6)


def test_threshold():
    s, y = np.linspace(0, 1, 100), np.r_[np.zeros(70), np.ones(30)]
    t = toxicity.best_threshold(s, y)
    assert ((s >= t) == y).all() and toxicity.best_threshold(s[:5], y[:5]) is None


def test_thresholds_cover_all_labelled_rows(spark):
    """A sample cap and long texts take no row from the calibration; every row is scored by a model that has not seen it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"])
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    rem = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = docs.withColumn("text", F.when(rem == 1, F.concat("text", F.repeat(F.lit(" and so on"), 3100))).otherwise(F.col("text")))
    models = toxicity.train(docs, labels, 60)
    # the texts of remainder 1 are too long for the sample, so leaving them out changes nothing
    assert sorted(models) == [0, 1, 2, 3, 4] and len({models[k].table.tobytes() for k in (0, 2, 3, 4)}) == 4
    assert models[0].table.tobytes() == models[1].table.tobytes()
    sent = spark.sparkContext.broadcast({k: models[k] for k in toxicity.FOLDS})
    rows = toxicity.crossfit(docs, labels, sent).withColumn("rem", rem).collect()
    assert len(rows) == docs.filter(rem != 0).count() and all(r["fold"] == r["rem"] for r in rows)
    s, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    lang = np.array([r["lang"] or "" for r in rows])
    every = toxicity.best_threshold(s, y)
    assert every is not None
    got = {(r["lang"] or "", r["threshold"]) for r in toxicity.score(docs, labels, per_label=60).select("lang", "threshold").distinct().collect()}
    own = {x: toxicity.best_threshold(s[lang == x], y[lang == x]) if x else None for x in set(lang)}
    assert {g for g in got if g[0] in own} == {(x, every if t is None else t) for x, t in own.items()}


def test_raw_elements_end_where_they_do():
    def texts(html):
        return [x.text for x in leaves(html)]

    for tag in ("<svg-icon name=x></svg-icon>", "<svg class=i/>", "<svg/>", "<template-x>", "<style-guide></style-guide>", "<script-box a='b'>",
                "<svg a><path d='M0'/><b>no</b></svg>", "<svg>no</svg >", "<script>no</script>", "<style\n>no</style>", "<script src=x />no</script>"):
        assert texts(f"<p>a</p>{tag}<p>rest</p>") == ["a", "rest"], tag


@pytest.fixture(scope="module")
def labeller(spark):
    return block_labeller.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_labeller_on_made_pages(labeller):
    test = page_maker.labelled(120, 991)
    wrong = np.concatenate([(p >= 0.5) != np.array(y) for p, (_, y) in zip(labeller.label([x for x, _ in test]), test, strict=True)])
    assert wrong.mean() < 0.02


def test_labeller_on_pages(spark, labeller):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = block_labeller.extract(pages, labeller).collect()
    right = 0
    for r in rows:
        want = " ".join(x.text for x in leaves(html[r["page_id"]]) if "article" in x.path)
        right += r["text"] == want
    assert len(rows) == len(html) and right >= 0.98 * len(rows)


def test_labeller_odd(spark, labeller):
    rows = [(1, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (3, "u", "<p", "t"), (4, "u", "<p>é</p>" * 20000, "t"), (None, "u", "<script>x</script>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = block_labeller.extract(df, labeller).collect()
    assert len(got) == 6 and all(r["text"] == "" for r in got if r["page_id"] != 4)
    assert block_labeller.extract(df.limit(0), labeller).count() == 0


def test_labeller_batches_do_not_matter(labeller):
    pages = [x for x, _ in page_maker.labelled(30, 5)]
    together = labeller.label(pages)
    assert all(np.allclose(a, labeller.label([p])[0], atol=1e-4) for a, p in zip(together, pages, strict=True))
