"""The pipeline against plain versions of its stages."""
import corpus_pipeline as cp
import pytest
from test_joins import plain_groups

from tabsmith.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in cp.STAGES:
        made = stage(spark, docs, SF)
        made.write.parquet(str(tmp_path / name))
        out[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out[name].columns == list(cp.COLUMNS)
        docs = out[name]
    first = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.score(first, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rows_of(out["toxicity"], "doc_id") == rows_of(scored.filter("not toxic"), "doc_id")
    texts = [tuple(r) for r in out["toxicity"].select("doc_id", "text").collect()]
    kept = {c if n else d for d, n, c in plain_groups(texts)}
    assert {r["doc_id"] for r in out["ngram_jaccard_join"].collect()} == kept
    assert rows_of(out["pii"], "doc_id") == rows_of(out["ngram_jaccard_join"], "doc_id")
    assert not [r for r in out["pii"].collect() if "@" in r["text"] and ".com" in r["text"].split("@")[1].split(" ")[0]]
    assert out["packing"].count() == out["mixing"].count()
    assert {r["doc_id"] for r in out["mixing"].collect()} <= kept


def test_run_equals_query(spark):
    a, b = cp.run(spark, SF), queries.QUERIES["pipeline"](spark, SF)
    assert rows_of(a, *a.columns) == rows_of(b, *b.columns) and a.count() > 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, stage):
    name, run = cp.STAGES[stage]
    got = run(spark, odd_docs, SF)
    n = got.count()
    if name == "ngram_jaccard_join":
        # rows 1, 2, 2 and 3 are alike, and so are 7 and 8
        ids = sorted(str(r["doc_id"]) for r in got.collect())
        assert ids == sorted(map(str, [1, 4, 5, 6, 7, 9, 10, 11, 12, None]))
    elif name in ("pii", "packing"):
        assert n == odd_docs.count()
    assert run(spark, no_docs, SF).count() == 0


def test_near_duplicates_go_by_row(spark):
    """One doc_id on different texts: each row counts in the group of its own text."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    rows = [(1, a), (2, a + " end"), (2, b), (3, b), (4, c), (4, d), (4, d), (5, d + " end"), (5, ""), (6, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.drop_near_duplicates(spark, docs.repartition(3), SF)
    assert rows_of(got, "doc_id", "text") == sorted([(1, a), (2, b), (4, c), (4, d), (5, ""), (6, "alone")], key=str)
