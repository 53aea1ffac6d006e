"""Registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.llm import alignment, block_labeller, lattice, merkle, minhash, mixing, ngram_join, packing, pii, secret_scan, toxicity, url_rules, warc

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark, sf_dir):
    """Main text of every page."""
    return block_labeller.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def op2_minhash(spark, sf_dir):
    """Fingerprints of every document and its edited text, with their likeness."""
    return minhash.edited_likeness(table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    """Bucket, batch and place of every document; production buckets and token budget."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    """Metadata and conversion records of every page's response; texts as digests and lengths."""
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")), carry=("page_id",))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type",
                       "block_digest", "source_payload_digest", F.octet_length("block").cast("bigint").alias("content_length"),
                       F.char_length("block").cast("bigint").alias("n_chars"))


def op5_pii(spark, sf_dir):
    """Spans of personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op6_ngram_join(spark, sf_dir):
    """Set size and component of every document: 5-word shingles, Jaccard 0.75 or more."""
    return ngram_join.join_groups(table(spark, sf_dir, "documents"))


def op7_url_rules(spark, sf_dir):
    """Verdict of the fixed rules on every page URL."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op8_lattice(spark, sf_dir):
    """Links, component and keep flag of every embedding at cosine 0.95 or more."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark, sf_dir):
    """Toxicity score of every document; the model learns from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_mixing(spark, sf_dir):
    """What the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_merkle(spark, sf_dir):
    """Leaf, subroot, root, proof digest and verification of every document."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_secrets(spark, sf_dir):
    """Spans of secrets in every document: base patterns and learned formats."""
    found = secret_scan.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")


def op13_alignment(spark, sf_dir):
    """Groups, links and pair counts of every document under two tokenizers."""
    return alignment.align(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline over ``documents``."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html, op2_minhash, op3_packing, op4_warc, op5_pii, op6_ngram_join, op7_url_rules, op8_lattice, op9_toxicity, op10_mixing, op11_merkle, op12_secrets, op13_alignment, pipeline)}

ORACLE: dict[str, str] = {}

ORACLE["op7_url_rules"] = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT page_id, host, path,
       CASE WHEN on_net AND is_en THEN 'example.net/en/' WHEN is_de THEN 'example.com/de/'
            WHEN is_fr THEN 'org/fr/' WHEN on_net THEN 'net/' END AS rule,
       CASE WHEN on_net AND is_en THEN 'allow' WHEN is_de THEN 'block'
            WHEN is_fr THEN 'allow' WHEN on_net THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' AS on_net,
             (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' AS is_en,
             (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' AS is_de,
             (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' AS is_fr
      FROM u)
"""

ORACLE["op10_mixing"] = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sizes GROUP BY source),
fill(source, w, cap, target, excess, round) AS (
  SELECT source, w, 3.0::DOUBLE * source_size, (SELECT sum(source_size) FROM src)::DOUBLE * w / (SELECT sum(w) FROM src), true, 0 FROM src
  UNION ALL
  SELECT source, w, cap,
         CASE WHEN target >= cap THEN cap
              ELSE ((SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(CASE WHEN target >= cap THEN cap END) OVER (), 0))
                   * w / sum(CASE WHEN target < cap THEN w END) OVER () END,
         max(CASE WHEN target > cap THEN 1 ELSE 0 END) OVER () = 1, round + 1
  FROM fill WHERE excess),
t0 AS (SELECT source, arg_max(target, round) AS target FROM fill GROUP BY source),
t AS (
  SELECT s.source, s.source_size, s.rnk, t0.target, CAST(ceil(s.source_size / 128.0) AS BIGINT) AS blocks
  FROM src s JOIN t0 ON s.source IS NOT DISTINCT FROM t0.source),
draw AS (SELECT *, CASE WHEN blocks > 0 THEN CAST(round(target * blocks / source_size) AS BIGINT) ELSE 0 END AS n FROM t),
mult AS (
  SELECT source, rnk, blocks, CASE WHEN blocks % 1000000007 <> 0 THEN 1000000007 ELSE 998244353 END AS a, unnest(range(n)) AS k
  FROM draw WHERE n > 0),
times AS (
  SELECT source, CASE WHEN blocks = 1 THEN 0
                      ELSE CAST(((k % blocks)::HUGEINT * a + (rnk * 104729 + 20)) % blocks AS BIGINT) END AS block,
         count(*) AS times
  FROM mult GROUP BY ALL),
placed AS (
  SELECT doc_id, source, size,
         CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sizes),
cut AS (SELECT *, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT c.source, c.doc_id, c.start,
         CAST(sum((least((c.block + 1) * 128, start + size) - greatest(c.block * 128, start)) * times) AS BIGINT) AS taken
  FROM cut c JOIN times m ON c.source IS NOT DISTINCT FROM m.source AND c.block = m.block GROUP BY ALL)
SELECT p.doc_id, p.size, t.source_size, t.target, coalesce(k.taken, 0) AS taken
FROM placed p JOIN t ON p.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON k.source IS NOT DISTINCT FROM p.source AND k.doc_id IS NOT DISTINCT FROM p.doc_id
  AND k.start = p.start AND p.size > 0
"""

ORACLE["op11_merkle"] = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang,
         concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         -- CRC-32 of the decimal digits: per byte an exclusive or, then eight steps (-1)
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
               lambda i: list_prepend(CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT), list_transform(range(8), lambda j: CAST(-1 AS BIGINT)))))),
             lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END),
             CAST(4294967295 AS BIGINT)) % 3 = 0 AS odd
  FROM documents),
d AS (
  SELECT doc_id, lang, leaf, tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
               CASE WHEN odd THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered FROM f)),
up AS (
  SELECT lang, 0 AS lvl, pos AS idx, leaf AS node FROM d
  UNION ALL
  SELECT lang, lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS many FROM up) WHERE many > 1 GROUP BY lang, lvl, idx // 8),
sub AS (
  SELECT lang, arg_max(node, lvl) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM up GROUP BY lang),
top AS (
  SELECT 0 AS lvl, pos AS idx, subroot AS node FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS many FROM top) WHERE many > 1 GROUP BY lvl, idx // 8),
low_steps AS (
  SELECT lang, pos, lvl, coalesce(string_agg(node, '' ORDER BY idx) FILTER (idx < own), '') AS l, coalesce(string_agg(node, '' ORDER BY idx) FILTER (idx > own), '') AS r
  FROM (SELECT d.lang, d.pos, up.lvl, up.idx, up.node, d.pos // CAST(8 ** up.lvl AS BIGINT) AS own
        FROM d JOIN up ON d.lang IS NOT DISTINCT FROM up.lang AND up.idx // 8 = d.pos // CAST(8 ** (up.lvl + 1) AS BIGINT)
        JOIN (SELECT lang, max(lvl) AS height FROM up GROUP BY lang) h ON h.lang IS NOT DISTINCT FROM up.lang AND up.lvl < h.height)
  GROUP BY lang, pos, lvl),
high_steps AS (
  SELECT lang, lvl, coalesce(string_agg(node, '' ORDER BY idx) FILTER (idx < own), '') AS l, coalesce(string_agg(node, '' ORDER BY idx) FILTER (idx > own), '') AS r
  FROM (SELECT sub.lang, top.lvl, top.idx, top.node, sub.pos // CAST(8 ** top.lvl AS BIGINT) AS own
        FROM sub JOIN top ON top.idx // 8 = sub.pos // CAST(8 ** (top.lvl + 1) AS BIGINT) AND top.lvl < (SELECT max(lvl) FROM top))
  GROUP BY lang, lvl),
steps AS (
  SELECT d.lang, d.pos, list(s.l || '|' || s.r ORDER BY s.part, s.lvl) FILTER (s.lvl IS NOT NULL) AS path
  FROM d LEFT JOIN (SELECT lang, pos, 0 AS part, lvl, l, r FROM low_steps
                    UNION ALL SELECT high_steps.lang, d.pos, 1, lvl, l, r FROM high_steps JOIN d ON high_steps.lang IS NOT DISTINCT FROM d.lang) s
    ON s.lang IS NOT DISTINCT FROM d.lang AND s.pos = d.pos
  GROUP BY d.lang, d.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM (
  SELECT d.doc_id, d.leaf, sub.subroot, (SELECT arg_max(node, lvl) FROM top) AS root,
         sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(d.tampered, d.leaf), coalesce(path, [])),
                     lambda node, step: sha256(split_part(step, '|', 1) || node || split_part(step, '|', 2))) AS folded_root
  FROM d JOIN sub ON d.lang IS NOT DISTINCT FROM sub.lang
  JOIN steps ON steps.lang IS NOT DISTINCT FROM d.lang AND steps.pos = d.pos)
"""
