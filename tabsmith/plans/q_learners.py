"""Queries of the learners with checked numbers: neighbours, DBSCAN, ridge by normal equations, naive Bayes, cards."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabsmith.functions.columns import hash_bucket, hash_bucket_sql
from tabsmith.operators import density, neighbours
from tabsmith.operators.linear_cv import ridge_cv
from tabsmith.plans import cards
from tabsmith.plans import train as TR
from tabsmith.plans.catalog import register, rnd
from tabsmith.plans.fixtures import CLUSTERS_SQL, DESIGN_MATRIX_SQL, clusters, design_matrix, table
from tabsmith.plans.registry import registry_sql

KEYS = ["l_orderkey", "l_linenumber"]
FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rf_a", "rf_n", "rf_r", "ls_f"]
SPLIT = hash_bucket_sql(KEYS)


# ------------------------------------------------------------------ nearest neighbours, DBSCAN

@register("knn_neighbours_part", f"""WITH p AS (SELECT p_partkey, x1, x2 FROM {CLUSTERS_SQL}),
 d AS (SELECT a.p_partkey, b.p_partkey AS neighbour, (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) AS d2
       FROM p a JOIN p b ON a.p_partkey <> b.p_partkey)
SELECT p_partkey, rank, neighbour, round(sqrt(d2), 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d2, neighbour) AS rank FROM d) WHERE rank <= 5""")
def q_neighbours(spark, sf):
    """The five nearest other parts of every part by size and price, ties by key."""
    p = clusters(spark, sf).select(F.col("p_partkey").alias("key"), F.array("x1", "x2").alias("x"))
    # one more than asked for: a part is among its own neighbours, unless six others are equal and come first
    found = neighbours.nearest(p.withColumnRenamed("key", "qid"), neighbours.build(p, 6), 6).filter("qid <> key")
    best = neighbours._best(found, ["qid"], ["d2", "key"], 5)
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "key"))
    out = best.select(F.col("qid").alias("p_partkey"), rank.cast("bigint").alias("rank"), F.col("key").alias("neighbour"), F.sqrt("d2").alias("distance"))
    return rnd(out, {"distance": 6})


EPS, MIN_SAMPLES = 2.0, 6


@register("dbscan_part", f"""WITH RECURSIVE p AS (SELECT p_partkey, x1, x2 FROM {CLUSTERS_SQL}),
 near AS (SELECT a.p_partkey AS a, b.p_partkey AS b, b.x1, b.x2, (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) AS d2
          FROM p a JOIN p b ON (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) <= {EPS} * {EPS}),
 core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
 edge AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
 reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
 least AS (SELECT reach.a, min((p.x1, p.x2)) AS first FROM reach JOIN p ON p.p_partkey = reach.b GROUP BY reach.a),
 named AS (SELECT a, dense_rank() OVER (ORDER BY first) - 1 AS cluster FROM least),
 border AS (SELECT near.a, arg_min(named.cluster, (near.d2, near.x1, near.x2)) AS cluster FROM near JOIN named ON near.b = named.a GROUP BY near.a)
SELECT p.p_partkey, CAST(coalesce(named.cluster, border.cluster, -1) AS INTEGER) AS cluster
FROM p LEFT JOIN named ON named.a = p.p_partkey LEFT JOIN border ON border.a = p.p_partkey""")
def q_dbscan(spark, sf):
    """DBSCAN of the parts by size and price (eps 2, six rows)."""
    p = clusters(spark, sf).select("p_partkey", array_to_vector(F.array("x1", "x2")).alias("features"))
    return density.DBSCAN(eps=EPS, min_samples=MIN_SAMPLES).fit(p).transform(p).select("p_partkey", "cluster")


# ------------------------------------------------------------------ ridge by normal equations

def _moments(feats: list[str], y: str, rows: str, by: str = "") -> str:
    """Per group n, means and the centred augmented matrix [X'X + alpha I | X'y] of ``rows`` (columns feats, y, alpha)."""
    cells = [[f"sum({a} * {b}) - sum({a}) * sum({b}) / count(*)" + (" + alpha" if i == j else "") for j, b in enumerate([*feats, y])]
             for i, a in enumerate(feats)]
    matrix = "[" + ", ".join("[" + ", ".join(r) + "]" for r in cells) + "]"
    return (f"SELECT {by}{', ' if by else ''}alpha, {matrix} AS m, [" + ", ".join(f"avg({f})" for f in feats) + f"] AS mx, avg({y}) AS my "
            f"FROM {rows} GROUP BY {by}{', ' if by else ''}alpha")


def _solve(name: str, source: str, keys: list[str], p: int) -> str:
    """CTEs that eliminate the matrix m of ``source`` row by row; ``name`` has the keys, coef, mx, my."""
    k = ", ".join(keys)
    return f"""{name}_step AS (SELECT {k}, mx, my, 1 AS k, m FROM {source}
  UNION ALL SELECT {k}, mx, my, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda v: v / m[k][k])
      ELSE list_transform(row, lambda v, j: v - row[k] / m[k][k] * m[k][j]) END) FROM {name}_step WHERE k <= {p}),
 {name} AS (SELECT {k}, mx, my, list_transform(m, lambda row: row[{p + 1}]) AS coef FROM {name}_step WHERE k = {p} + 1)"""


def _line(feats: list[str], coef: str = "coef", mx: str = "mx", my: str = "my") -> str:
    return my + " + " + " + ".join(f"{coef}[{i + 1}] * ({f} - {mx}[{i + 1}])" for i, f in enumerate(feats))


_DM = f"(SELECT *, CASE WHEN {SPLIT} < 2000 THEN 'test' ELSE 'train' END AS split, 1.0 AS alpha FROM {DESIGN_MATRIX_SQL})"


@register("ridge_holdout", f"""WITH RECURSIVE d AS {_DM}, g AS ({_moments(FEATS, 'y_reg', "(SELECT * FROM d WHERE split = 'train')")}),
 {_solve('s', 'g', ['alpha'], len(FEATS))},
 t AS (SELECT y_reg AS label, {_line(FEATS)} AS prediction FROM d, s WHERE split = 'test')
SELECT metric, round(value, 3) AS value FROM (SELECT sqrt(avg((label - prediction) ^ 2)) AS rmse, avg(abs(label - prediction)) AS mae,
  1 - avg((label - prediction) ^ 2) / var_pop(label) AS r2, 1 - var_pop(label - prediction) / var_pop(label) AS explained_variance FROM t)
UNPIVOT (value FOR metric IN (rmse, mae, r2, explained_variance))""")
def q_ridge(spark, sf):
    """A2 + T2: ridge (alpha 1) on the train split, metrics of the test split; checked by elimination in SQL."""
    prep = TR.prepare(design_matrix(spark, sf).select(*KEYS, *FEATS, "y_reg"), "y_reg", KEYS, "regression")
    return rnd(TR.train(prep, "reg_ridge", {"alpha": 1.0}).metrics.select("metric", "value"), {"value": 3})


OLS_FEATS = ["l_extendedprice", "l_discount", "l_tax"]


@register("ols_holdout", f"""WITH RECURSIVE d AS (SELECT *, CASE WHEN {SPLIT} < 2000 THEN 'test' ELSE 'train' END AS split, 0.0 AS alpha FROM {DESIGN_MATRIX_SQL}),
 g AS ({_moments(OLS_FEATS, 'y_reg', "(SELECT * FROM d WHERE split = 'train')")}),
 {_solve('s', 'g', ['alpha'], len(OLS_FEATS))},
 t AS (SELECT y_reg AS label, {_line(OLS_FEATS)} AS prediction FROM d, s WHERE split = 'test')
SELECT metric, round(value, 3) AS value FROM (SELECT sqrt(avg((label - prediction) ^ 2)) AS rmse, avg(abs(label - prediction)) AS mae,
  1 - avg((label - prediction) ^ 2) / var_pop(label) AS r2, 1 - var_pop(label - prediction) / var_pop(label) AS explained_variance FROM t)
UNPIVOT (value FOR metric IN (rmse, mae, r2, explained_variance))""")
def q_ols(spark, sf):
    """A1 + T2: least squares on three features, metrics of the test split."""
    prep = TR.prepare(design_matrix(spark, sf).select(*KEYS, *OLS_FEATS, "y_reg"), "y_reg", KEYS, "regression")
    return rnd(TR.train(prep, "reg_linear").metrics.select("metric", "value"), {"value": 3})


@register("clf_ridge_holdout", f"""WITH RECURSIVE d AS (SELECT *, y_bin * 2.0 - 1 AS y FROM {_DM}),
 g AS ({_moments(FEATS, 'y', "(SELECT * FROM d WHERE split = 'train')")}),
 {_solve('s', 'g', ['alpha'], len(FEATS))},
 t AS (SELECT y_bin AS label, CASE WHEN {_line(FEATS)} > 0 THEN 1 ELSE 0 END AS prediction FROM d, s WHERE split = 'test')
SELECT CAST(label AS DOUBLE) AS label, CAST(prediction AS DOUBLE) AS prediction, count(*) AS n FROM t GROUP BY ALL""")
def q_ridge_clf(spark, sf):
    """A13 + V16: confusion counts of the ridge classifier on the test split."""
    prep = TR.prepare(design_matrix(spark, sf).select(*KEYS, *FEATS, "y_bin"), "y_bin", KEYS, "classification")
    res = TR.train(prep, "clf_ridge", {"alpha": 1.0})
    return res.predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


_FOLD = hash_bucket_sql(KEYS, 43, 3)
_ALPHAS = [0.5, 1.0, 2.0]


@register("ridge_cv_folds", f"""WITH RECURSIVE d AS (SELECT *, {_FOLD} AS fold FROM {DESIGN_MATRIX_SQL} WHERE {SPLIT} >= 2000),
 a AS (SELECT unnest({[f'{a}' for a in _ALPHAS]}::DOUBLE[]) AS alpha), f AS (SELECT unnest([0, 1, 2]) AS out),
 g AS ({_moments(OLS_FEATS, 'y_reg', "(SELECT d.*, a.alpha, f.out FROM d JOIN f ON d.fold <> f.out CROSS JOIN a)", 'out')}),
 {_solve('s', 'g', ['out', 'alpha'], len(OLS_FEATS))},
 t AS (SELECT s.alpha, s.out, y_reg AS label, {_line(OLS_FEATS)} AS prediction FROM d JOIN s ON d.fold = s.out)
SELECT alpha, CAST(out AS VARCHAR) AS fold, round(1 - avg((label - prediction) ^ 2) / var_pop(label), 8) AS r2 FROM t GROUP BY alpha, out""")
def q_ridge_folds(spark, sf):
    """R^2 of every penalty and fold from one Gram pass."""
    prep = TR.prepare(design_matrix(spark, sf).select(*KEYS, *OLS_FEATS, "y_reg"), "y_reg", KEYS, "regression")
    rows = prep.data.where(F.col("split") == "train").withColumn("fold", hash_bucket(KEYS, 43, 3).cast("int"))
    got = ridge_cv(rows, "features", "label", "fold", _ALPHAS)
    return rnd(spark.createDataFrame(got, "alpha double, fold string, r2 double"), {"r2": 8})


# ------------------------------------------------------------------ Gaussian naive Bayes

NB = ["l_quantity", "l_discount", "l_tax"]


@register("naive_bayes_holdout", f"""WITH d AS {_DM}, tr AS (SELECT * FROM d WHERE split = 'train'),
 eps AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({f})' for f in NB)}) AS eps FROM tr),
 c AS (SELECT y_bin AS cls, ln(count(*) / (SELECT count(*) FROM tr)) AS prior, {', '.join(f'avg({f}) AS m{i}, var_pop({f}) AS v{i}' for i, f in enumerate(NB))}
       FROM tr GROUP BY y_bin),
 s AS (SELECT row_number() OVER () AS id, * FROM d WHERE split = 'test'),
 l AS (SELECT s.id, s.y_bin, c.cls, prior + {' + '.join(f'(-0.5 * ln(2 * pi() * (v{i} + eps)) - ({f} - m{i}) ^ 2 / (2 * (v{i} + eps)))' for i, f in enumerate(NB))} AS score
       FROM s, c, eps)
SELECT CAST(y_bin AS DOUBLE) AS label, CAST(prediction AS DOUBLE) AS prediction, count(*) AS n
FROM (SELECT id, any_value(y_bin) AS y_bin, arg_max(cls, score) AS prediction FROM l GROUP BY id) GROUP BY 1, 2""")
def q_nb_holdout(spark, sf):
    """A21 + V16: confusion counts of Gaussian naive Bayes on the test split."""
    prep = TR.prepare(design_matrix(spark, sf).select(*KEYS, *NB, "y_bin"), "y_bin", KEYS, "classification")
    return TR.train(prep, "clf_naive_bayes").predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ cards and search spaces

_PARAM_VALUES = ",\n ".join(
    "('" + "', '".join([p["key"], p["name"], p["text"], p["kind"]]) + "', "
    + ", ".join("NULL" if p[x] is None else repr(p[x]) for x in ("least", "greatest", "step")) + ", "
    + ("NULL" if p["choices"] is None else "'" + ",".join(p["choices"]) + "'") + ")" for p in cards.PARAMS)
PARAMS_SQL = f"(SELECT * FROM (VALUES {_PARAM_VALUES}) AS p(key, name, default_value, kind, least, greatest, step, choices))"


# feedback events per card, so that the answers come from a given table too
_CARD = "[" + ", ".join(f"'{k}'" for k, *_ in cards.CARDS) + "]"
_EVENTS_SQL = f"(SELECT {_CARD}[CAST(event_id % {len(cards.CARDS)} + 1 AS INTEGER)] AS key, count(*) AS events FROM events GROUP BY 1)"


def _events(spark, sf):
    ev = table(spark, sf, "events")
    key = F.element_at(F.array(*[F.lit(k) for k, *_ in cards.CARDS]), (F.col("event_id") % len(cards.CARDS) + 1).cast("int"))
    return ev.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("events"))


@register("registry_params", f"""SELECT p.key, e.events, g.name AS card, g.task_type, g.family, g.available, p.name, p.default_value, p.kind,
  CAST(p.least AS DOUBLE) AS least, CAST(p.greatest AS DOUBLE) AS greatest, CAST(p.step AS DOUBLE) AS step, p.choices
FROM {PARAMS_SQL} p JOIN {registry_sql()} g USING (key) JOIN {_EVENTS_SQL} e USING (key)""")
def q_params(spark, sf):
    """Typed parameters of the cards that feedback names, with its number of events."""
    return cards.params_table(spark).join(_events(spark, sf), "key")


@register("search_spaces", f"""WITH p AS (SELECT *, CASE WHEN default_value = 'None' THEN least ELSE TRY_CAST(default_value AS DOUBLE) END AS start FROM {PARAMS_SQL}),
 n AS (SELECT key, name, kind, list_sort(list_distinct([start, greatest(least, CASE WHEN kind = 'int' THEN floor(start / 2) ELSE start / 2 END),
                                                        least(greatest, start * 2)])) AS v FROM p WHERE kind IN ('int', 'float') AND least IS NOT NULL),
 u AS (SELECT key, name, generate_subscripts(v, 1) - 1 AS position, unnest(v) AS value FROM n)
SELECT * FROM (SELECT key, name, CAST(position AS INTEGER) AS position, value, CAST(NULL AS VARCHAR) AS choice FROM u
UNION ALL SELECT key, name, CAST(generate_subscripts(string_split(choices, ','), 1) - 1 AS INTEGER), NULL, unnest(string_split(choices, ',')) FROM p WHERE kind = 'choice')
JOIN {_EVENTS_SQL} USING (key)""")
def q_spaces(spark, sf):
    """Search space of the cards that feedback names: default, half and double within the bounds; all choices."""
    t = cards.space_table(spark).join(_events(spark, sf), "key")
    number = F.expr("try_cast(value AS double)")
    return t.select("key", "events", "name", "position", number.alias("value"), F.when(number.isNull(), F.col("value")).alias("choice"))
