"""Estimator / training queries (A*, T*, Q8, Q9).

Each card is fit on the design matrix (lineitem numerics + one-hot flags,
regression target ``y_reg``, 0/1 target ``y_bin``) and returns its test
metrics; SQL-checkable by-products (1-D OLS, Gaussian NB class statistics)
have oracles, and ``q_learners`` has the learners that SQL can check.  Every fit runs its card's defaults, but for
those in ``REDUCED`` (the README has the measured times that force them).
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabsmith.operators.estimators import make_estimator
from tabsmith.plans import cards
from tabsmith.plans import train as TR
from tabsmith.plans.catalog import register, rnd
from tabsmith.plans.fixtures import DESIGN_MATRIX_SQL, clusters, design_matrix, table

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rf_a", "rf_n", "rf_r", "ls_f"]
KEYS = ["l_orderkey", "l_linenumber"]

#: Parameters below the cards' defaults, because the default fit does not end in reasonable time on one machine.
REDUCED: dict[str, dict] = {
    "reg_random_forest": {"n_estimators": 10, "max_depth": 6}, "clf_random_forest": {"n_estimators": 10, "max_depth": 6},
    "reg_extra_trees": {"n_estimators": 60}, "clf_extra_trees": {"n_estimators": 60},
    "clf_adaboost": {"n_estimators": 100}, "clf_mlp": {"hidden_layer_sizes": (16, 8), "max_iter": 50}}


def _prep(spark, sf, target, task):
    dm = design_matrix(spark, sf).select(*KEYS, *FEATS, target)
    return TR.prepare(dm, target, KEYS, task)


def _train_query(key, task):
    target = "y_bin" if task == "classification" else "y_reg"

    def q(spark, sf):
        res = TR.train(_prep(spark, sf, target, task), key, REDUCED.get(key))
        return res.metrics
    q.__doc__ = f"Fit {key} on the design matrix; test-split metrics."
    return q


for _k in ["reg_linear", "reg_ridge", "reg_lasso", "reg_elasticnet", "reg_bayesianridge", "reg_decision_tree",
           "reg_random_forest", "reg_extra_trees", "reg_gb", "reg_adaboost", "reg_knn"]:
    register(f"train_{_k}")(_train_query(_k, "regression"))
for _k in ["clf_logistic", "clf_ridge", "clf_decision_tree", "clf_random_forest", "clf_extra_trees", "clf_gb", "clf_adaboost",
           "clf_knn", "clf_svm", "clf_naive_bayes", "clf_mlp"]:
    register(f"train_{_k}")(_train_query(_k, "classification"))


def _cluster_query(key):
    def q(spark, sf):
        cl = clusters(spark, sf).select("p_partkey", "x1", "x2")
        prep = TR.prepare(cl, None, ["p_partkey"], "clustering")
        res = TR.train(prep, key, cards.defaults(key))
        return res.predictions.groupBy("model", "cluster").agg(F.count(F.lit(1)).alias("size"))
    q.__doc__ = f"Fit {key} with its card's defaults on part size / price; cluster sizes."
    return q


for _k in ["clu_kmeans", "clu_minibatch_kmeans", "clu_kmedoids", "clu_divisive", "clu_dbscan", "clu_gmm", "clu_spectral"]:
    register(f"train_{_k}")(_cluster_query(_k))


def _embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
                    F.col("label").cast("double").alias("label"))


@register("train_dr_pca")
def q_pca(spark, sf):
    """Explained variance ratio of 10 centred components of the 64-d embeddings."""
    m = make_estimator("dr_pca", {"n_components": 10}).fit(_embeddings(spark, sf))
    ev = m.explainedVariance.toArray()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(ev)], "component int, explained_variance_ratio double")


@register("train_dr_lda")
def q_lda(spark, sf):
    """2-d Fisher projection of the embeddings by label; per-class projected means."""
    e = _embeddings(spark, sf)
    m = make_estimator("dr_lda", {"n_components": 2}).fit(e)
    out = m.transform(e).select("label", F.col("projection"))
    from pyspark.ml.functions import vector_to_array
    a = vector_to_array("projection")
    return out.groupBy("label").agg(F.avg(a[0]).alias("c1"), F.avg(a[1]).alias("c2"), F.count(F.lit(1)).alias("n"))


@register("pca_projection_2d")
def q_pca2(spark, sf):
    """2-D PCA projection of every embedding row."""
    e = _embeddings(spark, sf)
    m = make_estimator("dr_pca", {"n_components": 2}).fit(e)
    from pyspark.ml.functions import vector_to_array
    return m.transform(e).select("vec_id", "label", vector_to_array("pca").alias("xy"))


@register("pca_projection_3d")
def q_pca3(spark, sf):
    """Q9: 3-D projection of every embedding row, components from one Gram pass."""
    from tabsmith.operators.explain import principal_components, project
    e = table(spark, sf, "embeddings")
    e = e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    names = [f"x{i}" for i in range(64)]
    mean, w, _ = principal_components(e, names, 3)
    return project(e, names, mean, w).select("vec_id", "label", "c1", "c2", "c3")


@register("linreg_1d", f"""SELECT round(regr_slope(y_reg, l_quantity), 2) AS slope,
  round(regr_intercept(y_reg, l_quantity), 2) AS intercept FROM {DESIGN_MATRIX_SQL}""")
def q_linreg_1d(spark, sf):
    """A1 on one feature equals the SQL least-squares slope / intercept."""
    dm = design_matrix(spark, sf)
    d = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(dm).withColumn("label", F.col("y_reg"))
    m = make_estimator("reg_linear", {}).fit(d)
    return rnd(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double")
               .select("slope", "intercept"), {"slope": 2, "intercept": 2})


NB_FEATS = ["l_quantity", "l_discount", "l_tax"]


@register("nb_class_stats", "\nUNION ALL\n".join(
    f"""SELECT CAST(y_bin AS DOUBLE) AS label, '{f}' AS feature, round(avg({f}), 4) AS mean, round(var_pop({f}), 4) AS var
FROM {DESIGN_MATRIX_SQL} GROUP BY y_bin""" for f in NB_FEATS))
def q_nb(spark, sf):
    """Gaussian NB parameters (class means / variances) equal the SQL class moments."""
    dm = design_matrix(spark, sf)
    d = VectorAssembler(inputCols=NB_FEATS, outputCol="features").transform(dm).withColumn("label", F.col("y_bin").cast("double"))
    m = make_estimator("clf_naive_bayes", {}).fit(d)
    th, sg = m.theta.toArray(), m.sigma.toArray()
    rows = [(float(lbl), f, float(th[i, j]), float(sg[i, j])) for i, lbl in enumerate(m.labels if hasattr(m, "labels") else range(th.shape[0]))
            for j, f in enumerate(NB_FEATS)]
    return rnd(spark.createDataFrame(rows, "label double, feature string, mean double, var double"), {"mean": 4, "var": 4})


@register("feature_importance_rf")
def q_importance(spark, sf):
    """Q8: random-forest importances by feature name."""
    prep = _prep(spark, sf, "y_reg", "regression")
    res = TR.train(prep, "reg_random_forest", REDUCED.get("reg_random_forest"))
    return spark.createDataFrame(TR.feature_importance(res.model, prep.features), "feature string, importance double")


@register("batch_train_runs")
def q_batch(spark, sf):
    """T5: several cards over one prepared table; one run row + metrics per card."""
    prep = _prep(spark, sf, "y_reg", "regression")
    res = TR.batch_train(prep, ["reg_linear", "reg_ridge", "reg_lasso"], parallel=3, save=True)
    out = res[0].metrics
    for r in res[1:]:
        out = out.unionByName(r.metrics)
    return out


def _best(spark, got):
    params, score, _ = got
    return spark.createDataFrame([(float(score), str(params))], "best_cv_r2 double, best_params string")


@register("grid_search_ridge")
def q_grid(spark, sf):
    """T6 + T7 + T10: 3-fold hash-fold CV over the card's grid of alpha, from one Gram pass."""
    return _best(spark, TR.tune(_prep(spark, sf, "y_reg", "regression"), "reg_ridge", "grid"))


@register("bounded_search_ridge")
def q_bounded(spark, sf):
    """50 uniform draws of alpha between the ends of the card's grid."""
    return _best(spark, TR.tune(_prep(spark, sf, "y_reg", "regression"), "reg_ridge", "bounded"))


@register("random_search_tree")
def q_random(spark, sf):
    """At most 25 combinations of the card's grid of a regression tree, CV-scored."""
    return _best(spark, TR.tune(_prep(spark, sf, "y_reg", "regression"), "reg_decision_tree", "random"))


@register("rfe_select")
def q_rfe(spark, sf):
    """K7: recursive feature elimination with logistic regression down to 4 features."""
    from tabsmith.operators.select import selection_scores
    dm = design_matrix(spark, sf).select(*FEATS, "y_bin")
    return selection_scores(dm, {"method": "rfe", "k": 4, "target": "y_bin", "task_type": "classification"})



@register("cluster_silhouette")
def q_silhouette(spark, sf):
    """V19 (re-aimed): squared-Euclidean silhouette of k-means (k=4) on part size / price."""
    from tabsmith.operators.metrics import silhouette_sq
    cl = clusters(spark, sf).select("p_partkey", "x1", "x2")
    prep = TR.prepare(cl, None, ["p_partkey"], "clustering")
    m = make_estimator("clu_kmeans", {"n_clusters": 4}).fit(prep.data)
    s = silhouette_sq(m.transform(prep.data), "features", "cluster")
    return spark.createDataFrame([(float(s),)], "silhouette_sq double")


@register("pca_reconstruction_error")
def q_recon(spark, sf):
    """Mean squared reconstruction error of a 10-component PCA of the embeddings."""
    from pyspark.ml.functions import vector_to_array
    e = _embeddings(spark, sf)
    m = make_estimator("dr_pca", {"n_components": 10}).fit(e)
    pc = m.components                                   # p x k, small
    mean = m.sc.mean.toArray()
    t = m.transform(e).select(vector_to_array("features").alias("x"), vector_to_array("pca").alias("z"))
    p, k = pc.shape
    err = sum(((t["x"][i] - F.lit(float(mean[i]))
                - sum((t["z"][j] * F.lit(float(pc[i, j])) for j in range(k)), F.lit(0.0))) ** 2
               for i in range(p)), F.lit(0.0)) / p
    return t.agg(F.avg(err).alias("reconstruction_error"))
