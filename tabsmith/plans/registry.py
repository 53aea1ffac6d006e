"""Algorithm registry.

The card list below is fixed reference data: the 45 algorithm cards with
their key, display name, task and family, which the recommender rules
match on.  ``available`` says whether this library can fit the card on
Spark; unavailable cards stay listed with the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference registry): key, name, task, family, optional dependency
CARDS = [
    ("reg_linear", "Linear Regression", "regression", "Linear Models", ""),
    ("reg_ridge", "Ridge Regression", "regression", "Linear Models", ""),
    ("reg_lasso", "Lasso Regression", "regression", "Linear Models", ""),
    ("reg_elasticnet", "ElasticNet", "regression", "Linear Models", ""),
    ("reg_bayesianridge", "Bayesian Ridge", "regression", "Linear Models", ""),
    ("reg_decision_tree", "Decision Tree Regressor", "regression", "Tree-based", ""),
    ("reg_random_forest", "Random Forest Regressor", "regression", "Tree-based", ""),
    ("reg_extra_trees", "Extra Trees Regressor", "regression", "Tree-based", ""),
    ("reg_gb", "Gradient Boosting Regressor", "regression", "Boosting", ""),
    ("reg_adaboost", "AdaBoost Regressor", "regression", "Boosting", ""),
    ("reg_xgboost", "XGBoost Regressor", "regression", "Boosting", "xgboost"),
    ("reg_lightgbm", "LightGBM Regressor", "regression", "Boosting", "lightgbm"),
    ("reg_catboost", "CatBoost Regressor", "regression", "Boosting", "catboost"),
    ("reg_knn", "KNN Regressor", "regression", "Distance-based", ""),
    ("reg_svr", "SVR", "regression", "SVM", ""),
    ("reg_mlp", "MLP Regressor", "regression", "Neural", ""),
    ("clf_logistic", "Logistic Regression", "classification", "Linear", ""),
    ("clf_ridge", "Ridge Classifier", "classification", "Linear", ""),
    ("clf_decision_tree", "Decision Tree Classifier", "classification", "Tree-based", ""),
    ("clf_random_forest", "Random Forest Classifier", "classification", "Tree-based", ""),
    ("clf_extra_trees", "Extra Trees Classifier", "classification", "Tree-based", ""),
    ("clf_gb", "Gradient Boosting Classifier", "classification", "Boosting", ""),
    ("clf_adaboost", "AdaBoost Classifier", "classification", "Boosting", ""),
    ("clf_xgboost", "XGBoost Classifier", "classification", "Boosting", "xgboost"),
    ("clf_lightgbm", "LightGBM Classifier", "classification", "Boosting", "lightgbm"),
    ("clf_catboost", "CatBoost Classifier", "classification", "Boosting", "catboost"),
    ("clf_knn", "KNN Classifier", "classification", "Distance-based", ""),
    ("clf_svm", "SVM (SVC)", "classification", "SVM", ""),
    ("clf_naive_bayes", "Naive Bayes (Gaussian)", "classification", "Probabilistic", ""),
    ("clf_mlp", "MLP Classifier", "classification", "Neural", ""),
    ("clu_kmeans", "K-Means", "clustering", "Centroid-based", ""),
    ("clu_minibatch_kmeans", "Mini-Batch K-Means", "clustering", "Centroid-based", ""),
    ("clu_kmedoids", "K-Medoids", "clustering", "Centroid-based", "sklearn_extra"),
    ("clu_agglomerative", "Agglomerative Clustering", "clustering", "Hierarchical", ""),
    ("clu_divisive", "Divisive (Bisecting K-Means)", "clustering", "Hierarchical", ""),
    ("clu_dbscan", "DBSCAN", "clustering", "Density-based", ""),
    ("clu_hdbscan", "HDBSCAN", "clustering", "Density-based", "hdbscan"),
    ("clu_optics", "OPTICS", "clustering", "Density-based", ""),
    ("clu_gmm", "Gaussian Mixture (GMM)", "clustering", "Probabilistic", ""),
    ("clu_spectral", "Spectral Clustering", "clustering", "Spectral", ""),
    ("dr_pca", "PCA", "dimred", "Linear", ""),
    ("dr_lda", "LDA", "dimred", "Supervised Linear", ""),
    ("dr_tsne", "t-SNE", "dimred", "Nonlinear", ""),
    ("dr_umap", "UMAP", "dimred", "Nonlinear", "umap"),
    ("dr_autoencoder", "Autoencoders", "dimred", "Neural", "torch"),
]

# Cards this library cannot fit on Spark, with the reason (see README "Not built").
UNAVAILABLE = {
    "reg_xgboost": "third-party engine not installed", "reg_lightgbm": "third-party engine not installed",
    "reg_catboost": "third-party engine not installed", "clf_xgboost": "third-party engine not installed",
    "clf_lightgbm": "third-party engine not installed", "clf_catboost": "third-party engine not installed",
    "reg_svr": "kernel solver is single-machine O(n^3)", "reg_mlp": "no Spark MLP regressor",
    "clu_agglomerative": "O(n^2) single-machine", "clu_hdbscan": "sequential single-machine algorithm",
    "clu_optics": "sequential single-machine algorithm", "dr_tsne": "single-machine embedding",
    "dr_umap": "single-machine embedding", "dr_autoencoder": "not implemented in the reference either",
}


def registry_rows():
    return [(i, k, n, t, f, d, k not in UNAVAILABLE, UNAVAILABLE.get(k, ""))
            for i, (k, n, t, f, d) in enumerate(CARDS)]


REGISTRY_SCHEMA = ("position int, key string, name string, task_type string, family string, optional_dep string, "
                   "available boolean, reason string")


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a small DataFrame (45 rows; broadcast-joined by the recommender)."""
    return spark.createDataFrame(registry_rows(), REGISTRY_SCHEMA)


def registry_sql() -> str:
    """The same table as a DuckDB VALUES list."""
    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, int):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"
    rows = ",\n  ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in registry_rows())
    return (f"(SELECT * FROM (VALUES\n  {rows}) AS r(position, key, name, task_type, family, optional_dep, "
            f"available, reason))")


def search(reg: DataFrame, task: str | None = None, text: str | None = None) -> DataFrame:
    """task filter + case-insensitive substring search over key/name/task/family, sorted by name."""
    out = reg
    if task:
        out = out.where(F.col("task_type") == task)
    if text:
        hay = F.lower(F.concat_ws(" ", "key", "name", "task_type", "family"))
        out = out.where(F.instr(hay, text.lower()) > 0)
    return out.orderBy(F.lower(F.col("name")), "key")


def estimator_factory(key: str, params: dict | None = None, features_col="features", label_col="label"):
    """Registry key -> an unfitted ``pyspark.ml`` estimator."""
    from tabsmith.operators.estimators import make_estimator
    if key in UNAVAILABLE:
        raise ValueError(f"{key} is not available: {UNAVAILABLE[key]}")
    return make_estimator(key, params or {}, features_col, label_col)
