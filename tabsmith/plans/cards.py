"""Typed hyper-parameter cards (A32) and the search spaces they give."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tabsmith.plans.registry import CARDS, UNAVAILABLE

# ---- fixed values (must equal the reference's cards): card, parameter, default, kind, least, greatest, step or choices
PARAMS_TEXT = """
reg_ridge alpha 1.0 float 1e-6 1e3 0.1
reg_lasso alpha 0.001 float 1e-6 10.0 0.001
reg_elasticnet alpha 0.001 float 1e-6 10.0 0.001
reg_elasticnet l1_ratio 0.5 float 0.0 1.0 0.05
reg_decision_tree max_depth None int 1 64 1
reg_decision_tree min_samples_split 2 int 2 50 1
reg_random_forest n_estimators 200 int 50 2000 50
reg_random_forest max_depth None int 1 64 1
reg_extra_trees n_estimators 500 int 50 3000 50
reg_gb n_estimators 300 int 50 5000 50
reg_gb learning_rate 0.05 float 0.001 1.0 0.01
reg_adaboost n_estimators 300 int 50 5000 50
reg_adaboost learning_rate 0.05 float 0.001 1.0 0.01
reg_xgboost n_estimators 500 int 50 5000 50
reg_xgboost learning_rate 0.05 float 0.001 1.0 0.01
reg_xgboost max_depth 6 int 1 20 1
reg_xgboost subsample 0.8 float 0.1 1.0 0.05
reg_lightgbm n_estimators 1000 int 50 10000 50
reg_lightgbm learning_rate 0.05 float 0.001 1.0 0.01
reg_lightgbm num_leaves 31 int 2 1024 1
reg_catboost iterations 2000 int 50 20000 50
reg_catboost learning_rate 0.05 float 0.001 1.0 0.01
reg_catboost depth 6 int 2 12 1
reg_catboost verbose False bool
reg_knn n_neighbors 5 int 1 200 1
reg_svr C 1.0 float 1e-3 1e3 0.1
reg_svr kernel rbf choice linear,rbf,poly,sigmoid
reg_mlp hidden_layer_sizes (128,64) str
reg_mlp alpha 0.0001 float 1e-6 1.0 1e-4
reg_mlp max_iter 500 int 50 5000 50
clf_logistic C 1.0 float 1e-3 1e3 0.1
clf_logistic max_iter 500 int 50 5000 50
clf_ridge alpha 1.0 float 1e-6 1e3 0.1
clf_decision_tree max_depth None int 1 64 1
clf_decision_tree min_samples_split 2 int 2 50 1
clf_random_forest n_estimators 300 int 50 3000 50
clf_random_forest max_depth None int 1 64 1
clf_extra_trees n_estimators 500 int 50 5000 50
clf_gb n_estimators 300 int 50 5000 50
clf_gb learning_rate 0.05 float 0.001 1.0 0.01
clf_adaboost n_estimators 400 int 50 5000 50
clf_adaboost learning_rate 0.05 float 0.001 1.0 0.01
clf_xgboost n_estimators 800 int 50 10000 50
clf_xgboost learning_rate 0.05 float 0.001 1.0 0.01
clf_xgboost max_depth 6 int 1 20 1
clf_xgboost subsample 0.8 float 0.1 1.0 0.05
clf_lightgbm n_estimators 1500 int 50 20000 50
clf_lightgbm learning_rate 0.05 float 0.001 1.0 0.01
clf_lightgbm num_leaves 31 int 2 1024 1
clf_catboost iterations 2500 int 50 50000 50
clf_catboost learning_rate 0.05 float 0.001 1.0 0.01
clf_catboost depth 6 int 2 12 1
clf_catboost verbose False bool
clf_knn n_neighbors 5 int 1 200 1
clf_svm C 1.0 float 1e-3 1e3 0.1
clf_svm kernel rbf choice linear,rbf,poly,sigmoid
clf_svm probability True bool
clf_mlp hidden_layer_sizes (128,64) str
clf_mlp alpha 0.0001 float 1e-6 1.0 1e-4
clf_mlp max_iter 500 int 50 5000 50
clu_kmeans n_clusters 8 int 2 200 1
clu_kmeans random_state 42 int
clu_minibatch_kmeans n_clusters 8 int 2 200 1
clu_minibatch_kmeans random_state 42 int
clu_kmedoids n_clusters 8 int 2 200 1
clu_kmedoids random_state 42 int
clu_agglomerative n_clusters 8 int 2 200 1
clu_agglomerative linkage ward choice ward,complete,average,single
clu_divisive n_clusters 8 int 2 200 1
clu_divisive random_state 42 int
clu_dbscan eps 0.5 float 0.01 10.0 0.01
clu_dbscan min_samples 5 int 1 100 1
clu_hdbscan min_cluster_size 5 int 2 500 1
clu_optics min_samples 5 int 1 100 1
clu_gmm n_components 8 int 2 200 1
clu_gmm random_state 42 int
clu_spectral n_clusters 8 int 2 200 1
clu_spectral random_state 42 int
dr_pca n_components 10 int 2 500 1
dr_pca random_state 42 int
dr_lda n_components 2 int 1 100 1
dr_tsne n_components 2 int 2 3 1
dr_tsne perplexity 30.0 float 5.0 100.0 1.0
dr_tsne random_state 42 int
dr_umap n_components 2 int 2 200 1
dr_umap n_neighbors 15 int 2 200 1
dr_umap min_dist 0.1 float 0.0 1.0 0.01
dr_umap random_state 42 int
dr_autoencoder latent_dim 16 int 2 512 1
"""
# most trials of a random and of a bounded search
RANDOM_TRIALS, BOUNDED_TRIALS = 25, 50


def _value(text: str, kind: str):
    if text == "None":
        return None
    if kind == "bool":
        return text == "True"
    if kind == "str":
        return tuple(int(x) for x in text.strip("()").split(","))
    return {"int": int, "float": float}.get(kind, str)(text)


def _parsed() -> list[dict]:
    out = []
    for line in PARAMS_TEXT.split("\n"):
        if not line:
            continue
        key, name, default, kind, *rest = line.split(" ")
        out.append({"key": key, "name": name, "default": _value(default, kind), "text": default, "kind": kind,
                    "least": float(rest[0]) if len(rest) == 3 else None, "greatest": float(rest[1]) if len(rest) == 3 else None,
                    "step": float(rest[2]) if len(rest) == 3 else None, "choices": rest[0].split(",") if kind == "choice" else None})
    return out


PARAMS = _parsed()


def params_of(key: str) -> list[dict]:
    return [p for p in PARAMS if p["key"] == key]


def defaults(key: str) -> dict:
    return {p["name"]: p["default"] for p in params_of(key)}


def params_table(spark: SparkSession) -> DataFrame:
    """One row per parameter, joined with its card."""
    cards = {k: (n, t, f) for k, n, t, f, _ in CARDS}
    rows = [(p["key"], *cards[p["key"]], p["key"] not in UNAVAILABLE, p["name"], p["text"], p["kind"], p["least"], p["greatest"], p["step"],
             None if p["choices"] is None else ",".join(p["choices"])) for p in PARAMS]
    return spark.createDataFrame(rows, "key string, card string, task_type string, family string, available boolean, name string, "
                                       "default_value string, kind string, least double, greatest double, step double, choices string")


def param_space(key: str) -> dict[str, list]:
    """Per bounded parameter the default, its half and its double, kept within the card's bounds; every choice.

    A parameter without a default starts from its least value.
    """
    space = {}
    for p in params_of(key):
        if p["kind"] == "choice":
            space[p["name"]] = list(p["choices"])
        elif p["kind"] in ("int", "float") and p["least"] is not None:
            number = int if p["kind"] == "int" else float
            lo, hi = number(p["least"]), number(p["greatest"])
            start = lo if p["default"] is None else number(p["default"])
            half = start // 2 if p["kind"] == "int" else start / 2
            space[p["name"]] = sorted({start, max(lo, half), min(hi, start * 2)})
    return space


def grid(key: str) -> list[dict]:
    """All combinations of the space; one empty one where a card has no bounded parameter."""
    space = param_space(key)
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


def random_trials(key: str, n_iter: int = RANDOM_TRIALS, seed: int = 42) -> list[dict]:
    """At most 25 different combinations of the grid, drawn without replacement."""
    every = grid(key)
    n = min(n_iter, RANDOM_TRIALS, len(every))
    return [every[i] for i in np.random.default_rng(seed).choice(len(every), n, replace=False)]


def bounded_trials(key: str, n_iter: int = BOUNDED_TRIALS, seed: int = 42) -> list[dict]:
    """At most 50 uniform draws between the least and the greatest value of each space; choices are drawn as they are."""
    rng = np.random.default_rng(seed)
    space, out = param_space(key), []
    for _ in range(min(n_iter, BOUNDED_TRIALS) if space else 0):
        draw = {}
        for name, values in space.items():
            if all(isinstance(v, int) for v in values):
                draw[name] = int(rng.integers(min(values), max(values) + 1))
            elif all(isinstance(v, (int, float)) for v in values):
                draw[name] = float(rng.uniform(min(values), max(values)))
            else:
                draw[name] = values[int(rng.integers(len(values)))]
        out.append(draw)
    return out


def space_rows() -> list[tuple]:
    """(key, name, position, value as text) of every card's space."""
    out = []
    for key, *_ in CARDS:
        for name, values in param_space(key).items():
            out += [(key, name, i, format(v, "g") if isinstance(v, float) else str(v)) for i, v in enumerate(values)]
    return out


def space_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(space_rows(), "key string, name string, position int, value string")
