"""Cross-validation of linear models from one pass.

The Gram statistics of every fold are summed in one pass over the rows.  Those of a training set are the total less
the fold's, and so is the fold's squared error of any coefficients: a whole grid of penalties and folds needs no
further pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tabsmith.operators.estimators import LinearScorer, gram_by_group


def _centred(g: dict) -> tuple:
    n = g["n"]
    mx, my = g["s"] / n, g["sy"] / n
    return g["G"] - n * np.outer(mx, mx), g["xy"] - n * mx * my, mx, my


def _ridge(g: dict, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise the squared error plus ``alpha`` times the squared coefficients."""
    square, xy, mx, my = _centred(g)
    coef = np.linalg.lstsq(square + alpha * np.eye(len(mx)), xy, rcond=None)[0]
    return coef, float(my - coef @ mx)


def _r2(g: dict, coef: np.ndarray, intercept: float) -> float:
    sse = g["syy"] - 2 * (coef @ g["xy"] + intercept * g["sy"]) + coef @ g["G"] @ coef + 2 * intercept * (coef @ g["s"]) + g["n"] * intercept ** 2
    total = g["syy"] - g["sy"] ** 2 / g["n"]
    return float(1 - sse / total) if total > 0 else float("nan")


def _less(a: dict, b: dict) -> dict:
    return {k: a[k] - b[k] for k in ("n", "s", "G", "xy", "sy", "syy")}


def ridge_cv(df: DataFrame, features: str, label: str, fold: str, alphas: list[float]) -> list[tuple[float, str, float]]:
    """(alpha, fold, R^2 on the fold's rows of the model fitted on the others)."""
    folds = _sums(df, features, label, fold)
    whole = _total(folds)
    return [(alpha, f, _r2(g, *_ridge(_less(whole, g), alpha))) for alpha in alphas for f, g in sorted(folds.items())]


def _sums(df: DataFrame, features: str, label: str, fold: str) -> dict:
    return gram_by_group(df, features, label, fold)


def _total(folds: dict) -> dict:
    return {k: sum(g[k] for g in folds.values()) for k in ("n", "s", "G", "xy", "sy", "syy")}


def ridge_search(df: DataFrame, features: str, label: str, fold: str, alphas: list[float]) -> tuple[float, float, LinearScorer]:
    """(best alpha, its mean R^2 over the folds, the model refitted on all rows); of equal ones the first."""
    folds = _sums(df, features, label, fold)
    whole = _total(folds)
    means = [float(np.mean([_r2(g, *_ridge(_less(whole, g), a)) for g in folds.values()])) for a in alphas]
    best = int(np.nanargmax(means))
    coef, intercept = _ridge(whole, alphas[best])
    return alphas[best], means[best], LinearScorer(coef, intercept, features)
