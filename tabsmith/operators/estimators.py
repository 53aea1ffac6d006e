"""Estimators for the registry cards.

Native ``pyspark.ml`` estimators where Spark has the algorithm, with the
reference's defaults mapped onto Spark's parameterisation (ridge / elastic
net regularisation scaled by the label's standard deviation, logistic C ->
regParam = 1 / (C n), ...).  Algorithms Spark lacks are small estimators
whose heavy passes are Spark aggregates (Gram matrix, class scatter,
weighted trees) and whose driver state is p x p or k x p.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.partials import collected, dealt_out, fold, matrix
from tabsmith.functions.storage import Stored
from tabsmith.operators import boosting, cells, density, forest, neighbours, spectral

# trees "without limit": Spark ML grows no tree deeper than 30 levels, an engine limit
DEEP = 30


def _label_stats(df, label):
    r = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col(label).cast("double")).alias("s")).first()
    return int(r["n"]), float(r["s"] or 0.0)


def _least_rows(p: dict) -> int:
    """Rows of a leaf: a node below ``min_samples_split`` rows cannot give two leaves of half as many."""
    return max(1, int(p.get("min_samples_leaf") or 1), -(-int(p.get("min_samples_split") or 2) // 2))


class _Scaled(Estimator):
    """Defers a data-dependent regParam (needs n and sigma_y) to fit time."""

    def __init__(self, build):
        super().__init__()
        self._build = build

    def _fit(self, df):
        return self._build(df).fit(df)


#: Most rows of a task of gradient boosting, which keeps them as objects between the rounds.
GB_ROWS = 1_000_000


class _Dealt(Estimator):
    """Fits on rows dealt out, so that what one task keeps and reads does not grow with the table."""

    def __init__(self, estimator, columns):
        super().__init__()
        self._estimator, self._columns = estimator, columns

    def _fit(self, df):
        return self._estimator.fit(dealt_out(df.select(*self._columns), GB_ROWS, GB_ROWS))


class _Boosted(_Dealt):
    """Gradient boosting of a large table from its cells."""

    def __init__(self, estimator, columns, booster, task, seed):
        super().__init__(estimator, columns)
        self._booster, self._task, self._seed = booster, task, seed

    def _fit(self, df):
        return cells.boosted(df, self._booster, *self._columns, self._task, self._seed, GB_ROWS) or super()._fit(df)


def make_estimator(key: str, params: dict, features_col="features", label_col="label"):
    p = dict(params or {})
    fc, lc = features_col, label_col
    seed = int(p.get("random_state", 42))
    if key == "reg_linear":
        return LinearRegression(featuresCol=fc, labelCol=lc, regParam=0.0, solver="normal")
    if key == "reg_ridge":
        alpha = float(p.get("alpha", 1.0))

        def build(df):
            n, s = _label_stats(df, lc)
            return LinearRegression(featuresCol=fc, labelCol=lc, elasticNetParam=0.0, standardization=False,
                                    solver="normal", regParam=alpha * s / max(1, n) if s > 0 else alpha / max(1, n))
        return _Scaled(build)
    if key == "reg_lasso":
        return LinearRegression(featuresCol=fc, labelCol=lc, elasticNetParam=1.0, standardization=False,
                                regParam=float(p.get("alpha", 0.001)), maxIter=int(p.get("max_iter", 1000)))
    if key == "reg_elasticnet":
        alpha, l1 = float(p.get("alpha", 0.001)), float(p.get("l1_ratio", 0.5))

        def build(df):
            _, s = _label_stats(df, lc)
            a, b = alpha * l1, alpha * (1 - l1) * (s if s > 0 else 1.0)
            return LinearRegression(featuresCol=fc, labelCol=lc, standardization=False, regParam=a + b,
                                    elasticNetParam=a / (a + b) if a + b > 0 else 0.0, maxIter=1000)
        return _Scaled(build)
    if key == "reg_bayesianridge":
        return BayesianRidge(featuresCol=fc, labelCol=lc)
    if key == "reg_decision_tree":
        depth, least = int(p.get("max_depth") or DEEP), _least_rows(p)
        tree = DecisionTreeRegressor(featuresCol=fc, labelCol=lc, maxDepth=depth, minInstancesPerNode=least, seed=seed)
        return cells.Tree(tree, fc, lc, "regression", depth, least, seed)
    if key == "reg_random_forest":
        return RandomForestRegressor(featuresCol=fc, labelCol=lc, numTrees=int(p.get("n_estimators", 200)),
                                     maxDepth=int(p.get("max_depth") or DEEP), seed=seed)
    if key == "reg_gb":
        gbt = GBTRegressor(featuresCol=fc, labelCol=lc, maxIter=int(p.get("n_estimators", 300)),
                           stepSize=float(p.get("learning_rate", 0.05)), maxDepth=int(p.get("max_depth", 3)),
                           seed=seed)
        return _Boosted(gbt, [fc, lc], gbt, "regression", seed)
    if key == "reg_adaboost":
        return boosting.AdaBoostRegressor(fc, lc, int(p.get("n_estimators", 300)), float(p.get("learning_rate", 0.05)))
    if key == "reg_extra_trees":
        return forest.ExtraTrees(fc, lc, "regression", int(p.get("n_estimators", 500)), p.get("max_depth"), p.get("min_samples_leaf"), seed)
    if key in ("reg_knn", "clf_knn"):
        return neighbours.KNearest(fc, lc, int(p.get("n_neighbors", 5)), "regression" if key == "reg_knn" else "classification")
    if key == "clf_logistic":
        C = float(p.get("C", 1.0))

        def build(df):
            n, _ = _label_stats(df, lc)
            return LogisticRegression(featuresCol=fc, labelCol=lc, regParam=1.0 / (C * max(1, n)),
                                      standardization=False, maxIter=int(p.get("max_iter", 500)))
        return _Scaled(build)
    if key == "clf_ridge":
        return RidgeClassifier(featuresCol=fc, labelCol=lc, alpha=float(p.get("alpha", 1.0)))
    if key == "clf_decision_tree":
        depth, least = int(p.get("max_depth") or DEEP), _least_rows(p)
        tree = DecisionTreeClassifier(featuresCol=fc, labelCol=lc, maxDepth=depth, minInstancesPerNode=least, seed=seed)
        return cells.Tree(tree, fc, lc, "classification", depth, least, seed)
    if key == "clf_random_forest":
        return RandomForestClassifier(featuresCol=fc, labelCol=lc, numTrees=int(p.get("n_estimators", 300)),
                                      maxDepth=int(p.get("max_depth") or DEEP), seed=seed)
    if key == "clf_gb":
        gbt = GBTClassifier(featuresCol=fc, labelCol=lc, maxIter=int(p.get("n_estimators", 300)),
                            stepSize=float(p.get("learning_rate", 0.05)), maxDepth=int(p.get("max_depth", 3)),
                            seed=seed)
        return _Boosted(_BinaryOrOvr(gbt, fc, lc), [fc, lc], gbt, "classification", seed)
    if key == "clf_adaboost":
        return boosting.AdaBoostClassifier(fc, lc, int(p.get("n_estimators", 400)), float(p.get("learning_rate", 0.05)))
    if key == "clf_extra_trees":
        return forest.ExtraTrees(fc, lc, "classification", int(p.get("n_estimators", 500)), p.get("max_depth"), p.get("min_samples_leaf"), seed)
    if key == "clf_svm":
        svc = LinearSVC(featuresCol=fc, labelCol=lc, regParam=0.0 if not p.get("C") else 1.0 / float(p["C"]),
                        maxIter=100)
        return _BinaryOrOvr(svc, fc, lc, calibrate=True)
    if key == "clf_naive_bayes":
        return NaiveBayes(featuresCol=fc, labelCol=lc, modelType="gaussian")
    if key == "clf_mlp":
        hidden = list(p.get("hidden_layer_sizes", (128, 64)))
        return _MLP(fc, lc, hidden, int(p.get("max_iter", 500)), seed)
    if key == "clu_kmeans":
        return KMeans(featuresCol=fc, k=int(p.get("n_clusters", 8)), seed=seed, predictionCol="cluster")
    if key == "clu_minibatch_kmeans":
        return MiniBatchKMeans(featuresCol=fc, k=int(p.get("n_clusters", 8)), seed=seed,
                               batch_size=int(p.get("batch_size", 1024)), max_iter=int(p.get("max_iter", 100)))
    if key == "clu_kmedoids":
        return KMedoids(featuresCol=fc, k=int(p.get("n_clusters", 8)), seed=seed)
    if key == "clu_divisive":
        return BisectingKMeans(featuresCol=fc, k=int(p.get("n_clusters", 8)), seed=seed, predictionCol="cluster")
    if key == "clu_dbscan":
        return density.DBSCAN(fc, float(p.get("eps", 0.5)), int(p.get("min_samples", 5)))
    if key == "clu_spectral":
        return spectral.Spectral(fc, int(p.get("n_clusters", 8)), float(p.get("gamma", 1.0)), seed=seed)
    if key == "clu_gmm":
        return GaussianMixture(featuresCol=fc, k=int(p.get("n_components", 8)), seed=seed, predictionCol="cluster")
    if key == "dr_pca":
        return CenteredPCA(featuresCol=fc, k=int(p.get("n_components", 10)))
    if key == "dr_lda":
        return LDAProjection(featuresCol=fc, labelCol=lc, k=int(p.get("n_components", 2)))
    raise ValueError(f"no Spark estimator for {key}")


# ------------------------------------------------------------------ wrappers

class _BinaryOrOvr(Estimator):
    """Binary-only Spark classifiers (GBT, LinearSVC) -> OneVsRest when labels are not {0, 1}."""

    def __init__(self, base, fc, lc, calibrate=False):
        super().__init__()
        self.base, self.fc, self.lc, self.calibrate = base, fc, lc, calibrate

    def _fit(self, df):
        k = df.agg(F.max(self.lc)).first()[0]
        if k is not None and k <= 1:
            m = self.base.fit(df)
            return _Platt.fit_on(m, df, self.lc) if self.calibrate else m
        if not self.calibrate:
            return OneVsRest(classifier=self.base, featuresCol=self.fc, labelCol=self.lc).fit(df)
        # one calibrated margin per class
        models = []
        for cls in range(int(k) + 1):
            one = df.withColumn(self.lc, (F.col(self.lc) == cls).cast("double"))
            models.append(_Platt.fit_on(self.base.fit(one), one, self.lc))
        return _PlattRest(models, self.fc)


class _Platt(Model, Stored):
    """A20 probability: a 1-D logistic regression on the SVM margin (Platt scaling)."""

    _fields = ("svm", "a", "b")

    def __init__(self, svm, a, b):
        super().__init__()
        self.svm, self.a, self.b = svm, float(a), float(b)

    @classmethod
    def fit_on(cls, svm, df, label):
        from pyspark.ml.feature import VectorAssembler as _VA
        scored = svm.transform(df).select(vector_to_array("rawPrediction")[1].alias("__m"), F.col(label).alias("__y"))
        lr = LogisticRegression(featuresCol="__mv", labelCol="__y", regParam=0.0).fit(
            _VA(inputCols=["__m"], outputCol="__mv").transform(scored))
        return cls(svm, lr.coefficients[0], lr.intercept)

    def _transform(self, df):
        out = self.svm.transform(df)
        z = vector_to_array("rawPrediction")[1] * F.lit(self.a) + F.lit(self.b)
        p1 = 1.0 / (1.0 + F.exp(-z))
        return out.withColumn("probability", array_to_vector(F.array(1 - p1, p1)))


class _PlattRest(Model, Stored):
    """A20 with more than two classes: every class against the rest, calibrated, the probabilities scaled to one."""

    _fields = ("models", "fc")

    def __init__(self, models, fc):
        super().__init__()
        self.models, self.fc = models, fc

    def _transform(self, df):
        out = df
        for i, m in enumerate(self.models):
            svm = m.svm.copy().setPredictionCol("__p").setRawPredictionCol("__raw")
            z = vector_to_array("__raw")[1] * F.lit(m.a) + F.lit(m.b)
            out = svm.transform(out).withColumn(f"__s{i}", 1.0 / (1.0 + F.exp(-z))).drop("__p", "__raw")
        shares = F.array(*[F.col(f"__s{i}") for i in range(len(self.models))])
        total = F.greatest(F.aggregate(shares, F.lit(0.0), lambda a, v: a + v), F.lit(1e-300))
        out = out.withColumn("probability", array_to_vector(F.transform(shares, lambda v: v / total)))
        best = (F.array_position(shares, F.array_max(shares)) - 1).cast("double")
        return out.withColumn("prediction", best).drop(*[f"__s{i}" for i in range(len(self.models))])


class _MLP(Estimator):
    def __init__(self, fc, lc, hidden, max_iter, seed):
        super().__init__()
        self.fc, self.lc, self.hidden, self.max_iter, self.seed = fc, lc, hidden, max_iter, seed

    def _fit(self, df):
        r = df.select(F.size(vector_to_array(self.fc)).alias("p"), F.col(self.lc)).agg(
            F.first("p").alias("p"), F.max(self.lc).alias("k")).first()
        layers = [int(r["p"]), *self.hidden, int(r["k"]) + 1]
        return MultilayerPerceptronClassifier(featuresCol=self.fc, labelCol=self.lc, layers=layers,
                                              maxIter=self.max_iter, seed=self.seed).fit(df)


# ------------------------------------------------------------------ Gram-matrix based

#: Columns of one block of a Gram matrix.
BLOCK = 128


def gram_by_group(df: DataFrame, fc: str, label: str | None = None, group: str | None = None) -> dict:
    """Per group: n, column sums, X'X (and X'y, sum y, sum y^2) -> NumPy.

    Each task multiplies its rows with NumPy and emits its matrices in blocks of ``BLOCK`` columns; the
    blocks are summed on Spark (``functions.partials``), so the driver gets p^2 numbers per group once, whatever
    the number of rows or tasks.  ``group`` is a class label: its distinct values are listed first.
    """
    cols = [vector_to_array(F.col(fc)).alias("x"), F.col(label).cast("double").alias("y") if label else F.lit(0.0).alias("y"),
            F.col(group).cast("string").alias("g") if group else F.lit("").alias("g")]
    d = df.select(*cols).filter("x is not null and g is not null")
    head = d.agg(F.max(F.size("x")).alias("p"), F.collect_set("g").alias("g")).first()          # class labels
    number = {g: i for i, g in enumerate(sorted(head["g"]))}
    p = head["p"] or 0
    edges = list(range(0, p, BLOCK))
    per = len(edges) ** 2 + 1                              # blocks of a group; the last holds sums and X'y

    def part(batches):
        acc = {}
        for b in batches:
            x, y = matrix(b.column(0)), b.column(1).to_numpy()
            texts = b.column(2).dictionary_encode()
            code = np.array([number[g] for g in texts.dictionary.to_pylist()], int)[texts.indices.to_numpy()]
            for g in np.unique(code):
                xs, ys = x[code == g], y[code == g]
                a = acc.setdefault(int(g), [np.zeros((p, p)), np.zeros(2 * p + 3)])
                a[0] += xs.T @ xs
                a[1] += np.concatenate([xs.sum(0), xs.T @ ys, [len(xs), ys.sum(), ys @ ys]])
        for g, (square, sums) in acc.items():
            for i, r in enumerate(edges):
                for j, c in enumerate(edges):
                    yield g * per + i * len(edges) + j, square[r: r + BLOCK, c: c + BLOCK].reshape(-1)
            yield g * per + per - 1, sums

    got = collected(fold(d, part))
    out = {}
    for name, g in number.items():
        if g * per + per - 1 not in got:
            continue
        sums, square = got[g * per + per - 1], np.zeros((p, p))
        for i, r in enumerate(edges):
            for j, c in enumerate(edges):
                cell = square[r: r + BLOCK, c: c + BLOCK]
                cell[:] = got[g * per + i * len(edges) + j].reshape(cell.shape)
        out[name] = {"n": int(sums[2 * p]), "s": sums[:p].copy(), "G": square, "xy": sums[p: 2 * p].copy(),
                     "sy": float(sums[2 * p + 1]), "syy": float(sums[2 * p + 2]), "p": p}
    return out


def gram(df: DataFrame, fc: str, label: str | None = None) -> dict:
    """Whole-table Gram statistics (see :func:`gram_by_group`)."""
    return gram_by_group(df, fc, label, None)[""]


class LinearScorer(Model, Stored):
    """prediction = intercept + coef . features (vector expression, no UDF)."""

    _fields = ("coef", "intercept", "fc", "out")

    def __init__(self, coef, intercept, fc, out="prediction"):
        super().__init__()
        self.coef, self.intercept, self.fc, self.out = np.asarray(coef, float), float(intercept), fc, out

    def _transform(self, df):
        arr = vector_to_array(F.col(self.fc))
        e = F.lit(self.intercept)
        for i, w in enumerate(self.coef):
            e = e + arr[i] * F.lit(float(w))
        return df.withColumn(self.out, e)


class BayesianRidge(Estimator):
    """A5: evidence-maximising Bayesian ridge (MacKay fixed point, as in sklearn) from the centred Gram matrix."""

    def __init__(self, featuresCol="features", labelCol="label", max_iter=300, tol=1e-3):
        super().__init__()
        self.fc, self.lc, self.max_iter, self.tol = featuresCol, labelCol, max_iter, tol

    def _fit(self, df):
        g = gram(df, self.fc, self.lc)
        n = g["n"]
        mx, my = g["s"] / n, g["sy"] / n
        XtX = g["G"] - n * np.outer(mx, mx)
        Xty = g["xy"] - n * mx * my
        yty = g["syy"] - n * my * my
        eig = np.linalg.eigvalsh(XtX)
        eig = np.clip(eig, 0, None)
        alpha, lam = 1.0 / (yty / n + 1e-12), 1.0
        coef = np.zeros(g["p"])
        for _ in range(self.max_iter):
            A = XtX * alpha + lam * np.eye(g["p"])
            new = alpha * np.linalg.solve(A, Xty)
            gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
            rss = float(yty - 2 * new @ Xty + new @ XtX @ new)
            lam = (gamma + 2e-6) / (float(new @ new) + 2e-6)
            alpha = (n - gamma + 2e-6) / (rss + 2e-6)
            if np.sum(np.abs(new - coef)) < self.tol:
                coef = new
                break
            coef = new
        return LinearScorer(coef, my - coef @ mx, self.fc)


class RidgeClassifier(Estimator):
    """Ridge regression on +-1 targets per class, argmax of the scores (one Gram pass per fit)."""

    def __init__(self, featuresCol="features", labelCol="label", alpha=1.0):
        super().__init__()
        self.fc, self.lc, self.alpha = featuresCol, labelCol, alpha

    def _fit(self, df):
        per = gram_by_group(df, self.fc, None, self.lc)        # one entry per class
        classes = sorted(per, key=float)
        p = next(iter(per.values()))["p"]
        n = sum(v["n"] for v in per.values())
        S = sum(v["s"] for v in per.values())
        G = sum(v["G"] for v in per.values())
        mx = S / n
        XtX = G - n * np.outer(mx, mx) + self.alpha * np.eye(p)
        W, b = [], []
        for cls in classes:
            # y = +1 for the class, -1 otherwise: sum x*y = 2 * s_k - s
            sk, nk = per[cls]["s"], per[cls]["n"]
            my = (2 * nk - n) / n
            xy = 2 * sk - S - n * mx * my
            w = np.linalg.solve(XtX, xy)
            W.append(w)
            b.append(my - w @ mx)
        return ArgmaxLinear(np.array(W), np.array(b), [float(c_) for c_ in classes], self.fc)


class ArgmaxLinear(Model, Stored):
    _fields = ("W", "b", "classes", "fc")

    def __init__(self, W, b, classes, fc):
        super().__init__()
        self.W, self.b, self.classes, self.fc = W, b, classes, fc

    def _transform(self, df):
        arr = vector_to_array(F.col(self.fc))
        scores = []
        for k in range(len(self.classes)):
            e = F.lit(float(self.b[k]))
            for i, w in enumerate(self.W[k]):
                e = e + arr[i] * F.lit(float(w))
            scores.append(e)
        best = F.array_position(F.array(*scores), F.array_max(F.array(*scores)))
        cl = F.array(*[F.lit(float(c_)) for c_ in self.classes])
        return df.withColumn("prediction", F.element_at(cl, best.cast("int")))


class CenteredPCA(Estimator):
    """Centre, then Spark PCA (Spark's PCA.transform does not centre)."""

    def __init__(self, featuresCol="features", k=10):
        super().__init__()
        self.fc, self.k = featuresCol, k

    def _fit(self, df):
        sc = StandardScaler(inputCol=self.fc, outputCol="__centered", withMean=True, withStd=False).fit(df)
        p = df.select(F.size(vector_to_array(self.fc))).first()[0]
        k = min(self.k, p)
        pca = PCA(inputCol="__centered", outputCol="pca", k=k).fit(sc.transform(df))
        return _PCAModel(sc, pca)


class _PCAModel(Model, Stored):
    _fields = ("sc", "pca")

    def __init__(self, sc, pca):
        super().__init__()
        self.sc, self.pca = sc, pca

    @property
    def explainedVariance(self):
        return self.pca.explainedVariance

    @property
    def components(self):
        return self.pca.pc.toArray()

    def _transform(self, df):
        return self.pca.transform(self.sc.transform(df)).drop("__centered")


class LDAProjection(Estimator):
    """Fisher discriminant projection from class means and the within-class scatter."""

    def __init__(self, featuresCol="features", labelCol="label", k=2):
        super().__init__()
        self.fc, self.lc, self.k = featuresCol, labelCol, k

    def _fit(self, df):
        per = gram_by_group(df, self.fc, None, self.lc)         # one entry per class
        p = next(iter(per.values()))["p"]
        n = sum(v["n"] for v in per.values())
        mu = sum(v["s"] for v in per.values()) / n
        Sw, Sb = np.zeros((p, p)), np.zeros((p, p))
        for v in per.values():
            nk = v["n"]
            mk = v["s"] / nk
            Sw += v["G"] - nk * np.outer(mk, mk)
            Sb += nk * np.outer(mk - mu, mk - mu)
        vals, vecs = np.linalg.eig(np.linalg.pinv(Sw) @ Sb)
        order = np.argsort(-vals.real)
        k = min(self.k, max(1, len(per) - 1), p)
        return _Projection(vecs.real[:, order[:k]], mu, self.fc)


class _Projection(Model, Stored):
    _fields = ("W", "mu", "fc")

    def __init__(self, W, mu, fc):
        super().__init__()
        self.W, self.mu, self.fc = W, mu, fc

    def _transform(self, df):
        arr = vector_to_array(F.col(self.fc))
        comps = []
        for j in range(self.W.shape[1]):
            e = F.lit(0.0)
            for i in range(self.W.shape[0]):
                e = e + (arr[i] - F.lit(float(self.mu[i]))) * F.lit(float(self.W[i, j]))
            comps.append(e)
        return df.withColumn("projection", array_to_vector(F.array(*comps)))


# ------------------------------------------------------------------ mini-batch k-means

class MiniBatchKMeans(Estimator):
    """A24 (Sculley 2010): hash-chosen batches, per-centre batch means, count-decayed centre updates."""

    def __init__(self, featuresCol="features", k=8, batch_size=1024, max_iter=100, seed=42):
        super().__init__()
        self.fc, self.k, self.b, self.iters, self.seed = featuresCol, k, batch_size, max_iter, seed

    def _fit(self, df):
        arr = vector_to_array(F.col(self.fc))
        n = df.count()
        p = df.select(F.size(arr)).first()[0]
        # distinct points with counts: equal points neither fill the first centres nor share one batch
        points = df.groupBy(arr.alias("__a")).agg(F.count(F.lit(1)).alias("__n"))
        h = F.xxhash64(F.lit(self.seed), F.to_json(F.col("__a")))
        init = points.orderBy(h, F.to_json(F.col("__a"))).limit(self.k).select("__a").collect()   # k rows
        C = np.array([r["__a"] for r in init], float)
        counts = np.zeros(len(C))
        frac = min(1.0, self.b / max(1, n))
        buckets = max(1, int(round(1 / frac)))
        keyed = points.withColumn("__b", F.pmod(h, F.lit(buckets))).persist()
        for it in range(self.iters):
            # a point's copies are dealt evenly to the batches, the odd ones from its own batch on
            turn = F.pmod(F.lit(it % buckets) - F.col("__b"), F.lit(buckets))
            share = F.floor(F.col("__n") / buckets) + (turn < F.col("__n") % buckets).cast("int")
            batch = keyed.withColumn("__m", share).where("__m > 0")
            assign = _nearest(C)
            stats = batch.select(assign("__a").alias("__c"), "__a", "__m").groupBy("__c").agg(
                F.sum("__m").alias("m"), *[F.sum(F.col("__a")[i] * F.col("__m")).alias(f"s{i}") for i in range(p)]).collect()
            for r in stats:
                j = r["__c"]
                counts[j] += r["m"]
                eta = r["m"] / counts[j]
                C[j] = (1 - eta) * C[j] + eta * np.array([r[f"s{i}"] for i in range(p)]) / r["m"]
        keyed.unpersist()
        return _CentroidModel(C, self.fc)


def _nearest(C):
    def f(colname):
        a = F.col(colname)
        d = [sum(((a[i] - F.lit(float(c_[i]))) ** 2 for i in range(len(c_))), F.lit(0.0)) for c_ in C]
        return (F.array_position(F.array(*d), F.array_min(F.array(*d))) - 1).cast("int")
    return f


class _CentroidModel(Model, Stored):
    _fields = ("C", "fc")

    def __init__(self, C, fc):
        super().__init__()
        self.C, self.fc = C, fc

    def clusterCenters(self):
        return list(self.C)

    def _transform(self, df):
        return df.withColumn("__a", vector_to_array(F.col(self.fc))) \
            .withColumn("cluster", _nearest(self.C)("__a")).drop("__a")


# ------------------------------------------------------------------ RFE (K7)

#: Rows from which, and share of them up to which, the distinct rows of a table are worth fitting on with their counts.
RFE_ROWS, RFE_SHARE = 100_000, 0.25


def rfe_ranking(df: DataFrame, feats, target, k: int, task: str) -> DataFrame:
    """K7: drop the feature with the smallest |coef| (L2 over classes) until k remain.

    A fit sees equal rows as one row that weighs their count, as soon as the features kept make them few.
    """
    from pyspark import StorageLevel
    from pyspark.ml.feature import VectorAssembler
    spark = df.sparkSession
    # on disk: a pass per fit reads it, and the memory is for the blocks that the fit's iterations read
    base = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in feats],
                     F.col(target).cast("double").alias("__y")).persist(StorageLevel.DISK_ONLY)
    keep = list(feats)
    k = min(max(1, k), len(feats))
    dropped, weight = [], {}
    n = base.count() if k < len(keep) else 0
    while len(keep) > k:
        if n >= RFE_ROWS:
            distinct = base.agg(F.approx_count_distinct(F.xxhash64(*keep, "__y"))).first()[0]
            if distinct <= n * RFE_SHARE:
                counted = F.sum("__n") if weight else F.count(F.lit(1)).cast("double")
                cells = base.groupBy(*keep, "__y").agg(counted.alias("__n")).persist(StorageLevel.DISK_ONLY)
                n, weight = cells.count(), {"weightCol": "__n"}
                base.unpersist()
                base = cells
        va = VectorAssembler(inputCols=keep, outputCol="__f")
        # few distinct rows in few tasks: hundreds of iterations start them
        d = va.transform(base.coalesce(1 + n // RFE_ROWS) if weight else base)
        if task == "regression":
            coef = np.abs(LinearRegression(featuresCol="__f", labelCol="__y", regParam=0.0, **weight).fit(d).coefficients.toArray())
        else:
            m = LogisticRegression(featuresCol="__f", labelCol="__y", maxIter=500, **weight).fit(d)
            coef = np.sqrt((m.coefficientMatrix.toArray() ** 2).sum(axis=0))
        j = int(np.argmin(coef))
        dropped.append(keep.pop(j))
    base.unpersist()
    rows = [(i, f, None, f in keep) for i, f in enumerate(feats)]
    return spark.createDataFrame(rows, "position int, feature string, score double, selected boolean")


# ------------------------------------------------------------------ k-medoids (A25, CLARA)

def _pam(P: np.ndarray, k: int, weight: np.ndarray | None = None, max_iter: int = 100) -> np.ndarray:
    """PAM (BUILD + SWAP) on a small set of weighted points; returns medoid indices."""
    D = np.sqrt(((P[:, None, :] - P[None, :, :]) ** 2).sum(-1))
    if weight is not None:
        D = D * weight[:, None]
    med = [int(np.argmin(D.sum(axis=1)))]
    while len(med) < min(k, len(P)):
        dmin = D[:, med].min(axis=1)
        gain = np.maximum(dmin[:, None] - D, 0).sum(axis=0)
        gain[med] = -1
        med.append(int(np.argmax(gain)))
    cost = D[:, med].min(axis=1).sum()
    for _ in range(max_iter):
        improved = False
        for i in range(len(med)):
            for h in range(len(P)):
                if h in med:
                    continue
                trial = med[:i] + [h] + med[i + 1:]
                c_ = D[:, trial].min(axis=1).sum()
                if c_ < cost - 1e-12:
                    med, cost, improved = trial, c_, True
        if not improved:
            break
    return np.array(med)


class KMedoids(Estimator):
    """A25 via CLARA (Kaufman & Rousseeuw): PAM on ``n_samples`` hash-chosen samples of ``sample_size``
    distinct points, weighted by their copies (default 40 + 2k, the authors' figure); each
    candidate medoid set is scored on the full table by one Spark aggregate (sum of distances to
    the nearest medoid); the cheapest set wins."""

    def __init__(self, featuresCol="features", k=8, n_samples=5, sample_size=None, seed=42):
        super().__init__()
        self.fc, self.k, self.ns, self.size, self.seed = featuresCol, k, n_samples, sample_size, seed

    def _fit(self, df):
        arr = vector_to_array(F.col(self.fc))
        size = self.size or 40 + 2 * self.k
        base = df.groupBy(arr.alias("__a")).agg(F.count(F.lit(1)).alias("__n")).persist()
        best, best_cost = None, None
        for s in range(self.ns):
            pts = base.orderBy(F.xxhash64(F.lit(self.seed), F.lit(s), F.to_json("__a"))).limit(size).collect()
            P = np.array([r["__a"] for r in pts], float)              # sample-sized, on the driver
            M = P[_pam(P, self.k, np.array([r["__n"] for r in pts], float))]
            dist = [F.sqrt(sum(((F.col("__a")[i] - F.lit(float(m[i]))) ** 2 for i in range(len(m))), F.lit(0.0)))
                    for m in M]
            cost = base.agg(F.sum(F.array_min(F.array(*dist)) * F.col("__n"))).first()[0]
            if best_cost is None or cost < best_cost:
                best, best_cost = M, cost
        base.unpersist()
        return _CentroidModel(best, self.fc)
