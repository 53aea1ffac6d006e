"""Spectral clustering by landmarks (A29, Nystroem extension).

The affinity exp(-gamma |x - y|^2) of all rows is approximated through m landmark points: C (rows x landmarks, made
in NumPy batches, never kept) and W (landmarks x landmarks) give C W^-1 C'.  Row sums come from one sum over all
rows, the leading eigenvectors from an m x m matrix that a second pass sums up; both sums are folded on Spark.
The extended, normalised vectors are clustered by k-means.  No affinity between rows is ever listed.

Landmarks are ``LANDMARKS`` distinct points in the order of a hash: a bounded sample that fits the model; every row
is labelled.  Rows with a missing feature count it as zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabsmith.functions.partials import collected, fold, matrix
from tabsmith.functions.storage import Stored

LANDMARKS = 400
ROWS = 4096
#: Least eigenvalue of W, against its greatest, that the inverse keeps.
RANK = 1e-8


def affinity(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(d, 0))


class Spectral(Estimator):
    def __init__(self, featuresCol="features", k=8, gamma=1.0, landmarks=LANDMARKS, seed=42):
        super().__init__()
        self.fc, self.k, self.gamma, self.landmarks, self.seed = featuresCol, k, gamma, landmarks, seed

    def _fit(self, df):
        x = F.transform(vector_to_array(F.col(self.fc)), lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v))
        rows = df.select(x.alias("x")).persist()
        order = [F.xxhash64(F.lit(self.seed), F.col("x")), F.col("x")]
        marks = rows.distinct().orderBy(*order).limit(self.landmarks).collect()          # a bounded sample
        marks = np.array([r["x"] for r in marks], float)
        if not len(marks):
            raise ValueError("no rows to fit")
        gamma = self.gamma
        values, vectors = np.linalg.eigh(affinity(marks, marks, gamma))
        keep = values > RANK * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])                                   # W^-1/2, narrow

        def sums(batches):
            out = np.zeros(root.shape[1])
            for x in _batches(batches):
                out += (affinity(x, marks, gamma) @ root).sum(0)
            yield 0, out

        total = collected(fold(rows, sums, parts=1))[0]

        def gram(batches):
            out = np.zeros((len(total), len(total)))
            for x in _batches(batches):
                z = _scaled(x, marks, gamma, root, total)
                out += z.T @ z
            yield 0, out.reshape(-1)

        square = collected(fold(rows, gram, parts=1))[0].reshape(len(total), -1)
        rows.unpersist()
        k = min(self.k, len(total))
        values, vectors = np.linalg.eigh(square)
        lead = vectors[:, ::-1][:, :k] / np.sqrt(np.maximum(values[::-1][:k], 1e-300))
        # the sign of an eigenvector is free: its greatest element is positive
        lead = lead * np.sign(lead[np.abs(lead).argmax(0), np.arange(k)])
        model = _SpectralModel(marks, gamma, root, total, lead, None, self.fc)
        model.kmeans = KMeans(featuresCol="_spectral", predictionCol="cluster", k=self.k, seed=self.seed).fit(model.embed(df))
        return model


def _batches(batches):
    for b in batches:
        x = matrix(b.column(0))
        for s in range(0, len(x), ROWS):
            yield x[s: s + ROWS]


def _scaled(x, marks, gamma, root, total) -> np.ndarray:
    """Rows of D^-1/2 C W^-1/2; a row without any affinity is zero."""
    z = affinity(x, marks, gamma) @ root
    degree = z @ total
    return z * np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1e-300)), 0)[:, None]


class _SpectralModel(Model, Stored):
    _fields = ("marks", "gamma", "root", "total", "lead", "kmeans", "fc")

    def __init__(self, marks, gamma, root, total, lead, kmeans, fc):
        super().__init__()
        self.marks, self.gamma, self.root, self.total, self.lead = (np.asarray(marks, float), gamma, np.asarray(root, float),
                                                                    np.asarray(total, float), np.asarray(lead, float))
        self.kmeans, self.fc = kmeans, fc

    def vectors(self, x: np.ndarray) -> np.ndarray:
        """Normalised spectral vectors, one per row."""
        v = _scaled(x, self.marks, self.gamma, self.root, self.total) @ self.lead
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return v / np.where(norm > 0, norm, 1)

    def embed(self, df):
        sent = df.sparkSession.sparkContext.broadcast((self.marks, self.gamma, self.root, self.total, self.lead))
        width = self.lead.shape[1]

        @F.arrow_udf("array<double>")
        def vectors(x: pa.Array) -> pa.Array:
            model = _SpectralModel(*sent.value, None, "")
            rows = np.nan_to_num(matrix(x), nan=0.0)
            out = [model.vectors(rows[s: s + ROWS]) for s in range(0, len(rows), ROWS)]
            flat = np.concatenate(out) if out else np.zeros((0, width))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(flat.reshape(-1)))

        return df.withColumn("_spectral", array_to_vector(vectors(vector_to_array(F.col(self.fc)))))

    def _transform(self, df):
        return self.kmeans.transform(self.embed(df)).drop("_spectral")
