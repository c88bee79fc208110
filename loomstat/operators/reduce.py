"""Reduction of features: components, sparse components, embeddings.

Input: (sample_id, features array<double>) and any other columns. Linear methods need the p x p Gramian only,
which is a distributed sum over samples of outer products per task; transforms are native or Arrow per row.
Embeddings of samples need all distances and run on the driver behind a check of the number of samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features whose Gramian may be held (p x p doubles), and samples that may be embedded.
MOST_FEATURES, MOST_EMBEDDED = 10_000, 20_000


def gramian(arrays: DataFrame, column: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Number of samples, mean and centered cross products. Each task sends blocks of a p x p matrix, by row;
    tasks' matrices are summed per row in parallel, not on the driver."""
    p = arrays.agg(F.max(F.size(column))).first()[0] or 0
    if p > MOST_FEATURES:
        raise ValueError(f"{p} features; a cross product of more than {MOST_FEATURES} is out of reach")
    sums = arrays.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.count("x").alias("n")).orderBy("i").toPandas()
    if not len(sums):
        return 0, np.zeros(0), np.zeros((0, 0))
    mean = sums["m"].to_numpy(float)
    n = int(sums["n"].max())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].tolist()) - mean
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(p), "row": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "row": [np.sum(np.stack(pdf["row"].tolist()), axis=0)]})

    rows = arrays.select(F.col(column).alias("x")).mapInPandas(run, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>")
    got = rows.toPandas().sort_values("i")
    return n, mean, np.stack(got["row"].tolist())


def _projected(df: DataFrame, shift: np.ndarray, matrix: np.ndarray, offset: np.ndarray, column: str, to: str) -> DataFrame:
    """(x - shift) @ matrix + offset of an array column, batch by batch."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(x.tolist()) - shift) @ matrix + offset)) if len(x) else pd.Series([], dtype=object)

    return df.withColumn(to, run(F.col(column)))


class Reducer:
    """fit, transform, names out; ``inverse_transform`` where a method has one."""

    prefix = "component"

    def fit_transform(self, arrays: DataFrame) -> DataFrame:
        return self.fit(arrays).transform(arrays)

    def feature_names_out(self) -> list[str]:
        return [f"{self.prefix}_{i}" for i in range(self.n_components_)]

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no inverse")


class PCA(Reducer):
    """Principal components; ``n`` may be a number, None for all, or a share of the variance below 1."""

    def __init__(self, n: int | float | None = None, whiten: bool = False):
        self.n, self.whiten = n, whiten

    def fit(self, arrays: DataFrame) -> PCA:
        rows, self.mean_, g = gramian(arrays)
        if rows < 2:
            raise ValueError("at least two samples are needed")
        values, vectors = np.linalg.eigh(g / (rows - 1))
        order = np.argsort(-values)
        values, vectors = np.maximum(values[order], 0), vectors[:, order]
        # The largest loading of each component is positive, so signs don't depend on the solver.
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        ratio = values / values.sum() if values.sum() > 0 else values
        most = min(rows, len(values))
        if self.n is None:
            m = most
        elif 0 < self.n < 1:
            m = int(np.searchsorted(np.cumsum(ratio), self.n - 1e-12) + 1)
        else:
            m = int(self.n)
            if not 1 <= m <= most:
                raise ValueError(f"between 1 and {most} components are possible")
        self.explained_variance_, self.explained_ratio_, self.components_, self.n_components_ = values[:m], ratio[:m], vectors[:, :m], m
        return self

    def transform(self, df: DataFrame, column: str = "features", to: str = "components") -> DataFrame:
        scale = np.sqrt(np.maximum(self.explained_variance_, 1e-300)) if self.whiten else 1.0
        return _projected(df, self.mean_, self.components_ / scale, np.zeros(self.n_components_), column, to)

    def inverse_transform(self, df: DataFrame, column: str = "components", to: str = "features") -> DataFrame:
        scale = np.sqrt(self.explained_variance_) if self.whiten else np.ones(self.n_components_)
        return _projected(df, np.zeros(self.n_components_), (self.components_ * scale).T, self.mean_, column, to)

    def importances(self, names: list[str]) -> pd.DataFrame:
        out = pd.DataFrame(self.components_, index=names, columns=self.feature_names_out())
        return out.assign(importance=np.abs(self.components_).max(1))


class SparsePCA(Reducer):
    """Components with few loadings: a dictionary with an L1 penalty, found on the Gramian; ridge projection."""

    def __init__(self, n: int = 2, alpha: float = 1.0, ridge: float = 0.01, max_iter: int = 200, tol: float = 1e-8):
        self.n, self.alpha, self.ridge, self.max_iter, self.tol = n, alpha, ridge, max_iter, tol

    def fit(self, arrays: DataFrame) -> SparsePCA:
        rows, self.mean_, g = gramian(arrays)
        values, vectors = np.linalg.eigh(g)
        start = vectors[:, np.argsort(-values)[: self.n]].T
        load, sparse = start, start * np.sqrt(np.maximum(np.sort(values)[::-1][: self.n], 0))[:, None]
        before = np.inf
        for _ in range(self.max_iter):
            # Codes u = x w with orthonormal columns; sparse loadings soft-threshold u' x.
            w = np.linalg.pinv(_root(load @ g @ load.T)) @ load
            cross = w @ g
            sparse = np.sign(cross) * np.maximum(np.abs(cross) - self.alpha, 0)
            loss = 0.5 * (np.trace(g) - 2 * (cross * sparse).sum() + (sparse**2).sum()) + self.alpha * np.abs(sparse).sum()
            if not sparse.any() or before - loss < self.tol * max(1.0, abs(loss)):
                break
            before, load = loss, sparse
        norm = np.linalg.norm(sparse, axis=1, keepdims=True)
        self.components_ = sparse / np.where(norm > 0, norm, 1.0)
        self.n_components_ = self.n
        return self

    def _projection(self) -> np.ndarray:
        c = self.components_
        return np.linalg.solve(c @ c.T + self.ridge * np.eye(len(c)), c).T

    def transform(self, df: DataFrame, column: str = "features", to: str = "components") -> DataFrame:
        return _projected(df, self.mean_, self._projection(), np.zeros(self.n_components_), column, to)

    def inverse_transform(self, df: DataFrame, column: str = "components", to: str = "features") -> DataFrame:
        return _projected(df, np.zeros(self.n_components_), self.components_, self.mean_, column, to)

    def importances(self, names: list[str]) -> pd.DataFrame:
        return pd.DataFrame(self.components_.T, index=names, columns=self.feature_names_out()).assign(importance=np.abs(self.components_).max(0))


def _root(a: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    return vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T


class Embedding(Reducer):
    """Methods that place all samples together; subclasses give ``embed(x, distances)``."""

    prefix = "embedding"

    def __init__(self, n: int = 2, neighbours: int = 10, seed: int = 42):
        self.n, self.neighbours, self.seed = n, neighbours, seed

    def fit(self, arrays: DataFrame) -> Embedding:
        rows = arrays.count()
        if rows > MOST_EMBEDDED:
            raise ValueError(f"{rows} samples; more than {MOST_EMBEDDED} can't be embedded")
        got = arrays.select("sample_id", "features").orderBy("sample_id").toPandas()
        self.ids_, self.x_ = got["sample_id"].tolist(), np.stack(got["features"].tolist()).astype(float)
        self.embedding_ = self.embed(self.x_, _distances(self.x_, self.x_))
        self.n_components_ = self.embedding_.shape[1]
        self._arrays = arrays
        return self

    def fit_transform(self, arrays: DataFrame) -> DataFrame:
        self.fit(arrays)
        pdf = pd.DataFrame({"__id": self.ids_, "components": self.embedding_.tolist()})
        found = arrays.sparkSession.createDataFrame(pdf)
        return arrays.join(found, arrays["sample_id"] == found["__id"]).drop("__id")

    def transform(self, arrays: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} places only the samples of its fit")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


def _classical(d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates from squared distances: double centering and the largest eigenvectors."""
    s = d**2
    b = -0.5 * (s - s.mean(0) - s.mean(1)[:, None] + s.mean())
    values, vectors = np.linalg.eigh((b + b.T) / 2)
    order = np.argsort(-values)[:n]
    values, vectors = np.maximum(values[order], 1e-300), vectors[:, order]
    return vectors * np.sqrt(values), values, vectors


class MDS(Embedding):
    """Metric scaling: stress majorization from the classical solution."""

    def embed(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        y = _classical(d, self.n)[0]
        for _ in range(300):
            e = _distances(y, y)
            b = -np.divide(d, e, out=np.zeros_like(d), where=e > 1e-12)
            np.fill_diagonal(b, 0)
            np.fill_diagonal(b, -b.sum(1))
            new = b @ y / len(y)
            if np.abs(new - y).max() < 1e-6 * max(1.0, np.abs(y).max()):
                return new
            y = new
        return y


class TSNE(Embedding):
    """Exact t-SNE with early exaggeration."""

    def __init__(self, n: int = 2, perplexity: float = 30.0, max_iter: int = 500, seed: int = 42):
        super().__init__(n, seed=seed)
        self.perplexity, self.max_iter = perplexity, max_iter

    def embed(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        n = len(x)
        aim = np.log(min(self.perplexity, max(1.0, (n - 1) / 3)))
        s = d**2
        low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n) / max(s.mean(), 1e-12)
        for _ in range(64):
            p = np.exp(-(s - np.sort(s, axis=1)[:, 1:2]) * beta[:, None])
            np.fill_diagonal(p, 0)
            p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
            entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
            over = entropy > aim
            low, high = np.where(over, beta, low), np.where(over, high, beta)
            beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        y = _classical(d, self.n)[0]
        y = y / max(y[:, 0].std(), 1e-12) * 1e-4
        step, gain = np.zeros_like(y), np.ones_like(y)
        for i in range(self.max_iter):
            q = 1 / (1 + _distances(y, y) ** 2)
            np.fill_diagonal(q, 0)
            w = (p * (12 if i < 100 else 1) - np.maximum(q / q.sum(), 1e-12)) * q
            grad = 4 * (w.sum(1)[:, None] * y - w @ y)
            gain = np.maximum(np.where(np.sign(grad) != np.sign(step), gain + 0.2, gain * 0.8), 0.01)
            step = (0.5 if i < 100 else 0.8) * step - max(n / 48, 50) * gain * grad
            y = y + step
        return y - y.mean(0)


class Spectral(Embedding):
    """Eigenvectors of the normalized Laplacian of the symmetric neighbour graph."""

    def embed(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        a = _neighbour_graph(d, self.neighbours)
        a = ((a + a.T) > 0).astype(float)
        degree = np.sqrt(np.maximum(a.sum(1), 1e-12))
        values, vectors = np.linalg.eigh(np.eye(len(a)) - a / degree[:, None] / degree[None, :])
        return vectors[:, 1 : self.n + 1] / degree[:, None]


def _neighbour_graph(d: np.ndarray, k: int) -> np.ndarray:
    own = d.copy()
    np.fill_diagonal(own, np.inf)
    near = np.argsort(own, axis=1, kind="stable")[:, : min(k, len(d) - 1)]
    a = np.zeros_like(d)
    np.put_along_axis(a, near, np.take_along_axis(d, near, 1) + 1e-300, 1)
    return a


class Isomap(Embedding):
    """Classical scaling of path lengths in the neighbour graph; new samples are placed through their neighbours."""

    def embed(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        a = _neighbour_graph(d, self.neighbours)
        g = np.where(a > 0, a, np.inf)
        g = np.minimum(g, g.T)
        np.fill_diagonal(g, 0)
        for k in range(len(g)):
            g = np.minimum(g, g[:, k : k + 1] + g[k : k + 1, :])
        if np.isinf(g).any():  # parts of the graph are joined by plain distances
            g = np.where(np.isinf(g), d + g[np.isfinite(g)].max(), g)
        self.paths_ = g
        y, self.values_, self.vectors_ = _classical(g, self.n)
        return y

    def transform(self, arrays: DataFrame) -> DataFrame:
        x, g, k = self.x_, self.paths_, self.neighbours
        s, matrix = (g**2).mean(0), self.vectors_ / np.sqrt(self.values_)

        @F.pandas_udf("array<double>")
        def run(v: pd.Series) -> pd.Series:
            d = _distances(np.stack(v.tolist()), x)
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            paths = (np.take_along_axis(d, near, 1)[:, :, None] + g[near]).min(1)
            return pd.Series(list(-0.5 * (paths**2 - s) @ matrix))

        return arrays.withColumn("components", run("features"))


class LLE(Embedding):
    """Locally linear embedding; new samples are placed by the weights of their neighbours."""

    def weights(self, v: np.ndarray, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        z = x[near] - v[:, None, :]
        c = z @ z.transpose(0, 2, 1)
        c += np.eye(near.shape[1]) * (1e-3 * np.maximum(np.trace(c, axis1=1, axis2=2), 1e-12))[:, None, None]
        w = np.linalg.solve(c, np.ones((*c.shape[:2], 1)))[:, :, 0]
        return w / w.sum(1, keepdims=True)

    def embed(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        own = d.copy()
        np.fill_diagonal(own, np.inf)
        near = np.argsort(own, axis=1, kind="stable")[:, : min(self.neighbours, len(x) - 1)]
        m = np.eye(len(x))
        np.put_along_axis(m, near, np.take_along_axis(m, near, 1) - self.weights(x, x, near), 1)
        values, vectors = np.linalg.eigh(m.T @ m)
        return vectors[:, 1 : self.n + 1]

    def transform(self, arrays: DataFrame) -> DataFrame:
        x, y, k, weigh = self.x_, self.embedding_, self.neighbours, self.weights

        @F.pandas_udf("array<double>")
        def run(v: pd.Series) -> pd.Series:
            v = np.stack(v.tolist())
            near = np.argsort(_distances(v, x), axis=1, kind="stable")[:, :k]
            return pd.Series(list(np.einsum("ik,ikj->ij", weigh(v, x, near), y[near])))

        return arrays.withColumn("components", run("features"))


class OptionalEmbedding(Embedding):
    """umap, pacmap or trimap where installed; ImportError otherwise."""

    module, kind = "", ""

    def __init__(self, n: int = 2, **options):
        super().__init__(n)
        self.options = options

    def embed(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        import importlib

        try:
            made = getattr(importlib.import_module(self.module), self.kind)
        except ImportError as e:
            raise ImportError(f"{self.module} is not installed") from e
        self.model_ = made(n_components=self.n, **self.options)
        return np.asarray(self.model_.fit_transform(x))

    def transform(self, arrays: DataFrame) -> DataFrame:
        model = self.model_
        if not hasattr(model, "transform"):
            raise NotImplementedError(f"{self.kind} has no transform")
        run = F.pandas_udf(lambda v: pd.Series(list(np.asarray(model.transform(np.stack(v.tolist()))))), "array<double>")
        return arrays.withColumn("components", run("features"))


class UMAP(OptionalEmbedding):
    module, kind = "umap", "UMAP"


class PaCMAP(OptionalEmbedding):
    module, kind = "pacmap", "PaCMAP"


class TriMAP(OptionalEmbedding):
    module, kind = "trimap", "TRIMAP"


def embed_2d(arrays: DataFrame, method: str = "pca", seed: int = 42) -> DataFrame:
    """Two coordinates per sample, by pca, tsne or umap (pca with a warning where umap is missing)."""
    if method == "umap":
        try:
            return UMAP(2, random_state=seed).fit_transform(arrays)
        except ImportError:
            import warnings

            warnings.warn("umap is not installed; components are used", stacklevel=2)
            method = "pca"
    if method == "tsne":
        n = arrays.count()
        return TSNE(2, perplexity=min(30, max(5, (n - 1) / 3)), seed=seed).fit_transform(arrays)
    if method != "pca":
        raise ValueError(f"unknown method {method}")
    return PCA(2).fit_transform(arrays)
