"""Co-expression modules of features: correlation network, topological overlap, modules, eigengenes.

The correlation matrix is a distributed Gramian; the network over features (p x p, p checked) is built on
the driver from the published definitions (Zhang & Horvath 2005; Langfelder, Zhang & Horvath 2008). Scores
of samples are a native join and aggregation, in batch or on a stream.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.operators.reduce import Reducer, gramian

UNASSIGNED = "unassigned"


def project(long: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, module, score): sums of standardized values times loadings. ``weights``: feature, module, center, scale, loading."""
    rows = long.select("sample_id", "feature", "value").join(weights, "feature")
    part = (F.col("value") - F.col("center")) / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0) * F.col("loading")
    return rows.groupBy("sample_id", "module").agg(F.sum(part).alias("score"))


def rebuild(scores: DataFrame, weights: DataFrame, features: DataFrame) -> DataFrame:
    """(sample_id, feature, value) from module scores; features outside modules are 0."""
    made = scores.join(weights, "module").select("sample_id", "feature", (F.col("score") * F.col("loading") * F.col("scale") + F.col("center")).alias("value"))
    every = scores.select("sample_id").distinct().crossJoin(features.select("feature"))  # the wide table's own cells
    return every.join(made, ["sample_id", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def importances(weights: DataFrame, normalize: bool = True) -> DataFrame:
    """(feature, module, loading, importance): absolute loadings, as shares of their module's."""
    share = F.abs("loading") / F.sum(F.abs("loading")).over(Window.partitionBy("module")) if normalize else F.abs("loading")
    return weights.select("feature", "module", "loading", share.alias("importance"))


def module_sizes(weights: DataFrame) -> DataFrame:
    return weights.groupBy("module").agg(F.count("*").alias("n_features"))


def average_linkage(d: np.ndarray) -> np.ndarray:
    """Merges (a, b, height, size) of average linkage by nearest-neighbour chains, in order of height."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((a, b, d[a, b]))
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        row[[a, b]] = np.inf
        row[~alive] = np.inf
        d[b], d[:, b] = row, row
        d[a], d[:, a] = np.inf, np.inf
        alive[a] = False
        size[b] += size[a]
    out, label, count = np.zeros((n - 1, 4)), {i: i for i in range(n)}, {i: 1 for i in range(n)}
    for k, (a, b, h) in enumerate(sorted(merges, key=lambda m: m[2])):
        x, y = sorted((label[a], label[b]))
        count[n + k] = count[x] + count[y]
        out[k] = x, y, h, count[n + k]
        label[b] = label[a] = n + k
        for i, v in label.items():
            if v in (x, y):
                label[i] = n + k
    return out


def leaves(link: np.ndarray) -> list[int]:
    """Leaf order of a tree."""
    n, stack, out = len(link) + 1, [2 * len(link)], []
    while stack:
        i = int(stack.pop())
        if i < n:
            out.append(i)
        else:
            stack += [link[i - n, 1], link[i - n, 0]]
    return out


def cut_tree(link: np.ndarray, d: np.ndarray, min_size: int, deep: int = 2) -> np.ndarray:
    """Modules from 1, 0 for none: branches that are large and tight enough and apart from what they join.

    A branch is a module if it has ``min_size`` members and its core is closer than the height at which it joins
    another branch by a gap that shrinks with ``deep``. Others join the nearest module if they are within its radius.
    """
    n = len(link) + 1
    top = float(np.quantile(link[:, 2], 0.99))
    bottom = float(np.quantile(link[:, 2], 0.05))
    gap = (0.8, 0.73, 0.64, 0.5, 0.3)[deep]
    least = (1 - gap) * 0.75 * (top - bottom)
    members = {i: [i] for i in range(n)}
    found: dict[int, list[list[int]]] = {i: [] for i in range(n)}

    def core(m: list[int]) -> float:
        k = max(2, min(len(m), int(min_size / 2 + 1 + np.sqrt(max(0, len(m) - min_size / 2)))))
        own = d[np.ix_(m, m)]
        near = np.sort(own.mean(1))[:k]
        return float(near.mean())

    for k, (a, b, h, _) in enumerate(link):
        a, b = int(a), int(b)
        node = n + k
        good = []
        for side in (a, b):
            whole = len(members[side]) >= min_size and h - core(members[side]) >= least and h > bottom
            good.append(found[side] or ([members[side]] if whole else []))
        if h > top:  # branches that meet above the cut stay apart
            found[node] = good[0] + good[1]
        elif good[0] and good[1]:
            found[node] = good[0] + good[1]
        else:
            found[node] = [] if not (found[a] or found[b]) else found[a] + found[b]
        members[node] = members[a] + members[b]
    last = 2 * n - 2
    modules = found[last] or ([members[last]] if n >= min_size and top - core(members[last]) >= least else [])
    labels = np.zeros(n, int)
    for i, m in enumerate(sorted(modules, key=lambda m: (-len(m), min(m))), 1):
        labels[m] = i
    for i in np.flatnonzero(labels == 0) if modules else []:
        means = [d[i, labels == j].mean() for j in range(1, labels.max() + 1)]
        j = int(np.argmin(means)) + 1
        own = np.flatnonzero(labels == j)
        if means[j - 1] <= d[np.ix_(own, own)].mean(1).max():
            labels[i] = -j
    return np.abs(labels)


def eigengene(x: np.ndarray, count: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Center, scale, loadings (features x components) and scores of a module; the first score goes with the mean."""
    center, scale = x.mean(0), x.std(0, ddof=1)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - center) / scale
    u, s, v = np.linalg.svd(z, full_matrices=False)
    count = min(count, len(s))
    load = v[:count].T
    score = z @ load
    if score.shape[1] and score[:, 0] @ z.mean(1) < -1e-10:
        load[:, 0], score[:, 0] = -load[:, 0], -score[:, 0]
    return center, scale, load, score


class CoexpressionModules(Reducer):
    """Modules of features that vary together, and their eigengenes as components."""

    prefix = "module"

    def __init__(self, network: str = "signed hybrid", soft_power: int | str = "auto", r_squared: float = 0.9, mean_cut: float = 100, power_max: int = 30, min_module_size: int = 50, merge: float = 0.2, deep_split: int = 2, components: int = 1):
        if network not in ("signed", "unsigned", "signed hybrid"):
            raise ValueError(f"unknown network {network}")
        if not 0 <= deep_split <= 4 or min_module_size < 2 or not 0 <= merge <= 1:
            raise ValueError("deep_split is 0 to 4, min_module_size 2 or more, merge 0 to 1")
        self.network, self.soft_power, self.r_squared, self.mean_cut = network, soft_power, r_squared, mean_cut
        self.power_max, self.min_module_size, self.merge, self.deep_split, self.components = power_max, min_module_size, merge, deep_split, components

    def similarity(self, r: np.ndarray) -> np.ndarray:
        if self.network == "signed":
            return (1 + r) / 2
        return np.abs(r) if self.network == "unsigned" else np.maximum(r, 0)

    def power_table(self, r: np.ndarray) -> pd.DataFrame:
        """Scale-free fit of each power: degrees in ten bins, log frequency on log degree, signed R squared."""
        rows = []
        for power in range(1, self.power_max + 1):
            k = (self.similarity(r) ** power).sum(0) - 1
            count, edge = np.histogram(k, 10)
            ok = count > 0
            mids = np.array([k[(k >= a) & (k <= b)].mean() if n else (a + b) / 2 for a, b, n in zip(edge, edge[1:], count)])
            x, y = np.log10(np.maximum(mids[ok], 1e-12)), np.log10(count[ok] / len(k))
            fit, slope = 0.0, 0.0
            if ok.sum() > 2 and x.std() > 0 and y.std() > 0:
                c = np.corrcoef(x, y)[0, 1]
                slope, fit = c * y.std() / x.std(), c * c
            rows.append((power, -np.sign(slope) * fit, slope, k.mean()))
        return pd.DataFrame(rows, columns=["power", "signed_r_squared", "slope", "mean_k"])

    def fit(self, arrays: DataFrame, names: list[str] | None = None) -> CoexpressionModules:
        n, mean, g = gramian(arrays)
        p = len(mean)
        if n < 3 or p < 3:
            raise ValueError("at least three samples and features are needed")
        self.names_ = names or [f"f{i:02d}" for i in range(p)]
        sd = np.sqrt(np.maximum(np.diag(g), 0))
        r = np.clip(g / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1)), -1, 1)
        np.fill_diagonal(r, 1)
        self.power_table_ = self.power_table(r)
        if self.soft_power == "auto":
            ok = self.power_table_[(self.power_table_.signed_r_squared >= self.r_squared) & (self.power_table_.mean_k <= self.mean_cut)]
            if not len(ok):
                raise ValueError("no power makes the network scale-free")
            self.power_ = int(ok.power.iloc[0])
        else:
            self.power_ = int(self.soft_power)
        a = self.similarity(r) ** self.power_
        np.fill_diagonal(a, 0)
        k = a.sum(0)
        tom = (a @ a + a) / (np.minimum.outer(k, k) + 1 - a)
        np.fill_diagonal(tom, 1)
        d = 1 - tom
        np.fill_diagonal(d, 0)
        self.linkage_ = average_linkage(d)
        labels = cut_tree(self.linkage_, d, self.min_module_size, self.deep_split)
        self.labels_ = self._merged(labels, r, sd)
        self._load(g, mean, sd, n)
        return self

    def _first(self, own: np.ndarray, r: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(r[np.ix_(own, own)])
        v = vectors[:, -1]
        return v if (r[np.ix_(own, own)] @ v).sum() >= -1e-10 else -v

    def _merged(self, labels: np.ndarray, r: np.ndarray, sd: np.ndarray) -> np.ndarray:
        """Join modules whose eigengenes are closer than ``merge``; correlations follow from the Gramian."""
        while True:
            names = [m for m in np.unique(labels) if m]
            if len(names) < 2:
                return labels
            w = np.zeros((len(names), len(labels)))
            for i, m in enumerate(names):
                own = np.flatnonzero(labels == m)
                w[i, own] = self._first(own, r)
            c = w @ r @ w.T
            s = np.sqrt(np.maximum(np.diag(c), 1e-300))
            far = 1 - c / np.outer(s, s)
            link = average_linkage(far)
            close = {i: [m] for i, m in enumerate(names)}
            joined = False
            for k, (a, b, h, _) in enumerate(link):
                close[len(names) + k] = close[int(a)] + close[int(b)]
                if h < self.merge:
                    group = close[len(names) + k]
                    largest = max(sorted(group), key=lambda m: (labels == m).sum())
                    labels = np.where(np.isin(labels, group), largest, labels)
                    close[len(names) + k] = [largest]
                    joined = True
            if not joined:
                return labels

    def _load(self, g: np.ndarray, mean: np.ndarray, sd: np.ndarray, n: int) -> None:
        scale = np.where(sd > 0, sd / np.sqrt(n - 1), 1.0)
        r = g / (n - 1) / np.outer(scale, scale)
        rows = []
        sizes = sorted((m for m in np.unique(self.labels_) if m), key=lambda m: (-(self.labels_ == m).sum(), m))
        self.module_names_ = [f"m{i}" for i in range(len(sizes))]
        for name, m in zip(self.module_names_, sizes):
            own = np.flatnonzero(self.labels_ == m)
            values, vectors = np.linalg.eigh(r[np.ix_(own, own)])
            count = min(self.components, len(own), n)
            for c in range(count):
                v = vectors[:, -1 - c]
                if c == 0 and (r[np.ix_(own, own)] @ v).sum() < -1e-10:
                    v = -v
                rows += [(self.names_[i], name if count == 1 else f"{name}_{c}", float(mean[i]), float(scale[i]), float(x)) for i, x in zip(own, v)]
        self.weights_ = rows
        self.n_components_ = len({x[1] for x in rows})

    def weights(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.weights_, "feature string, module string, center double, scale double, loading double")

    def transform(self, long: DataFrame) -> DataFrame:
        return project(long, self.weights(long.sparkSession))

    def assignments(self, spark: SparkSession) -> DataFrame:
        own = {f: m for f, m, *_ in self.weights_}
        return spark.createDataFrame([(f, own.get(f, UNASSIGNED)) for f in self.names_], "feature string, module string")

    def artifacts(self) -> dict:
        return {"feature_names": self.names_, "linkage": self.linkage_, "cluster_labels": self.labels_, "feature_order": [self.names_[i] for i in leaves(self.linkage_)], "power_table": self.power_table_}
