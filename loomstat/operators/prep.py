"""Preparation of features: winsorize, Yeo-Johnson, standardize; harmonization of batches.

A fit leaves a parameter table with a row per feature (and batch); a transform joins it and is a native
expression, so it also runs on streams. NULL values stay NULL and never enter a fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.scalars import known, yeo_johnson


def best_power(x: np.ndarray) -> float | None:
    """The Yeo-Johnson power of the greatest likelihood, by golden section; None for (nearly) constant values."""
    x = x[np.isfinite(x)]
    if len(x) < 2 or x.var() <= 1e-12:
        return None
    jacobian = (np.sign(x) * np.log1p(np.abs(x))).sum()

    def loss(p: float) -> float:
        y = np.empty_like(x)
        up = x >= 0
        y[up] = np.log1p(x[up]) if abs(p) < 1e-12 else (np.power(x[up] + 1, p) - 1) / p
        y[~up] = -np.log1p(-x[~up]) if abs(p - 2) < 1e-12 else -(np.power(1 - x[~up], 2 - p) - 1) / (2 - p)
        v = y.var()
        return np.inf if not np.isfinite(v) or v <= 0 else len(x) / 2 * np.log(v) - (p - 1) * jacobian

    grid = np.linspace(-5, 7, 49)
    with np.errstate(over="ignore", invalid="ignore"):
        at = int(np.argmin([loss(p) for p in grid]))
        a, b = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
        ratio = (5**0.5 - 1) / 2
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        fc, fd = loss(c), loss(d)
        while b - a > 1e-9:
            if fc < fd:
                b, d, fd = d, c, fc
                c = b - ratio * (b - a)
                fc = loss(c)
            else:
                a, c, fc = c, d, fd
                d = a + ratio * (b - a)
                fd = loss(d)
    return float((a + b) / 2)


class FeaturePrep:
    """Winsorize at percentiles, make normal by Yeo-Johnson, scale to mean 0 and population deviation 1.

    Constant features are centered only, features without values stay NULL."""

    def __init__(self, winsor_lower: float = 0.01, winsor_upper: float = 0.99, skip_power: bool = False, standardize: bool = True):
        if not 0 <= winsor_lower < winsor_upper <= 1:
            raise ValueError("0 <= winsor_lower < winsor_upper <= 1 is needed")
        self.winsor_lower, self.winsor_upper = winsor_lower, winsor_upper
        self.skip_power, self.standardize = skip_power, standardize

    def fit(self, long: DataFrame) -> FeaturePrep:
        rows = long.select("feature", known("value").alias("value"))
        low, high = self.winsor_lower, self.winsor_upper
        params = rows.groupBy("feature").agg(F.percentile("value", F.lit(low)).alias("low"), F.percentile("value", F.lit(high)).alias("high"))
        clipped = rows.join(params, "feature").select("feature", F.greatest("low", F.least("high", F.col("value"))).alias("v"), F.col("value").isNull().alias("gap")).where("not gap").drop("gap")
        if self.skip_power:
            powers = rows.select("feature").distinct().withColumn("power", F.lit(None).cast("double"))
        else:
            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "power": [best_power(pdf["v"].to_numpy(float))]}).astype({"power": float})

            powers = clipped.groupBy("feature").applyInPandas(run, "feature string, power double").select("feature", known("power").alias("power"))
        shaped = clipped.join(powers, "feature", "left").select("feature", F.when(F.col("power").isNull(), F.col("v")).otherwise(yeo_johnson("v", "power")).alias("v"))
        scale = shaped.groupBy("feature").agg(F.avg("v").alias("center"), F.stddev_pop("v").alias("sd"))
        self.params_ = params.join(powers, "feature", "left").join(scale, "feature", "left")
        return self

    def transform(self, long: DataFrame) -> DataFrame:
        p = self.params_.select(F.col("feature").alias("__f"), "low", "high", "power", "center", "sd")
        rows = long.join(p, long["feature"] == p["__f"])
        x = known("value")
        clipped = F.when(x.isNotNull(), F.greatest("low", F.least("high", x)))
        shaped = F.when(F.col("power").isNull(), clipped).otherwise(yeo_johnson(clipped, "power"))
        scaled = (shaped - F.col("center")) / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0) if self.standardize else shaped
        return rows.withColumn("value", scaled).drop("__f", "low", "high", "power", "center", "sd")

    def fit_transform(self, long: DataFrame) -> DataFrame:
        return self.fit(long).transform(long)


def shrunk(n: np.ndarray, gamma: np.ndarray, delta: np.ndarray, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Parametric empirical Bayes estimates of one batch's shifts and scales, priors pooled over its features."""
    bar, t2 = gamma.mean(), gamma.var(ddof=1) if len(gamma) > 1 else 0.0
    m, v = delta.mean(), delta.var(ddof=1) if len(delta) > 1 else 0.0
    if t2 <= 0 or v <= 0:
        return gamma, delta
    a, b = (2 * v + m * m) / v, (m * v + m**3) / v
    g, d = gamma.copy(), delta.copy()
    for _ in range(10_000):
        new_g = (t2 * n * gamma + d * bar) / (t2 * n + d)
        squares = (n - 1) * delta + n * (gamma - new_g) ** 2
        new_d = (0.5 * squares + b) / (n / 2 + a - 1)
        change = max(np.max(np.abs(new_g - g) / np.maximum(np.abs(g), 1e-12)), np.max(np.abs(new_d - d) / np.maximum(d, 1e-12)))
        g, d = new_g, new_d
        if change < tolerance:
            break
    return g, d


def shrunk_means(gamma: np.ndarray) -> np.ndarray:
    """Parametric estimates of one batch's shifts where scales are left alone."""
    bar, t2 = gamma.mean(), gamma.var(ddof=1) if len(gamma) > 1 else 0.0
    return (t2 * gamma + bar) / (t2 + 1)


def weighed(n: np.ndarray, gamma: np.ndarray, delta: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Estimates without a form of the prior: for each feature the mean of the other features' shifts and scales,
    weighed by the likelihood of its own values under them, which needs only their count, mean and variance."""
    if len(gamma) < 2:
        return gamma, delta
    g, d = np.empty_like(gamma), np.empty_like(delta)
    for at in range(0, len(gamma), block):
        i = np.arange(at, min(at + block, len(gamma)))
        squares = ((n[i] - 1) * delta[i])[:, None] + n[i][:, None] * (gamma[i][:, None] - gamma[None, :]) ** 2
        log = -0.5 * n[i][:, None] * np.log(2 * np.pi * delta)[None, :] - squares / (2 * delta)[None, :]
        log[np.arange(len(i)), i] = -np.inf
        w = np.exp(log - log.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        g[i], d[i] = w @ gamma, w @ delta
    return g, d


class BatchHarmonizer:
    """Location and scale of batches taken out (ComBat), with numeric covariates kept.

    The regression of every feature on batches and covariates needs only their cross products, which are
    sums; the shrinkage works on the small feature x batch table. Constant features pass through."""

    def __init__(self, reference: str | None = None, parametric: bool = True, on_unseen: str = "passthrough", mean_only: bool = False):
        if on_unseen not in ("passthrough", "error"):
            raise ValueError("on_unseen: passthrough or error")
        self.reference, self.parametric, self.on_unseen, self.mean_only = reference, parametric, on_unseen, mean_only

    def fit(self, long: DataFrame, covariates: list[str] = ()) -> BatchHarmonizer:
        """``long``: sample_id, batch, feature, value and the covariate columns."""
        self.covariates_ = list(covariates)
        rows = long.select("feature", F.col("batch").cast("string").alias("batch"), known("value").alias("value"), *covariates).where("value is not null and batch is not null")
        names = sorted(r[0] for r in rows.select("batch").distinct().collect())
        if len(names) < 2:
            raise ValueError("at least two batches are needed")
        if self.reference is not None and str(self.reference) not in names:
            raise ValueError(f"no batch {self.reference}")
        reference, covs, parametric, mean_only = self.reference and str(self.reference), self.covariates_, self.parametric, self.mean_only
        self.batches_ = names
        c = [F.col(x).cast("double") for x in covs]
        # Cross products per (feature, batch), around the feature's mean: counts, sums, squares.
        center = rows.groupBy("feature").agg(F.avg("value").alias("mid"))
        rows = rows.join(center, "feature").withColumn("y", F.col("value") - F.col("mid"))
        sums = [F.count("*").cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.first("mid").alias("mid")]
        sums += [F.sum(a).alias(f"c{i}") for i, a in enumerate(c)] + [F.sum(a * F.col("y")).alias(f"cy{i}") for i, a in enumerate(c)]
        sums += [F.sum(a * b).alias(f"cc{i}_{j}") for i, a in enumerate(c) for j, b in enumerate(c) if j >= i]
        moments = rows.groupBy("feature", "batch").agg(*sums)

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("batch")
            k, q = len(pdf), len(covs)
            n = pdf["n"].to_numpy()
            a, r = np.zeros((k + q, k + q)), np.zeros(k + q)
            a[:k, :k], r[:k] = np.diag(n), pdf["sy"]
            for i in range(q):
                a[:k, k + i] = a[k + i, :k] = pdf[f"c{i}"]
                r[k + i] = pdf[f"cy{i}"].sum()
                for j in range(i, q):
                    a[k + i, k + j] = a[k + j, k + i] = pdf[f"cc{i}_{j}"].sum()
            beta = np.linalg.lstsq(a, r, rcond=None)[0]
            ref = pdf["batch"].to_numpy() == reference
            grand = beta[:k][ref][0] if reference is not None and ref.any() else (n * beta[:k]).sum() / n.sum()
            cov = beta[k:]
            # Sums of residuals and of their squares around grand mean and covariates, per batch.
            sy, syy = pdf["sy"].to_numpy(), pdf["syy"].to_numpy()
            cs = pdf[[f"c{i}" for i in range(q)]].to_numpy() if q else np.zeros((k, 0))
            cy = pdf[[f"cy{i}" for i in range(q)]].to_numpy() if q else np.zeros((k, 0))
            cc = np.zeros((k, q, q))
            for i in range(q):
                for j in range(i, q):
                    cc[:, i, j] = cc[:, j, i] = pdf[f"cc{i}_{j}"]
            s1 = sy - cs @ cov - n * grand
            s2 = syy - 2 * (cy @ cov) + np.einsum("i,bij,j->b", cov, cc, cov) - 2 * grand * (sy - cs @ cov) + n * grand**2
            shift = beta[:k] - grand
            residual = s2 - 2 * shift * s1 + n * shift**2
            pooled = residual[ref].sum() / n[ref].sum() if reference is not None and ref.any() else residual.sum() / n.sum()
            flat = pooled <= 1e-12
            scale = np.sqrt(pooled) if not flat else 1.0
            gamma = s1 / n / scale
            delta = np.maximum(s2 - s1 * s1 / n, 0) / np.maximum(n - 1, 1) / scale**2
            out = pd.DataFrame({"feature": pdf["feature"].to_numpy(), "batch": pdf["batch"].to_numpy(), "n": n, "grand": grand + pdf["mid"].to_numpy(), "scale": scale, "gamma": gamma, "delta": delta, "flat": flat})
            out["slopes"] = [cov.tolist()] * k
            return out

        kinds = "feature string, batch string, n double, grand double, scale double, gamma double, delta double, flat boolean, slopes array<double>"
        found = moments.groupBy("feature").applyInPandas(solve, kinds)

        def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
            if pdf["batch"].iloc[0] == reference:
                return pdf.assign(gamma=0.0, delta=1.0)
            if mean_only:
                pdf["delta"] = 1.0
            ok = ~pdf["flat"].to_numpy(bool) & (pdf["delta"].to_numpy() > 0)
            if ok.any():
                n, g, d = (pdf[c].to_numpy()[ok] for c in ("n", "gamma", "delta"))
                if mean_only and parametric:
                    g = shrunk_means(g)
                else:
                    g, d = (shrunk if parametric else weighed)(n, g, d)
                pdf.loc[ok, "gamma"], pdf.loc[ok, "delta"] = g, d
            return pdf

        self.params_ = found.groupBy("batch").applyInPandas(shrink, kinds)
        return self

    def transform(self, long: DataFrame) -> DataFrame:
        """Values without the batch's shift and scale. Absent covariates count as 0; unseen batches pass or fail."""
        p = self.params_.where("not flat").select(F.col("feature").alias("__f"), F.col("batch").alias("__b"), "grand", "scale", "gamma", "delta", "slopes")
        if self.on_unseen == "error":
            seen = F.col("batch").cast("string").isin(*self.batches_)
            odd = long.where(F.col("batch").isNotNull() & ~seen).select("batch").distinct().limit(5).collect()
            if odd:
                raise ValueError(f"unseen batches: {[r[0] for r in odd]}")
        rows = long.join(p, (long["feature"] == p["__f"]) & (long["batch"].cast("string") == p["__b"]), "left")
        fixed = F.col("grand")
        for i, name in enumerate(self.covariates_):
            x = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in long.columns else F.lit(0.0)
            fixed = fixed + F.col("slopes")[i] * x
        x = known("value")
        adjusted = ((x - fixed) / F.col("scale") - F.col("gamma")) / F.sqrt(F.when(F.col("delta") > 0, F.col("delta")).otherwise(1.0)) * F.col("scale") + fixed
        return rows.withColumn("value", F.when(F.col("__f").isNull(), x).otherwise(adjusted)).drop("__f", "__b", "grand", "scale", "gamma", "delta", "slopes")

    def fit_transform(self, long: DataFrame, covariates: list[str] = ()) -> DataFrame:
        return self.fit(long, covariates).transform(long)


def imputed(long: DataFrame, strategy: str) -> DataFrame:
    """Missing values of a matrix: complete_features, complete_cases or median."""
    rows = long.withColumn("value", F.when(F.abs(known("value")) < float("inf"), known("value")))
    gap = F.count_if(F.col("value").isNull())
    if strategy == "complete_features":
        return rows.withColumn("__g", gap.over(Window.partitionBy("feature"))).where("__g = 0").drop("__g")
    if strategy == "complete_cases":
        return rows.withColumn("__g", gap.over(Window.partitionBy("sample_id"))).where("__g = 0").drop("__g")
    if strategy == "median":
        mid = rows.groupBy("feature").agg(F.median("value").alias("__m"))
        return rows.join(mid, "feature").withColumn("value", F.coalesce("value", "__m")).where("value is not null").drop("__m")
    raise ValueError(f"unknown strategy {strategy}")
