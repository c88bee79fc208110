"""Models of an outcome per feature and covariate tier: linear, logistic, Cox, grouped.

One group of Arrow data per (model, feature), fitted with NumPy; a fit that fails is a row that says so.
The univariable linear model with HC3 errors is native: two aggregations, no group is gathered.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.ranking import with_fdr
from loomstat.functions.scalars import known
from loomstat.functions.tails import normal_tails, t_quantile, t_sf2, t_tails

SCHEMA = (
    "model string, feature string, model_family string, outcome_type string, covariates string, coef double, effect double, effect_name string, "
    "se double, statistic double, p_value double, ci_low double, ci_high double, c_index double, n long, n_events long, n_missing long, status string, error string"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def ols_hc3(long: DataFrame, y: str = "y") -> DataFrame:
    """(feature, n, coef, se, statistic, p_value) of y on each feature alone, standard errors by HC3."""
    rows = long.select("feature", known("value").alias("x"), known(y).alias("y")).where("x is not null and y is not null")
    m = rows.groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.covar_pop("x", "y") * F.count("*")).alias("sxy"), (F.var_pop("x") * F.count("*")).alias("sxx"))
    m = m.withColumn("coef", F.try_divide("sxy", "sxx"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    left = 1 - F.lit(1.0) / F.col("n") - F.try_divide(dx * dx, "sxx")
    part = F.try_divide(dx * (dy - F.col("coef") * dx), F.when(left > 1e-12, left))
    s = rows.join(m, "feature").groupBy("feature", "n", "coef", "sxx").agg(F.sum(part * part).alias("q"))
    out = s.select("feature", "n", "coef", F.try_divide(F.sqrt("q"), "sxx").alias("se"))
    out = out.withColumn("statistic", F.try_divide("coef", "se"))
    return out.withColumn("p_value", t_sf2("statistic", F.col("n") - 2))


def outcome_type(meta: DataFrame, outcome: list[str]) -> str:
    """survival for two columns, binary for at most two values, else continuous."""
    if len(outcome) >= 2:
        return "survival"
    n = meta.agg(F.countDistinct(outcome[0])).first()[0]
    return "binary" if n <= 2 else "continuous"


def _linear(y: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    w = (y - x @ beta) / np.maximum(1 - h, 1e-12)
    cov = inverse @ (x.T * w**2) @ x @ inverse
    return beta[1], math.sqrt(cov[1, 1])


def _logistic(y: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        info = (x.T * (p * (1 - p))) @ x
        step = np.linalg.solve(info, x.T @ (y - p))
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    else:
        raise ValueError("no convergence")
    if np.abs(beta).max() > 50:
        raise ValueError("perfect separation")
    return beta[1], math.sqrt(np.linalg.inv(info)[1, 1])


def _gee(y: np.ndarray, x: np.ndarray, group: np.ndarray) -> tuple[float, float]:
    """Logistic marginal model with exchangeable correlation and robust errors."""
    beta = np.zeros(x.shape[1])
    members = [np.flatnonzero(group == g) for g in np.unique(group)]
    alpha = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        s = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        r = (y - p) / s
        pairs = sum(len(m) * (len(m) - 1) / 2 for m in members)
        cross = sum((r[m].sum() ** 2 - (r[m] ** 2).sum()) / 2 for m in members)
        phi = (r**2).sum() / max(len(y) - x.shape[1], 1)
        alpha = float(np.clip(cross / max(pairs - x.shape[1], 1) / phi, -0.5, 0.95)) if pairs else 0.0
        a, b, meat = np.zeros((x.shape[1],) * 2), np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
        for m in members:
            d = x[m] * (s[m] ** 2)[:, None]
            v = np.linalg.inv(np.outer(s[m], s[m]) * ((1 - alpha) * np.eye(len(m)) + alpha))
            u = d.T @ v @ (y[m] - p[m])
            a += d.T @ v @ d
            b += u
            meat += np.outer(u, u)
        step = np.linalg.solve(a, b)
        beta += step
        if np.abs(step).max() < 1e-9:
            inverse = np.linalg.inv(a)
            return beta[1], math.sqrt((inverse @ meat @ inverse)[1, 1])
    raise ValueError("no convergence")


def _laplace_glmm(y: np.ndarray, x: np.ndarray, group: np.ndarray) -> tuple[float, float]:
    """Logistic model with a random intercept: posterior mode with alternating updates of its variance."""
    names, at = np.unique(group, return_inverse=True)
    z = np.zeros((len(y), len(names)))
    z[np.arange(len(y)), at] = 1
    full, k, tau = np.hstack((x, z)), x.shape[1], 1.0
    theta = np.zeros(full.shape[1])
    for _ in range(100):
        before = theta.copy()
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(full @ theta, -500, 500)))
            prior = np.concatenate((np.full(k, 1e-6), np.full(len(names), 1 / tau)))
            h = (full.T * (p * (1 - p))) @ full + np.diag(prior)
            step = np.linalg.solve(h, full.T @ (y - p) - prior * theta)
            theta += step
            if np.abs(step).max() < 1e-9:
                break
        cov = np.linalg.inv(h)
        tau = max(float((theta[k:] ** 2 + np.diag(cov)[k:]).mean()), 1e-6)
        if np.abs(theta - before).max() < 1e-7:
            break
    return theta[1], math.sqrt(cov[1, 1])


def _mixed(y: np.ndarray, x: np.ndarray, group: np.ndarray) -> tuple[float, float]:
    """Random intercept by restricted maximum likelihood, profiled over the variance ratio."""
    _, at = np.unique(group, return_inverse=True)
    sizes = np.bincount(at).astype(float)
    sums = lambda v: np.array([np.bincount(at, weights=c) for c in v.T]).T
    xx, xy, yy = x.T @ x, x.T @ y, y @ y
    sx, sy = sums(x), np.bincount(at, weights=y)
    n, k = x.shape

    def at_ratio(r: float):
        w = r / (1 + r * sizes)
        a = xx - (sx.T * w) @ sx
        b = xy - sx.T @ (w * sy)
        beta = np.linalg.solve(a, b)
        rss = yy - (w * sy**2).sum() - b @ beta
        loss = (n - k) * math.log(max(rss, 1e-300)) + np.log1p(r * sizes).sum() + np.linalg.slogdet(a)[1]
        return loss, beta, a, max(rss, 0) / (n - k)

    grid = np.concatenate(([0.0], np.exp(np.linspace(-12, 8, 61))))
    i = int(np.argmin([at_ratio(r)[0] for r in grid]))
    low, high = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    for _ in range(100):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if at_ratio(a)[0] < at_ratio(b)[0] else (a, high)
    _, beta, a, s2 = at_ratio((low + high) / 2)
    return beta[1], math.sqrt(s2 * np.linalg.inv(a)[1, 1])


def _below(ranks: np.ndarray, to: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each i, how many of the first ``to[i]`` ranks are below ``rank[i]``; a pass over all for each binary digit."""
    low, high, out = np.zeros_like(to), to.copy(), np.zeros(len(to), dtype=np.int64)
    for bit in reversed(range(int(max(ranks.max(initial=0), rank.max(initial=0))).bit_length())):
        one = (ranks >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        a, b, up = zeros[low], zeros[high], (rank >> bit & 1).astype(bool)
        out += np.where(up, b - a, 0)
        low, high = np.where(up, zeros[-1] + low - a, a), np.where(up, zeros[-1] + high - b, b)
        ranks = np.concatenate([ranks[~one], ranks[one]])
    return out


def _concordance(t: np.ndarray, e: np.ndarray, risk: np.ndarray) -> float:
    """Share of pairs of an event and a later time in which the event has the greater risk, ties half; times descend."""
    later = np.searchsorted(-t, -t[e], side="left")  # so many have a later time
    _, ranks = np.unique(risk, return_inverse=True)
    less, most = _below(ranks, later, ranks[e]), _below(ranks, later, ranks[e] + 1)
    pairs = int(later.sum())
    return (int(less.sum()) + 0.5 * int((most - less).sum())) / pairs if pairs else math.nan


def _cox(time: np.ndarray, event: np.ndarray, x: np.ndarray, group: np.ndarray | None, penalizer: float) -> tuple[float, float, float]:
    """Efron ties, optional ridge, sandwich errors by group; and the concordance of the risk.

    Sums over those at risk are running sums over distinct times, so a step takes time linear in rows."""
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-12)
    z, n, k = (x - mean) / sd, *x.shape
    beta = np.zeros(k)
    order = np.argsort(-time, kind="stable")
    z, t, e = z[order], time[order], event[order] > 0
    firsts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    at = np.cumsum(np.concatenate([[0], t[1:] != t[:-1]]))  # the distinct time of each row
    dead = np.flatnonzero(e)
    deaths = np.bincount(at[dead], minlength=len(firsts))
    own = at[dead]
    q = (np.arange(len(dead)) - (np.cumsum(deaths) - deaths)[own]) / deaths[own]

    def left(v: np.ndarray) -> np.ndarray:
        """For each event, the sum over those at risk less its share of the events of its time."""
        return np.cumsum(np.add.reduceat(v, firsts))[own] - q * np.bincount(own, weights=v[dead], minlength=len(firsts))[own]

    def score(b: np.ndarray):
        risk = np.exp(np.clip(z @ b, -200, 200))
        a0 = left(risk)
        bar = np.stack([left(risk * c) / a0 for c in z.T], axis=1)
        grad = z[dead].sum(0) - bar.sum(0) - penalizer * n * b
        info = penalizer * n * np.eye(k) - bar.T @ bar
        for i in range(k):
            for j in range(i + 1):
                own_sum = (left(risk * z[:, i] * z[:, j]) / a0).sum()
                info[i, j] += own_sum
                info[j, i] += own_sum * (i != j)
        return grad, info, risk, a0, bar

    for _ in range(60):
        grad, info, risk, a0, bar = score(beta)
        step = np.linalg.solve(info, grad)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    else:
        raise ValueError("no convergence")
    cov = np.linalg.inv(info)
    if group is not None:
        of = lambda w: np.bincount(own, weights=w, minlength=len(firsts))
        until = lambda v: np.cumsum(v[::-1])[::-1][at]  # over events at this time or before
        _, g = np.unique(group[order], return_inverse=True)
        weight, sums = until(of(1 / a0)), []
        for c, m in zip(z.T, bar.T):
            each = -risk * (c * weight - until(of(m / a0)))
            each[dead] += c[dead] - (of(m) / np.maximum(deaths, 1))[own]
            sums.append(np.bincount(g, weights=each))
        sums = np.stack(sums, axis=1)
        cov = cov @ sums.T @ sums @ cov
    return beta[0] / sd[0], math.sqrt(cov[0, 0]) / sd[0], _concordance(t, e, z @ beta)


def associations(long: DataFrame, meta: DataFrame, kind: str = "auto", outcome: list[str] = ("y",), tiers: dict[str, list[str]] | None = None, group: str | None = None, mixed_method: str = "glmm", penalizer: float = 0.0, min_events: int = 1, min_unique: int = 2) -> DataFrame:
    """The table of all features in all tiers, with q values within each tier.

    ``long``: sample_id, feature, value; ``meta``: sample_id, outcome (time, event for survival), covariates, group."""
    outcome = list(outcome)
    tiers = tiers or {"univariable": []}
    kind = outcome_type(meta, outcome) if kind == "auto" else kind
    if kind not in ("continuous", "binary", "survival"):
        raise ValueError(f"unknown outcome type {kind}")
    lacking = [c for cs in tiers.values() for c in cs if c not in meta.columns]
    if lacking:
        raise ValueError(f"covariates are missing: {lacking}")
    covs = list(dict.fromkeys(c for cs in tiers.values() for c in cs))
    columns = [known(outcome[0]).alias("y0"), (known(outcome[1]) if len(outcome) > 1 else F.lit(0.0)).alias("y1")]
    columns += [known(c).alias(f"c{i}") for i, c in enumerate(covs)] + [(F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g")]
    side = meta.select("sample_id", *columns)
    rows = long.select("sample_id", "feature", known("value").alias("x")).join(side, "sample_id", "left")
    rows = rows.drop("sample_id").withColumn("model", F.explode(F.array(*[F.lit(t) for t in tiers])))
    family = {"survival": "cox", "binary": "logit" if group is None else mixed_method, "continuous": "ols_hc3" if group is None else "mixedlm"}[kind]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        model, feature = pdf["model"].iloc[0], pdf["feature"].iloc[0]
        own = tiers[model]
        used = [f"c{covs.index(c)}" for c in own]
        need = ["x", "y0", *(["y1"] if kind == "survival" else []), *used, *(["g"] if group else [])]
        whole = pdf.dropna(subset=need)
        out = dict.fromkeys(NAMES)
        out |= {"model": model, "feature": feature, "model_family": family, "outcome_type": kind, "covariates": ",".join(own), "n": len(whole), "n_missing": len(pdf) - len(whole)}
        out["effect_name"] = {"survival": "HR", "binary": "OR", "continuous": "coef"}[kind]
        x = whole["x"].to_numpy(float)
        y = whole["y0"].to_numpy(float)
        event = whole["y1"].to_numpy(float)
        if kind == "survival":
            out["n_events"] = int((event > 0).sum())
        elif kind == "binary":
            out["n_events"] = int((y > 0).sum())
        design = np.column_stack([np.ones(len(whole)), x, *[whole[c].to_numpy(float) for c in used]])
        if not len(whole):
            out["status"] = "no_complete_cases"
        elif len(np.unique(x)) < min_unique:
            out["status"] = "constant_feature"
        elif kind == "survival" and out["n_events"] < min_events:
            out["status"] = "no_events"
        elif kind == "continuous" and len(whole) < design.shape[1] + 2:
            out["status"] = "not_enough_degrees_of_freedom"
        else:
            try:
                g = whole["g"].to_numpy(str) if group else None
                if kind == "survival":
                    coef, se, out["c_index"] = _cox(y, event, design[:, 1:], g, penalizer)
                elif kind == "binary":
                    if not set(np.unique(y)) <= {0.0, 1.0}:
                        raise ValueError("a binary outcome is 0 or 1")
                    coef, se = _logistic(y, design) if g is None else (_gee if mixed_method == "gee" else _laplace_glmm)(y, design, g)
                else:
                    coef, se = _linear(y, design) if g is None else _mixed(y, design, g)
                if not (math.isfinite(coef) and math.isfinite(se) and se > 0):
                    raise ValueError("no finite estimate")
                stat = coef / se
                df = len(whole) - design.shape[1]
                t = kind == "continuous" and g is None
                half = (t_quantile(0.975, df) if t else 1.959963984540054) * se
                p = float((t_tails(np.array([stat]), np.array([float(df)])) if t else normal_tails(np.array([stat])))[0])
                scale = math.exp if kind != "continuous" else float
                out |= {"coef": coef, "se": se, "statistic": stat, "p_value": p, "effect": scale(coef), "ci_low": scale(coef - half), "ci_high": scale(coef + half), "status": "ok"}
            except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                out |= {"status": "fit_failed", "error": " ".join(str(e).split())[:300]}
        made = pd.DataFrame([out])[NAMES]
        return made.astype({c: float for c in ("coef", "effect", "se", "statistic", "p_value", "ci_low", "ci_high", "c_index")}).astype({c: "Int64" for c in ("n", "n_events", "n_missing")})

    found = rows.groupBy("model", "feature").applyInPandas(fit, SCHEMA)
    doubles = {f.name for f in found.schema if f.dataType.simpleString() == "double"}
    found = found.select(*[known(c).alias(c) if c in doubles else c for c in NAMES])
    return with_fdr(found, by=("model",))


def group_folds(groups: DataFrame, group: str, folds: int) -> DataFrame:
    """A fold per group, sizes balanced: the largest group to the smallest fold. A row per group, not per sample."""
    sizes = groups.groupBy(group).count().orderBy(F.desc("count"), group).toPandas()
    load, fold = np.zeros(folds), []
    for n in sizes["count"]:
        at = int(load.argmin())
        load[at] += n
        fold.append(at)
    return groups.sparkSession.createDataFrame(sizes.assign(fold=fold)[[group, "fold"]])


def reconstruction_error(long: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Mean squared difference of values by sample and feature."""
    both = long.select("sample_id", "feature", "value").join(rebuilt.select("sample_id", "feature", F.col("value").alias("again")), ["sample_id", "feature"])
    return both.agg(F.avg(F.pow(F.col("value") - F.col("again"), F.lit(2))).alias("mse"))


def variance_threshold(long: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Rows of features whose population variance is above the threshold."""
    v = F.var_pop(known("value")).over(Window.partitionBy("feature"))
    return long.withColumn("__v", v).where(F.col("__v") > threshold).drop("__v")
