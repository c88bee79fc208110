"""Chains of fitted steps, and search over their parameters with folds that keep groups together.

A step has ``fit(df)`` and ``transform(df)``; its parameters are the arguments of its constructor. A fit or a score of
a candidate is a Spark job over all its rows; only candidates x folds are counted off on the driver.
"""

from __future__ import annotations

import copy
import inspect
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def params(step: Any) -> dict[str, Any]:
    """A step's parameters: its constructor's arguments, as they are now."""
    names = [n for n, p in inspect.signature(type(step).__init__).parameters.items() if n != "self" and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)]
    return {n: getattr(step, n) for n in names if hasattr(step, n)}


def clone(step: Any) -> Any:
    """The step as it is before any fit: without attributes that end in an underscore."""
    out = copy.copy(step)
    for name in [n for n in vars(out) if n.endswith("_") and not n.startswith("_")]:
        delattr(out, name)
    return out


class Chain:
    """Steps by name, each fitted on what the ones before make of the input."""

    def __init__(self, steps: list[tuple[str, Any]]):
        if len({n for n, _ in steps}) < len(steps):
            raise ValueError("names of steps repeat")
        self.steps = steps

    def get_params(self) -> dict[str, Any]:
        return {f"{n}__{k}": v for n, step in self.steps for k, v in params(step).items()}

    def set_params(self, **values: Any) -> Chain:
        own = dict(self.steps)
        for name, value in values.items():
            step, _, key = name.partition("__")
            if step not in own or key not in params(own[step]):
                raise ValueError(f"unknown parameter {name}")
            setattr(own[step], key, value)
        return self

    def clone(self) -> Chain:
        return Chain([(n, clone(s)) for n, s in self.steps])

    def fit(self, df: DataFrame) -> Chain:
        for i, (_, step) in enumerate(self.steps):
            step.fit(df)
            if i < len(self.steps) - 1:
                df = step.transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step.transform(df)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for _, step in reversed(self.steps):
            df = step.inverse_transform(df)
        return df


def hashed_folds(df: DataFrame, key: str, folds: int, to: str = "fold", seed: int = 0) -> DataFrame:
    """``df`` with a fold for each value of ``key``, by its hash: no shuffle, and the same on every run."""
    return df.withColumn(to, F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int"))


@dataclass
class Found:
    """``scores(candidate, fold, metric, score)``, the candidates' parameters, the best one, and a chain fitted with it on all rows."""

    scores: DataFrame
    candidates: list[dict[str, Any]]
    best: dict[str, Any]
    fitted: Chain | None

    def summary(self) -> DataFrame:
        """``(candidate, metric, mean, sd, rank)``: rank 1 has the greatest mean."""
        from pyspark.sql import Window

        means = self.scores.groupBy("candidate", "metric").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
        return means.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc_nulls_last("mean"), "candidate")))


def grid_search(df: DataFrame, chain: Chain, grid: dict[str, list], metrics: dict[str, Callable[[Chain, DataFrame], float]], folds: int, fold: str = "fold", refit: str | None = None) -> Found:
    """Fit each combination of ``grid`` on all folds but one and score it on that one, greater being better.

    ``df`` has a column ``fold`` of 0 to ``folds`` - 1. The best candidate is that with the greatest mean of the
    metric ``refit`` (the only one, if there is one), the first of equals; it is fitted again on all rows."""
    if refit is None and len(metrics) > 1:
        raise ValueError("with several metrics, refit names one")
    refit = refit or next(iter(metrics))
    if refit not in metrics:
        raise ValueError(f"unknown metric {refit}")
    candidates = [dict(zip(grid, values)) for values in product(*grid.values())]
    rows, total = [], [0.0] * len(candidates)
    for k in range(folds):
        train, test = df.where(F.col(fold) != k).drop(fold), df.where(F.col(fold) == k).drop(fold)
        for i, candidate in enumerate(candidates):
            fitted = chain.clone().set_params(**candidate).fit(train)
            for name, metric in metrics.items():
                rows.append((i, k, name, float(metric(fitted, test))))
                total[i] += rows[-1][3] if name == refit else 0.0
    best = candidates[max(range(len(candidates)), key=lambda i: (total[i], -i))]
    scores = df.sparkSession.createDataFrame(rows, "candidate int, fold int, metric string, score double")
    return Found(scores, candidates, best, chain.clone().set_params(**best).fit(df.drop(fold)))
