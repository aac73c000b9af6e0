"""Pooled least squares with indicators, cluster-robust covariance and linear contrasts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import solve
from .regress import MAX_LEVELS


def two_sided_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@dataclass(frozen=True)
class Clustered:
    """Estimates, their covariance and the sample they come from; all small and on the driver."""

    terms: tuple[str, ...]
    beta: np.ndarray
    covariance: np.ndarray
    n: int
    clusters: int
    r2: float

    def contrast(self, weights: Mapping[str, float]) -> tuple[float, float, float]:
        """(effect, standard error, p value) of a linear combination of terms."""
        c = np.zeros(len(self.terms))
        for term, w in weights.items():
            c[self.terms.index(term)] = w
        effect, se = float(c @ self.beta), math.sqrt(max(float(c @ self.covariance @ c), 0.0))
        return effect, se, two_sided_normal(effect / se) if se > 0 else float("nan")


def clustered_ols(rows: DataFrame, outcome: str, regressors: Sequence[str], effects: Sequence[str], cluster: str) -> Clustered:
    """Ordinary least squares with an intercept, indicators of ``effects`` and errors clustered by ``cluster``.

    ``rows`` has no NULL in what is read and should be a persisted or written table: it is read for
    the factor of the design and again for the scores.  Scores are summed inside partitions first and then by
    cluster, and only the K x K sum of their outer products reaches the driver.  The usual factor
    G / (G - 1) * (N - 1) / (N - K) applies; p values are normal.
    """
    every = {}
    for e in effects:
        got = rows.select(e).distinct().limit(MAX_LEVELS + 1).collect()
        if len(got) > MAX_LEVELS:
            raise ValueError(f"{e!r} has more than {MAX_LEVELS} levels")
        every[e] = [str(v) for v in sorted(r[0] for r in got)]
    levels = {e: v[1:] for e, v in every.items()}  # the first level is the base
    terms = ["Intercept", *regressors, *(f"{e}_{v}" for e in effects for v in levels[e])]
    keyed = rows.select(cluster, outcome, *regressors, *[F.col(e).cast("string").alias(e) for e in effects])
    got = solve.factors(keyed, [], ["1", *regressors], every, outcome).collect()
    if not got:
        raise ValueError("no rows to estimate from")
    r = np.asarray(got[0]["r"], float).reshape(got[0]["height"], got[0]["width"])
    take, j = list(range(1 + len(regressors))), 1 + len(regressors)
    for e in effects:
        take += list(range(j + 1, j + len(every[e])))
        j += len(every[e])
    x = r[:, take]
    n = rows.count()
    beta, rank, ssr = solve.minimum_norm(np.column_stack([x, r[:, -1]]), n)
    sst = solve._centred(np.column_stack([r[:, :1], r[:, -1]]))
    bread = np.linalg.pinv(x.T @ x)

    k = len(terms)
    at = {e: {v: i for i, v in enumerate(levels[e])} for e in effects}

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            m = np.zeros((len(part), k))
            m[:, 0] = 1.0
            for i, c in enumerate(regressors):
                m[:, 1 + i] = part[c].to_numpy(float)
            j = 1 + len(regressors)
            for e in effects:
                where = part[e].map(at[e])
                ok = where.notna().to_numpy()
                m[np.flatnonzero(ok), j + where[ok].astype(int).to_numpy()] = 1.0
                j += len(at[e])
            u = part[outcome].to_numpy(float) - m @ beta
            s = pd.DataFrame(m * u[:, None]).groupby(part[cluster].to_numpy()).sum()
            yield pd.DataFrame({"g": s.index, "s": list(s.to_numpy())})

    kind = rows.schema[cluster].dataType.simpleString()
    each = keyed.mapInPandas(scores, f"g {kind}, s array<double>")
    each = each.groupBy("g").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k)])

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, k)), 0
        for part in batches:
            m = part[[f"s{i}" for i in range(k)]].to_numpy(float)
            total += m.T @ m
            count += len(m)
        if count:
            yield pd.DataFrame({"m": [total.ravel().tolist()], "g": [count]})

    blocks = each.coalesce(64).mapInPandas(outer, "m array<double>, g long").collect()
    meat = sum(np.asarray(b["m"], float) for b in blocks).reshape(k, k)
    clusters = int(sum(b["g"] for b in blocks))
    scale = clusters / (clusters - 1) * (n - 1) / (n - rank) if clusters > 1 and n > rank else float("nan")
    return Clustered(tuple(terms), beta, scale * bread @ meat @ bread, n, clusters, 1 - ssr / sst if sst > 0 else float("nan"))
