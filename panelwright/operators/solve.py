"""Least squares over groups of rows as mergeable triangular factors.

Every partition turns its rows of a group into the triangular factor of [X y] without a shuffle; factors of one
group are stacked and factored again, in two rounds, so no task sees more than a bounded number of small
blocks however large the group is.  The singular values of the last factor are those of X, which gives rank
and the minimum-norm solution with the tolerances usual for dense arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 32


def triangle(m: np.ndarray) -> np.ndarray:
    """The R of m, or m itself if it has no more rows than columns."""
    return np.linalg.qr(m, mode="r") if m.shape[0] > m.shape[1] else m


def _block(key: tuple, width: int, r: np.ndarray) -> tuple:
    return (*key, width, r.shape[0], r.ravel().tolist())


def factors(rows: DataFrame, keys: Sequence[str], design: Sequence[str], levels: dict[str, list[str]], target: str) -> DataFrame:
    """(keys, width, height, r): one factor of [1? design dummies target] a group; ``rows`` has no NULL in what is read.

    The constant is the design column ``"1"``.  ``levels`` adds an indicator for every level of its columns,
    compared as strings; the solver drops what a group does not need.
    """
    width = len(design) + sum(map(len, levels.values())) + 1
    kinds = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    schema = T.StructType([*kinds, T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("r", T.ArrayType(T.DoubleType()))])
    numbers = [c for c in design if c != "1"]
    at = {c: {v: i for i, v in enumerate(vs)} for c, vs in levels.items()}

    def matrix(x: pd.DataFrame) -> np.ndarray:
        m = np.zeros((len(x), width))
        for i, c in enumerate(design):
            m[:, i] = 1.0 if c == "1" else x[c].to_numpy(dtype=float)
        j = len(design)
        for c, where in at.items():
            m[np.arange(len(x)), j + x[c].map(where).to_numpy()] = 1.0
            j += len(where)
        m[:, -1] = x[target].to_numpy(dtype=float)
        return m

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for x in batches:
            if not len(x):
                continue
            groups = x.groupby(list(keys), sort=False, dropna=False) if keys else [((), x)]
            for key, part in groups:
                key = tuple(v.item() if isinstance(v, np.generic) else v for v in key)
                r = triangle(matrix(part))
                held[key] = triangle(np.vstack([held[key], r])) if key in held else r
            if len(held) > 4096:
                yield _frame(held, keys, width, schema)
                held = {}
        if held:
            yield _frame(held, keys, width, schema)

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        r = triangle(np.vstack([np.asarray(v, float).reshape(h, width) for v, h in zip(x["r"], x["height"], strict=True)]))
        key = tuple(x[k].iloc[0] for k in keys)
        return pd.DataFrame([_block(key, width, r)], columns=schema.names)

    cols = [*keys, *dict.fromkeys([*numbers, *levels, target])]
    parts = rows.select(*cols).mapInPandas(local, schema).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    parts = parts.groupBy(*keys, "_part").applyInPandas(merge, schema)
    return parts.groupBy(*keys).applyInPandas(merge, schema)


def _frame(held: dict[tuple, np.ndarray], keys: Sequence[str], width: int, schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame([_block(k, width, r) for k, r in held.items()], columns=schema.names)


def minimum_norm(r: np.ndarray, n: int) -> tuple[np.ndarray, int, float]:
    """(beta, rank, ssr) of the least squares problem with factor r = [R_x | r_y] over n rows."""
    x, y = r[:, :-1], r[:, -1]
    k = x.shape[1]
    if not k:
        return np.zeros(0), 0, float(y @ y)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    eps = np.finfo(float).eps * max(n, k)
    top = s.max(initial=0.0)
    rank = int((s > top * eps).sum())
    beta = vt[:rank].T @ ((u[:, :rank].T @ y) / s[:rank])
    rest = y - x @ beta
    return beta, rank, float(rest @ rest)


def solve(
    rows: DataFrame, keys: Sequence[str], predictors: Sequence[str], levels: dict[str, list[str]], target: str,
    intercept: bool, name: str = "Intercept",
) -> DataFrame:
    """One row a group: keys, rank, parameters, ssr, sst, terms and estimates.

    Indicator terms are ``column_level``; of the levels that a group has, the first in string order is
    left out.
    """
    design = (["1"] if intercept else []) + list(predictors)
    got = factors(rows, keys, design, levels, target)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    same = [got[k].eqNullSafe(counts[k]) for k in keys]
    joined = got.join(counts, _all(same)) if keys else got.crossJoin(counts)
    joined = joined.select(*[got[k] for k in keys], "height", "width", "r", "_n")
    kinds = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    schema = T.StructType([
        *kinds, T.StructField("rank", T.IntegerType()), T.StructField("parameters", T.IntegerType()),
        T.StructField("ssr", T.DoubleType()), T.StructField("sst", T.DoubleType()),
        T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("betas", T.ArrayType(T.DoubleType())),
    ])
    terms = [name if c == "1" else c for c in design]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for row in x.to_dict("records"):
                r = np.asarray(row["r"], float).reshape(row["height"], row["width"])
                take, used, j = list(range(len(design))), list(terms), len(design)
                for c, vs in levels.items():
                    there = [i for i in range(len(vs)) if np.abs(r[:, j + i]).max(initial=0.0) > 1e-9]
                    for i in there[1:]:
                        take.append(j + i)
                        used.append(f"{c}_{vs[i]}")
                    j += len(vs)
                own = np.column_stack([r[:, take], r[:, -1]])
                beta, rank, ssr = minimum_norm(own, int(row["_n"]))
                sst = _centred(own) if intercept else float(own[:, -1] @ own[:, -1])
                out.append((*[row[k] for k in keys], rank, len(used), ssr, sst, used, beta.tolist()))
            if out:
                yield pd.DataFrame(out, columns=schema.names)

    return joined.mapInPandas(run, schema)


def _centred(r: np.ndarray) -> float:
    """Sum of squares of y about its mean, from a factor whose first column is the constant."""
    one, y = r[:, 0], r[:, -1]
    left = y - one * ((one @ y) / (one @ one))
    total = float(left @ left)
    return total if total > 1e-24 * float(y @ y) else 0.0


def _all(conditions):
    from ..functions.exprs import both

    return both(*conditions)
