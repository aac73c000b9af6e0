import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import exprs as X
from panelwright.operators import panel as P


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_duplicate_and_null_keys_are_refused(spark):
    with pytest.raises(ValueError, match="unique"):
        P.validate_panel(frame(spark, [(1, 2020), (1, 2020)], "firm int, fiscal_year int"))
    with pytest.raises(ValueError, match="non-missing"):
        P.validate_panel(frame(spark, [(1, None)], "firm int, fiscal_year int"))
    P.validate_panel(frame(spark, [(1, 2020), (2, 2020)], "firm int, fiscal_year int"))


def test_require_columns_names_what_is_absent(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        P.require_columns(frame(spark, [(1,)], "a int"), ("a", "b"))


def test_lag_does_not_cross_a_gap(spark):
    df = frame(spark, [("A", 2020, 10.0), ("A", 2022, 20.0), ("A", 2023, 30.0)], "firm string, fiscal_year int, x double")
    got = {r["fiscal_year"]: r["l"] for r in P.panel_lag(df, "x", "l").collect()}
    assert got == {2020: None, 2022: None, 2023: 20.0}
    free = {r["fiscal_year"]: r["l"] for r in P.panel_lag(df, "x", "l", require_consecutive=False).collect()}
    assert free == {2020: None, 2022: 10.0, 2023: 20.0}


def test_lag_by_two_rows_needs_the_year_between(spark):
    df = frame(spark, [("A", 2020, 1.0), ("A", 2022, 2.0), ("A", 2023, 3.0), ("A", 2024, 4.0)], "firm string, fiscal_year int, x double")
    got = {r["fiscal_year"]: r["l"] for r in P.panel_lag(df, "x", "l", periods=2).collect()}
    assert got == {2020: None, 2022: None, 2023: None, 2024: 2.0}


def test_lag_guards(spark):
    df = frame(spark, [("A", "FY1", 1.0)], "firm string, fiscal_year string, x double")
    with pytest.raises(ValueError, match="at least one"):
        P.panel_lag(df, "x", "l", periods=0)
    with pytest.raises(ValueError, match="numeric annual period"):
        P.panel_lag(df, "x", "l")
    assert P.panel_lag(df, "x", "l", require_consecutive=False).count() == 1
    text = frame(spark, [("A", "2020", 1.0), ("A", "2021", 2.0)], "firm string, fiscal_year string, x double")
    assert {r["l"] for r in P.panel_lag(text, "x", "l").collect()} == {None, 1.0}


def test_winsorize_by_group_keeps_nulls_and_null_groups(spark):
    rows = [(2020, 1.0), (2020, 1.0), (2020, 100.0), (2021, 10.0), (2021, 11.0), (2021, 200.0), (None, 5.0), (2022, None)]
    got = P.winsorize(frame(spark, rows, "y int, x double"), ("x",), by=("y",), lower=0.0, upper=0.5)
    assert got.groupBy("y").agg(F.max("x").alias("m")).orderBy("y").collect() == [(None, 5.0), (2020, 1.0), (2021, 11.0), (2022, None)]
    with pytest.raises(ValueError):
        P.winsorize(got, ("x",), lower=0.5, upper=0.5)


def test_winsorize_overall_is_linear_quantiles(spark):
    rng = random.Random(3)
    xs = [rng.gauss(0, 1) for _ in range(50)]
    got = sorted(r["x"] for r in P.winsorize(frame(spark, [(x,) for x in xs], "x double"), ("x",), lower=0.1, upper=0.9).collect())
    s = pd.Series(xs)
    want = sorted(s.clip(s.quantile(0.1), s.quantile(0.9)))
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-12


def test_numbers_from_text_and_not_finite(spark):
    rows = [("1.5",), (" 2 ",), ("1d",), ("inf",), ("nan",), ("x",), (None,), ("-3e2",)]
    df = frame(spark, rows, "v string")
    assert [r["n"] for r in df.select(X.num(df, "v").alias("n")).collect()] == [1.5, 2.0, None, None, None, None, None, -300.0]
    df = frame(spark, [(float("inf"),), (float("nan"),), (2.0,)], "v double")
    assert [r["n"] for r in df.select(X.num(df, "v").alias("n")).collect()] == [None, None, 2.0]


def test_average_rank_against_pandas(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([None, *range(8)])) for g in "abc" for _ in range(rng.choice([3, 9, 20]))] + [("one", 4), ("none", None)]
    rows = [(i, g, None if v is None else float(v)) for i, (g, v) in enumerate(rows)]
    df = frame(spark, rows, "i int, g string, v double")
    got = {r["i"]: r["r"] for r in df.select("i", X.rank01(F.col("v"), [F.col("g")]).alias("r")).collect()}
    pdf = pd.DataFrame(rows, columns=["i", "g", "v"])

    def scale(s):
        n = s.notna().sum()
        return s.where(s.isna(), 0.5) if n <= 1 else (s.rank() - 1) / (n - 1)

    for i, w in zip(pdf.i, pdf.groupby("g").v.transform(scale), strict=True):
        assert (got[i] is None and math.isnan(w)) or abs(got[i] - w) < 1e-12


def test_tiles_leave_nulls(spark):
    df = frame(spark, [(None,), (0.0,), (0.55,), (1.0,)], "r double")
    assert [r["t"] for r in df.select(X.tile01(F.col("r"), 10).alias("t")).collect()] == [None, 0.0, 5 / 9, 1.0]


def test_decile_cut_against_pandas(spark):
    sizes = [2, 3, 9, 10, 11, 37, 91, 171]
    rows = [(n, i, float((i * 7919) % n)) for n in sizes for i in range(n)] + [(1, 0, 5.0)]
    df = frame(spark, rows, "g int, i int, v double")
    got = {(r["g"], r["i"]): r["d"] for r in df.select("g", "i", X.decile_cut(F.col("v"), [F.col("g")], [F.col("i")]).alias("d")).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "i", "v"])
    for n in sizes:
        part = pdf[pdf.g == n]
        want = pd.qcut(part.v.rank(method="first"), 10, labels=False, duplicates="drop")
        assert [got[n, i] for i in part.i] == want.tolist(), n
    assert got[1, 0] is None


def test_interaction(spark):
    got = P.add_interaction(frame(spark, [(2.0, 3.0), (None, 1.0)], "x double, z double"), "x", "z").collect()
    assert [r["x_x_z"] for r in got] == [6.0, None]


def test_public_names():
    import panelwright

    assert len(panelwright.__all__) == 26 and sorted(panelwright.__all__) == list(panelwright.__all__)
    assert all(getattr(panelwright, n) is not None for n in panelwright.__all__)
