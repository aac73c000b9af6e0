"""Registered queries over the driver's tables and their SQL.

Doubles are rounded on both sides; keys and labels are compared as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..operators import capital, labor, panel as P, regress
from . import specs
from .panels import firm_panel, panel_sql

KEYS = ("firm", "fiscal_year")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, negative zero made plain."""
    cols = [(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema]
    return df.select(*cols)


def measured(spark: SparkSession, sf_dir: str, kind: str = "customer") -> DataFrame:
    """The panel with its capital measures; keys are unique by construction, so nothing is validated again."""
    return capital.add_capital_inputs(firm_panel(spark, sf_dir, kind), validate=False)


def _lagged(c: str) -> str:
    return f"CASE WHEN fiscal_year - lag(fiscal_year) OVER w = 1 THEN lag({c}) OVER w END"


def _sdiv(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) END"


#: The capital measures in SQL over a panel p with raw lags la, ls, lp; missing flows and stocks are zero.
_RATIOS = {
    "inv_bhv_total": _sdiv("spend", "la"),
    "inv_richardson_new": _sdiv("spend - dep", "(assets + la) / 2"),
    "inv_enomoto_ppe": _sdiv("ppe - lp + dep", "la"),
    "inv_bh_fixed_assets": _sdiv("ppe - lp + dep", "lp"),
    "inv_ms_capex": _sdiv("capex", "lp"),
    "sales_growth": _sdiv("sales - ls", "ls"),
    "asset_growth": _sdiv("assets - la", "la"),
    "asset_growth_log": "CASE WHEN la > 0 AND assets > 0 THEN ln(assets / la) END",
    "size_log_assets": "CASE WHEN assets > 0 THEN ln(assets) END",
    "operating_cash_flow_assets": _sdiv("operating_cash_flow", "la"),
    "cash_flow_net_capital": _sdiv("net_income + dep", "lp"),
    "cash_flow_ms_net_capital": _sdiv("operating_cash_flow", "lp"),
    "cash_assets": _sdiv("cash", "assets"),
    "leverage_assets": _sdiv("dc + dl", "assets"),
    "leverage_capital": _sdiv("dc + dl", "dc + dl + book_equity"),
    "market_leverage_long_debt": _sdiv("dl", "dl + market_equity"),
    "market_leverage_total_debt": _sdiv("dc + dl", "dc + dl + market_equity"),
    "tobin_q": _sdiv("market_equity + dc + dl", "assets"),
    "tobin_q_ms": _sdiv("market_equity + assets - book_equity", "assets"),
    "market_to_book": _sdiv("market_equity", "book_equity"),
    "firm_age_log": "ln(1 + fiscal_year - first)",
    "value_to_price": _sdiv("(1 - 1.24 * 0.12) * book_equity + 1.24 * 1.12 * operating_income_after_depreciation - 1.24 * 0.12 * div", "market_equity"),
}
_ALL = (*_RATIOS, "stock_return")


def _measured_sql(kind: str = "customer") -> str:
    """CTEs p, q, m: panel, raw lags, measures with the lags ``<name>_lag``."""
    made = ", ".join(f"{e} AS m_{k}" for k, e in _RATIOS.items())
    lags = ", ".join(f"{_lagged('m_' + k)} AS m_{k}_lag" for k in capital.LAGGED)
    return f"""
p AS ({panel_sql(kind)}),
q AS (
  SELECT *, {_lagged('assets')} AS la, {_lagged('sales')} AS ls, {_lagged('ppe')} AS lp, min(fiscal_year) OVER (PARTITION BY firm) AS first,
         capex + coalesce(rd, 0) + coalesce(acquisitions, 0) - coalesce(sale_ppe, 0) AS spend, coalesce(depreciation, 0) AS dep,
         coalesce(debt_current, 0) AS dc, coalesce(debt_long, 0) AS dl, coalesce(dividends, 0) AS div
  FROM p WINDOW w AS (PARTITION BY firm ORDER BY fiscal_year)),
m0 AS (SELECT *, {made}, stock_return AS m_stock_return FROM q),
m AS (SELECT *, {lags} FROM m0 WINDOW w AS (PARTITION BY firm ORDER BY fiscal_year))"""


def _r(e: str, name: str, digits: int = 9) -> str:
    return f"round({e}, {digits}) + 0.0 AS {name}"


# ---- measures -------------------------------------------------------------------------------


def q_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firm_panel(spark, sf_dir, "customer").select("firm", "fiscal_year", "industry", "sales", "assets", "ppe", "rd", "dividends")


def q_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = measured(spark, sf_dir)
    return rounded(got.select(*KEYS, *[f"ie_{k}" for k in _ALL], *[f"ie_{k}_lag" for k in capital.LAGGED]))


def q_capital_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = measured(spark, sf_dir)
    return got.groupBy("fiscal_year").agg(
        F.count("*").alias("n"), *[F.sum(F.col(f"ie_missing_{k}").cast("long")).alias(f"missing_{k}") for k in (*capital.FLOWS, *capital.STOCKS)],
        F.count("ie_inv_bhv_total").alias("n_bhv"),
    )


def q_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = capital.add_capital_inputs(firm_panel(spark, sf_dir), missing_components="propagate", missing_dividends="propagate", validate=False)
    return rounded(got.select(*KEYS, "ie_inv_bhv_total", "ie_leverage_assets", "ie_value_to_price"))


def q_lag2(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.panel_lag(firm_panel(spark, sf_dir), "sales", "sales_lag2", periods=2, validate=False)
    return got.select(*KEYS, "sales_lag2")


def q_lag_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.panel_lag(firm_panel(spark, sf_dir), "sales", "sales_before", require_consecutive=False, validate=False)
    return got.select(*KEYS, "sales_before")


def q_winsor_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.winsorize(firm_panel(spark, sf_dir).select(*KEYS, "sales", "ppe"), ("sales", "ppe"), by=("fiscal_year",), lower=0.05, upper=0.95)
    return rounded(got, 6)


def q_winsor_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.winsorize(firm_panel(spark, sf_dir).select(*KEYS, "sales"), ("sales",)), 6)


def q_rank01(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = firm_panel(spark, sf_dir)
    return rounded(p.select(*KEYS, X.rank01(F.col("ppe"), [F.col("fiscal_year")]).alias("ppe_rank")))


def q_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.add_interaction(firm_panel(spark, sf_dir), "stock_return", "employees").select(*KEYS, "stock_return_x_employees"))


def q_overinvestment(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = capital.add_overinvestment_likelihood(measured(spark, sf_dir))
    return rounded(got.select(*KEYS, "ie_overinvestment_likelihood"))


def q_cfsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = capital.cash_flow_sensitivity_index(measured(spark, sf_dir), window=4, min_periods=2, validate=False)
    return rounded(got.select(*KEYS, "ie_cfsi"))


def q_labor(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = labor.add_labor_inputs(firm_panel(spark, sf_dir), validate=False)
    return rounded(got.select(*KEYS, "ie_labor_net_hire", *specs.HIRING))


# ---- estimators -----------------------------------------------------------------------------


def _coefficients(got: regress.Fit, *keys: str) -> DataFrame:
    return rounded(got.coefficients.select(*keys, "term", "estimate", "n"), 6)


def q_bhv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(specs.fit_sales_growth(measured(spark, sf_dir, "part")), "industry", "fiscal_year")


def q_bhv_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = specs.fit_sales_growth(measured(spark, sf_dir, "part")).diagnostics
    return rounded(d.select("industry", "fiscal_year", "status", "n", "rank", "parameters", "residual_df", "r2", "adj_r2"), 6)


def q_bhv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = specs.fit_sales_growth(measured(spark, sf_dir)).panel
    names = ("expected", "residual", "inefficiency", "overinvestment", "underinvestment", "overinvestment_indicator", "residual_rank", "residual_group", "efficient_below_median")
    return rounded(got.select(*KEYS, *[f"ie_{k}" for k in names]), 6)


def q_ppe_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(specs.fit_ppe_growth(measured(spark, sf_dir)), "industry", "fiscal_year")


def q_asymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(specs.fit_asymmetric_growth(measured(spark, sf_dir)), "industry", "fiscal_year")


def q_q_cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = specs.fit_q_cash_flow(measured(spark, sf_dir).withColumnRenamed("industry", "country"))
    return _coefficients(got, "country")


def q_ranked_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(specs.fit_ranked_q(measured(spark, sf_dir)), "industry", "fiscal_year")


def q_ranked_q_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(specs.fit_ranked_q(measured(spark, sf_dir), augmented=True), "industry", "fiscal_year")


def q_new_investment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(specs.fit_new_investment(measured(spark, sf_dir)))


def q_net_hiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(specs.fit_net_hiring(labor.add_labor_inputs(firm_panel(spark, sf_dir), validate=False)))


def q_hiring_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = specs.fit_net_hiring(labor.add_labor_inputs(firm_panel(spark, sf_dir), validate=False)).panel
    return got.groupBy("fiscal_year", "ie_labor_inefficiency_type").agg(F.count("*").alias("n"))


def q_small_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = specs.fit_sales_growth(measured(spark, sf_dir, "supplier")).diagnostics
    return d.groupBy("status").agg(F.count("*").alias("cells"), F.sum("n").alias("n"))


def q_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = T.StructType([T.StructField(k, T.IntegerType() if k == "year" else T.StringType()) for k in specs.Specification.__dataclass_fields__])
    return spark.createDataFrame([tuple(r.values()) for r in specs.list_specifications()], fields)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lagged-growth regressions by industry and year over the customer panel."""
    return _coefficients(specs.fit_sales_growth(measured(spark, sf_dir)), "industry", "fiscal_year")


def _cells_sql(outcome: str, kind: str) -> str:
    return f"""
WITH {_measured_sql(kind)},
c AS (
  SELECT industry, fiscal_year, count(*) AS n, regr_slope(m_{outcome}, m_sales_growth_lag) AS b, regr_intercept(m_{outcome}, m_sales_growth_lag) AS a
  FROM m WHERE m_{outcome} IS NOT NULL AND m_sales_growth_lag IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT industry, fiscal_year, 'Intercept' AS term, {_r('a', 'estimate', 6)}, n FROM c
UNION ALL SELECT industry, fiscal_year, 'ie_sales_growth_lag', {_r('b', 'estimate', 6)}, n FROM c"""


def _rank_sql(c: str, by: str) -> str:
    k = f"PARTITION BY {by}, {c} IS NULL"
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN count(*) OVER ({k}) = 1 THEN 0.5 "
        f"ELSE (rank() OVER ({k} ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / (count(*) OVER ({k}) - 1) END"
    )


def _two_predictors(y: str, x: str, z: str, names: tuple[str, str], keys: str, source: str) -> str:
    """Normal equations of two predictors, solved in closed form from centred sums."""
    return f"""
s AS (
  SELECT {keys}, count(*) AS n, avg({y}) AS my, avg({x}) AS mx, avg({z}) AS mz, covar_pop({x}, {x}) AS xx, covar_pop({z}, {z}) AS zz,
         covar_pop({x}, {z}) AS xz, covar_pop({y}, {x}) AS yx, covar_pop({y}, {z}) AS yz FROM {source} GROUP BY {keys} HAVING count(*) >= 20),
b AS (SELECT *, (yx * zz - yz * xz) / (xx * zz - xz * xz) AS b1, (yz * xx - yx * xz) / (xx * zz - xz * xz) AS b2 FROM s)
SELECT {keys}, '{names[0]}' AS term, {_r('b1', 'estimate', 6)}, n FROM b
UNION ALL SELECT {keys}, '{names[1]}', {_r('b2', 'estimate', 6)}, n FROM b"""


_W = "WINDOW w AS (PARTITION BY firm ORDER BY fiscal_year)"
_WITH = f"WITH p AS ({panel_sql()})"


def _sql() -> dict[str, str]:
    out = {
        "panel_customer": f"{_WITH} SELECT firm, fiscal_year, industry, sales, assets, ppe, rd, dividends FROM p",
        "capital_measures": f"WITH {_measured_sql()} SELECT firm, fiscal_year, "
        + ", ".join([_r(f"m_{k}", f"ie_{k}") for k in _ALL] + [_r(f"m_{k}_lag", f"ie_{k}_lag") for k in capital.LAGGED]) + " FROM m",
        "capital_flags": f"WITH {_measured_sql()} SELECT fiscal_year, count(*) AS n, "
        + ", ".join(f"sum(CASE WHEN {k} IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_{k}" for k in (*capital.FLOWS, *capital.STOCKS))
        + ", count(m_inv_bhv_total) AS n_bhv FROM m GROUP BY 1",
        "capital_propagate": f"WITH {_measured_sql()} SELECT firm, fiscal_year, "
        + ", ".join([_r(_sdiv("capex + rd + acquisitions - sale_ppe", "la"), "ie_inv_bhv_total"), _r(_sdiv("debt_current + debt_long", "assets"), "ie_leverage_assets"),
                     _r(_RATIOS["value_to_price"].replace("* div", "* dividends"), "ie_value_to_price")]) + " FROM m",
        "lag_two_periods": f"{_WITH} SELECT firm, fiscal_year, CASE WHEN fiscal_year - lag(fiscal_year, 2) OVER w = 2 THEN lag(sales, 2) OVER w END AS sales_lag2 FROM p {_W}",
        "lag_across_gaps": f"{_WITH} SELECT firm, fiscal_year, lag(sales) OVER w AS sales_before FROM p {_W}",
        "winsorize_by_year": f"{_WITH}, e AS (SELECT fiscal_year AS y, quantile_cont(sales, 0.05) AS sl, quantile_cont(sales, 0.95) AS sh, quantile_cont(ppe, 0.05) AS pl, quantile_cont(ppe, 0.95) AS ph FROM p GROUP BY 1) "
        f"SELECT firm, fiscal_year, {_r('greatest(least(sales, sh), sl)', 'sales', 6)}, CASE WHEN ppe IS NOT NULL THEN round(greatest(least(ppe, ph), pl), 6) + 0.0 END AS ppe FROM p JOIN e ON y = fiscal_year",
        "winsorize_all": f"{_WITH}, e AS (SELECT quantile_cont(sales, 0.01) AS sl, quantile_cont(sales, 0.99) AS sh FROM p) SELECT firm, fiscal_year, {_r('greatest(least(sales, sh), sl)', 'sales', 6)} FROM p, e",
        "rank_zero_one": f"{_WITH} SELECT firm, fiscal_year, {_r(_rank_sql('ppe', 'fiscal_year'), 'ppe_rank')} FROM p",
        "interaction": f"{_WITH} SELECT firm, fiscal_year, {_r('stock_return * employees', 'stock_return_x_employees')} FROM p",
        "overinvestment_likelihood": f"WITH {_measured_sql()}, r AS (SELECT firm, fiscal_year, {_rank_sql('m_cash_assets', 'fiscal_year')} AS a, {_rank_sql('(-m_market_leverage_long_debt)', 'fiscal_year')} AS b FROM m) "
        f"SELECT firm, fiscal_year, {_r('CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (least(floor(a * 10), 9) / 9.0 + least(floor(b * 10), 9) / 9.0) / 2 END', 'ie_overinvestment_likelihood')} FROM r",
        "cash_flow_sensitivity": f"WITH {_measured_sql()}, v AS (SELECT firm, fiscal_year, m_inv_ms_capex AS i, greatest(m_cash_flow_net_capital, 0) AS c, m_inv_ms_capex IS NOT NULL AND m_cash_flow_net_capital IS NOT NULL AS ok FROM m), "
        "g AS (SELECT firm, fiscal_year, ok, count(CASE WHEN ok THEN 1 END) OVER w AS n, sum(CASE WHEN ok THEN c END) OVER w AS t, sum(CASE WHEN ok THEN c * i END) OVER w AS s, avg(CASE WHEN ok THEN i END) OVER w AS a, "
        "max(CASE WHEN ok THEN fiscal_year END) OVER w - min(CASE WHEN ok THEN fiscal_year END) OVER w + 1 AS y FROM v WINDOW w AS (PARTITION BY firm ORDER BY fiscal_year ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) "
        f"SELECT firm, fiscal_year, {_r('CASE WHEN ok AND n >= 2 AND t > 0 AND y = n THEN s / t - a END', 'ie_cfsi')} FROM g",
        "bhv_coefficients": _cells_sql("inv_bhv_total", "part"),
        "ppe_growth_coefficients": _cells_sql("inv_enomoto_ppe", "customer"),
        "flagship": _cells_sql("inv_bhv_total", "customer"),
    }
    d_cells = """
d AS (
  SELECT industry, fiscal_year, count(*) FILTER (WHERE m_inv_bhv_total IS NOT NULL AND m_sales_growth_lag IS NOT NULL) AS n,
         regr_r2(m_inv_bhv_total, m_sales_growth_lag) AS r2 FROM m GROUP BY 1, 2)"""
    out["bhv_diagnostics"] = f"""
WITH {_measured_sql('part')}, {d_cells}
SELECT industry, fiscal_year, CASE WHEN n < 20 THEN 'small_cell' ELSE 'estimated' END AS status, n, CASE WHEN n < 20 THEN 0 ELSE 2 END AS rank,
       CASE WHEN n < 20 THEN 0 ELSE 2 END AS parameters, CASE WHEN n >= 20 THEN (n - 2)::DOUBLE END AS residual_df,
       CASE WHEN n >= 20 THEN round(r2, 6) + 0.0 END AS r2, CASE WHEN n >= 20 THEN round(1 - (1 - r2) * (n - 1) / (n - 2), 6) + 0.0 END AS adj_r2 FROM d"""
    out["small_cells"] = f"""
WITH {_measured_sql('supplier')}, {d_cells}
SELECT CASE WHEN n < 20 THEN 'small_cell' ELSE 'estimated' END AS status, count(*) AS cells, sum(n)::BIGINT AS n FROM d GROUP BY 1"""
    out["bhv_metrics"] = f"""
WITH {_measured_sql()},
c AS (
  SELECT industry, fiscal_year, regr_slope(m_inv_bhv_total, m_sales_growth_lag) AS b, regr_intercept(m_inv_bhv_total, m_sales_growth_lag) AS a
  FROM m WHERE m_inv_bhv_total IS NOT NULL AND m_sales_growth_lag IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20),
e AS (SELECT firm, fiscal_year, a + b * m_sales_growth_lag AS x, m_inv_bhv_total - (a + b * m_sales_growth_lag) AS r FROM m LEFT JOIN c USING (industry, fiscal_year)),
k AS (SELECT *, {_rank_sql('r', 'fiscal_year')} AS rk, median(abs(r)) OVER (PARTITION BY fiscal_year) AS md FROM e)
SELECT firm, fiscal_year, CASE WHEN r IS NOT NULL THEN round(x, 6) + 0.0 END AS ie_expected, {_r('r', 'ie_residual', 6)}, {_r('abs(r)', 'ie_inefficiency', 6)},
       CASE WHEN r IS NOT NULL THEN round(greatest(r, 0), 6) + 0.0 END AS ie_overinvestment, CASE WHEN r IS NOT NULL THEN round(greatest(-r, 0), 6) + 0.0 END AS ie_underinvestment,
       CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END AS ie_overinvestment_indicator, {_r('rk', 'ie_residual_rank', 6)},
       CASE WHEN r IS NULL THEN NULL WHEN rk <= 0.25 THEN 'under' WHEN rk >= 0.75 THEN 'over' ELSE 'benchmark' END AS ie_residual_group,
       CASE WHEN r IS NULL THEN NULL WHEN abs(r) < md THEN 1.0 ELSE 0.0 END AS ie_efficient_below_median FROM k"""
    part = lambda sign: f"regr_slope(m_inv_bhv_total, m_sales_growth_lag) FILTER (WHERE m_sales_growth_lag {sign} 0)"
    inter = lambda sign: f"regr_intercept(m_inv_bhv_total, m_sales_growth_lag) FILTER (WHERE m_sales_growth_lag {sign} 0)"
    out["asymmetric_coefficients"] = f"""
WITH {_measured_sql()},
c AS (
  SELECT industry, fiscal_year, count(*) AS n, {part('>=')} AS b1, {part('<')} AS b0, {inter('>=')} AS a1, {inter('<')} AS a0
  FROM m WHERE m_inv_bhv_total IS NOT NULL AND m_sales_growth_lag IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT industry, fiscal_year, 'Intercept' AS term, {_r('a1', 'estimate', 6)}, n FROM c UNION ALL
SELECT industry, fiscal_year, 'ie_negative_sales_growth', {_r('a0 - a1', 'estimate', 6)}, n FROM c UNION ALL
SELECT industry, fiscal_year, 'ie_sales_growth_lag', {_r('b1', 'estimate', 6)}, n FROM c UNION ALL
SELECT industry, fiscal_year, 'ie_negative_x_sales_growth', {_r('b0 - b1', 'estimate', 6)}, n FROM c"""
    out["q_cash_flow_coefficients"] = f"""
WITH {_measured_sql()},
t AS (SELECT industry AS country, firm, atan(m_inv_bh_fixed_assets) AS y, atan(m_cash_flow_net_capital) AS x, CASE WHEN m_tobin_q_lag > 0 THEN ln(m_tobin_q_lag) END AS z FROM m),
u AS (SELECT *, count(*) OVER (PARTITION BY country, firm) AS k FROM t WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL),
v AS (SELECT country, y - avg(y) OVER f AS y, x - avg(x) OVER f AS x, z - avg(z) OVER f AS z FROM u WHERE k > 1 WINDOW f AS (PARTITION BY country, firm)),
{_two_predictors('y', 'x', 'z', ('ie_bh_cash_flow_atan', 'ie_bh_q_log'), 'country', 'v')}"""
    ranks = {"y": "m_inv_ms_capex", "x": "m_tobin_q_ms_lag", "z": "m_cash_flow_ms_net_capital"}
    out["ranked_q_coefficients"] = f"""
WITH {_measured_sql()},
t AS (SELECT * FROM m WHERE m_inv_ms_capex IS NOT NULL AND m_tobin_q_ms_lag IS NOT NULL AND m_cash_flow_ms_net_capital IS NOT NULL),
v AS (SELECT industry, fiscal_year, {', '.join(f"{_rank_sql(c, 'industry, fiscal_year')} AS {k}" for k, c in ranks.items())} FROM t),
{_two_predictors('y', 'x', 'z', ('ie_tobin_q_ms_lag', 'ie_cash_flow_ms_net_capital'), 'industry, fiscal_year', 'v')}
UNION ALL SELECT industry, fiscal_year, 'Intercept', {_r('my - b1 * mx - b2 * mz', 'estimate', 6)}, n FROM b"""
    lag = _lagged
    bins = ", ".join(f"CASE WHEN rl IS NULL THEN NULL WHEN rl < {-0.005 * (k - 1)!r} AND rl >= {-0.005 * k!r} THEN 1.0 ELSE 0.0 END AS ie_labor_loss_bin{k}_lag" for k in range(1, 6))
    named = ("sales_growth_lag", "sales_growth", "delta_roa", "delta_roa_lag", "roa", "return", "quick_lag", "delta_quick_lag", "delta_quick", "leverage_lag")
    out["labor_measures"] = f"""
{_WITH},
a AS (SELECT *, {lag('employees')} AS le, {lag('sales')} AS ls, {lag('assets')} AS la, {lag('market_equity')} AS lm, {_sdiv('quick_assets', 'current_liabilities')} AS quick,
             {_sdiv('debt_current + debt_long', 'assets')} AS lev FROM p {_W}),
b AS (SELECT *, {_sdiv('employees - le', 'le')} AS net_hire, {_sdiv('sales - ls', 'ls')} AS sales_growth, {_sdiv('net_income', 'la')} AS roa, {lag('quick')} AS quick_lag,
             {lag('lev')} AS leverage_lag, CASE WHEN lm > 0 THEN ln(lm) END AS size FROM a {_W}),
c AS (SELECT *, {lag('roa')} AS rl, {lag('sales_growth')} AS sales_growth_lag, {_sdiv('quick - quick_lag', 'quick_lag')} AS delta_quick FROM b {_W}),
d AS (SELECT *, roa - rl AS delta_roa FROM c),
e AS (SELECT *, {lag('delta_roa')} AS delta_roa_lag, {lag('delta_quick')} AS delta_quick_lag, stock_return AS "return" FROM d {_W})
SELECT firm, fiscal_year, {_r('net_hire', 'ie_labor_net_hire')}, {', '.join(_r(f'"{k}"', f'ie_labor_{k}') for k in named)}, {bins}, {_r(_rank_sql('size', 'fiscal_year'), 'ie_labor_size_rank_lag')} FROM e"""
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import accruals, artifacts

    own = {
        "flagship": flagship, "panel_customer": q_panel, "capital_measures": q_capital, "capital_flags": q_capital_flags, "capital_propagate": q_propagate,
        "lag_two_periods": q_lag2, "lag_across_gaps": q_lag_gaps, "winsorize_by_year": q_winsor_year, "winsorize_all": q_winsor_all,
        "rank_zero_one": q_rank01, "interaction": q_interaction, "overinvestment_likelihood": q_overinvestment, "cash_flow_sensitivity": q_cfsi,
        "labor_measures": q_labor, "bhv_coefficients": q_bhv, "bhv_diagnostics": q_bhv_diagnostics, "bhv_metrics": q_bhv_metrics,
        "ppe_growth_coefficients": q_ppe_growth, "asymmetric_coefficients": q_asymmetric, "q_cash_flow_coefficients": q_q_cash_flow,
        "ranked_q_coefficients": q_ranked_q, "ranked_q_augmented_coefficients": q_ranked_q_augmented, "new_investment_coefficients": q_new_investment,
        "net_hiring_coefficients": q_net_hiring, "hiring_types": q_hiring_types, "small_cells": q_small_cells, "registry": q_registry,
    }
    return own | accruals.queries() | artifacts.queries()


def oracle_sql() -> dict[str, str]:
    from . import accruals, artifacts

    return _sql() | accruals.oracle_sql() | artifacts.oracle_sql()
