"""Labor-investment measures and hiring categories."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .panel import require_columns, require_numeric_period, validate_panel


@dataclass(frozen=True)
class LaborColumns:
    firm: str = "firm"
    period: str = "fiscal_year"
    industry: str = "industry"
    employees: str = "employees"
    sales: str = "sales"
    assets: str = "assets"
    net_income: str = "net_income"
    stock_return: str = "stock_return"
    market_equity: str = "market_equity"
    quick_assets: str = "quick_assets"
    current_liabilities: str = "current_liabilities"
    debt_current: str = "debt_current"
    long_term_debt: str = "debt_long"


LOSS_BINS, LOSS_STEP = 5, 0.005


def add_labor_inputs(df: DataFrame, columns: LaborColumns = LaborColumns(), require_consecutive: bool = True, validate: bool = True) -> DataFrame:
    """``df`` plus all ``ie_labor_*`` inputs: lags of one firm window in three layers, then a rank by period."""
    c = columns
    require_columns(df, astuple(c), "labor panel")
    if validate:
        validate_panel(df, c.firm, c.period)
    if require_consecutive:
        require_numeric_period(df, c.period)
    names = [k for k in c.__dataclass_fields__ if k not in ("firm", "industry")]
    x = df.select("*", *[X.num(df, getattr(c, k)).alias(f"_{k}") for k in names])
    lag = lambda e: X.lag(e, c.firm, "_period", 1, require_consecutive)
    col = lambda k: F.col(f"_{k}")
    x = x.select(
        "*", *[lag(col(k)).alias(f"_l_{k}") for k in ("employees", "sales", "assets", "market_equity")],
        X.ratio(col("quick_assets"), col("current_liabilities")).alias("ie_labor_quick"),
        X.ratio(col("debt_current") + col("long_term_debt"), col("assets")).alias("_leverage"),
    )
    back = lambda k: F.col(f"_l_{k}")
    x = x.select(
        "*",
        X.ratio(col("employees") - back("employees"), back("employees")).alias("ie_labor_net_hire"),
        X.ratio(col("sales") - back("sales"), back("sales")).alias("ie_labor_sales_growth"),
        X.ratio(col("net_income"), back("assets")).alias("ie_labor_roa"),
        col("stock_return").alias("ie_labor_return"),
        F.when(back("market_equity") > 0, F.ln(back("market_equity"))).alias("_size"),
        lag(F.col("ie_labor_quick")).alias("ie_labor_quick_lag"),
        lag(F.col("_leverage")).alias("ie_labor_leverage_lag"),
    )
    roa, quick = F.col("ie_labor_roa"), F.col("ie_labor_quick")
    x = x.select("*", lag(roa).alias("_roa_lag"), lag(F.col("ie_labor_sales_growth")).alias("ie_labor_sales_growth_lag"))
    x = x.select(
        "*", (roa - F.col("_roa_lag")).alias("ie_labor_delta_roa"),
        X.ratio(quick - F.col("ie_labor_quick_lag"), F.col("ie_labor_quick_lag")).alias("ie_labor_delta_quick"),
    )
    bins = []
    for k in range(1, LOSS_BINS + 1):
        inside = (F.col("_roa_lag") < -LOSS_STEP * (k - 1)) & (F.col("_roa_lag") >= -LOSS_STEP * k)
        bins.append(F.when(F.col("_roa_lag").isNotNull(), inside.cast("double")).alias(f"ie_labor_loss_bin{k}_lag"))
    x = x.select(
        "*", lag(F.col("ie_labor_delta_roa")).alias("ie_labor_delta_roa_lag"), lag(F.col("ie_labor_delta_quick")).alias("ie_labor_delta_quick_lag"), *bins
    )
    key = F.col(f"`{c.period}`")
    x = x.withColumn("ie_labor_size_rank_lag", F.when(key.isNotNull(), X.rank01(F.col("_size"), [key])))
    return x.drop(*[k for k in x.columns if k.startswith("_") and k not in df.columns])


def add_labor_categories(df: DataFrame, net_hire: str = "ie_labor_net_hire") -> DataFrame:
    """Abnormal net hiring, its size, and whether too much or too little was hired or fired."""
    r, actual = F.col("ie_labor_residual"), X.num(df, net_hire)
    kind = (
        F.when(r.isNull(), None)
        .when((r > 0) & (actual >= 0), "over_hiring").when((r > 0) & (actual < 0), "under_firing")
        .when((r < 0) & (actual >= 0), "under_hiring").when((r < 0) & (actual < 0), "over_firing")
        .otherwise("on_expected")
    )
    return df.withColumns({
        "ie_labor_abnormal_net_hiring": r,
        "ie_labor_absolute_abnormal_net_hiring": F.abs(r),
        "ie_labor_inefficiency_type": kind,
    })
