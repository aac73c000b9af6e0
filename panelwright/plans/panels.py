"""Entity-by-year panels from the star-schema tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Measures of a year of line items (portable SQL); conditional sums leave NULL where nothing qualifies.
MEASURES = {
    "sales": "sum(l_extendedprice)",
    "assets": "sum(l_quantity) * 1000",
    "ppe": "sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) * 500",
    "capex": "sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) * 0.1",
    "rd": "sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount END)",
    "acquisitions": "sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice * l_tax END)",
    "sale_ppe": "sum(CASE WHEN l_linenumber = 5 THEN l_extendedprice END) * 0.01",
    "depreciation": "sum(l_extendedprice * l_tax)",
    "operating_cash_flow": "sum(l_extendedprice * (l_discount - 0.04))",
    "net_income": "sum(l_extendedprice * (l_tax - 0.03))",
    "cash": "sum(CASE WHEN l_linenumber = 1 THEN l_quantity END) * 100",
    "debt_current": "sum(CASE WHEN l_linenumber = 2 THEN l_quantity END) * 80",
    "debt_long": "sum(CASE WHEN l_linenumber = 3 THEN l_quantity END) * 120",
    "book_equity": "sum(l_quantity) * 400",
    "market_equity": "sum(l_extendedprice) * 0.02",
    "stock_return": "avg(l_discount) - 0.05",
    "operating_income_after_depreciation": "sum(l_extendedprice * l_discount)",
    "dividends": "sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END)",
    "employees": "count(*) + sum(l_quantity) / 10",
    "quick_assets": "sum(CASE WHEN l_linenumber <= 2 THEN l_extendedprice END)",
    "current_liabilities": "sum(CASE WHEN l_linenumber >= 2 THEN l_extendedprice END)",
}
SHAPES = {
    "customer": ("o_custkey", "c_mktsegment"),
    "part": ("l_partkey", "p_brand"),
    "supplier": ("l_suppkey", "s_nationkey"),
}


def firm_panel(spark: SparkSession, sf_dir: str, kind: str = "customer") -> DataFrame:
    """(firm, fiscal_year, industry, measures): rows aggregate before the dimension is joined."""
    key, industry = SHAPES[kind]
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("lineitem")
    if kind == "customer":
        rows = rows.join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    panel = rows.groupBy(F.col(key).alias("firm"), F.year("l_shipdate").alias("fiscal_year")).agg(
        *[F.expr(f"round({e}, 8)").alias(k) for k, e in MEASURES.items()]
    )
    letter = kind[0]
    dim = read(kind).select(F.col(f"{letter}_{'cust' if kind == 'customer' else kind[:4] if kind == 'part' else 'supp'}key").alias("firm"), F.col(industry).alias("industry"))
    return panel.join(dim, "firm")


def panel_sql(kind: str = "customer") -> str:
    """Body of a CTE with the same rows."""
    key, industry = SHAPES[kind]
    own = {"customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}[kind]
    measures = ", ".join(f"round({e}, 8) AS {k}" for k, e in MEASURES.items())
    source = "lineitem JOIN orders ON l_orderkey = o_orderkey" if kind == "customer" else "lineitem"
    return (
        f"SELECT a.*, {industry} AS industry FROM (SELECT {key} AS firm, year(l_shipdate) AS fiscal_year, {measures} "
        f"FROM {source} GROUP BY 1, 2) a JOIN {kind} ON a.firm = {own}"
    )
