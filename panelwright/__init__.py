"""Entity-by-period panel analytics on Spark DataFrames.

The names below are the whole public interface of measures and estimators; modules hold the rest.
"""

from pyspark.sql import Column

from .functions.exprs import ratio as _ratio
from .operators.capital import CapitalColumns, add_overinvestment_likelihood, cash_flow_sensitivity_index
from .operators.capital import add_capital_inputs as add_capital_investment_inputs
from .operators.capital import value_to_price as ohlson_value_to_price
from .operators.labor import LaborColumns
from .operators.labor import add_labor_inputs as add_labor_investment_inputs
from .operators.panel import add_interaction, panel_lag, validate_panel, winsorize
from .operators.regress import Fit as ExpectedInvestmentResult
from .operators.regress import add_residual_metrics
from .operators.regress import fit as fit_expected_investment
from .plans.specs import SPECIFICATIONS, Specification, get_specification, list_specifications
from .plans.specs import fit_asymmetric_growth as estimate_chen_2011
from .plans.specs import fit_net_hiring as estimate_jlw_2014
from .plans.specs import fit_new_investment as estimate_richardson_2006
from .plans.specs import fit_ppe_growth as estimate_enomoto_2024
from .plans.specs import fit_q_cash_flow as estimate_bh_2006_q_cash_flow
from .plans.specs import fit_ranked_q as estimate_mcnichols_stubben_2008
from .plans.specs import fit_sales_growth as estimate_bhv_2009

__version__ = "0.1.0"


def safe_divide(numerator: Column, denominator: Column, require_positive_denominator: bool = False) -> Column:
    """The ratio of two numeric columns; null where the denominator is zero (or not positive) and on overflow."""
    return _ratio(numerator, denominator, require_positive_denominator)


#: The public names.
__all__ = [
    "CapitalColumns", "ExpectedInvestmentResult", "LaborColumns", "SPECIFICATIONS", "Specification", "add_capital_investment_inputs", "add_interaction",
    "add_labor_investment_inputs", "add_overinvestment_likelihood", "add_residual_metrics", "cash_flow_sensitivity_index", "estimate_bh_2006_q_cash_flow",
    "estimate_bhv_2009", "estimate_chen_2011", "estimate_enomoto_2024", "estimate_jlw_2014", "estimate_mcnichols_stubben_2008", "estimate_richardson_2006",
    "fit_expected_investment", "get_specification", "list_specifications", "ohlson_value_to_price", "panel_lag", "safe_divide", "validate_panel", "winsorize",
]
