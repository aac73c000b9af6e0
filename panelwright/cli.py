"""Command line: list specifications, prepare measures, fit a specification."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators.capital import POLICIES, add_capital_inputs
from .plans import specs
from .sources import files


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="panelwright")
    sub = top.add_subparsers(dest="command", required=True)
    s = sub.add_parser("specs", help="list specifications")
    s.add_argument("--json", action="store_true")
    p = sub.add_parser("prepare", help="add capital measures")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--missing-components", choices=POLICIES, default="zero")
    p.add_argument("--missing-dividends", choices=POLICIES, default="zero")
    p.add_argument("--allow-year-gaps", action="store_true")
    f = sub.add_parser("fit", help="fit a specification")
    f.add_argument("--input", required=True)
    f.add_argument("--output", required=True)
    f.add_argument("--spec", required=True, choices=sorted({*specs.FITTERS, *specs.ALIASES}))
    f.add_argument("--min-obs", type=int, default=20)
    f.add_argument("--min-residual-df", type=int, default=1)
    f.add_argument("--country-col", default="country")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "specs":
        rows = specs.list_specifications()
        print(json.dumps(rows, ensure_ascii=False, indent=2) if args.json else "\n".join(f"{r['id']}\t{r['citation']}\t{r['family']}" for r in rows))
        return 0
    spark = spark or SparkSession.builder.appName("panelwright").getOrCreate()
    df = files.read_table(spark, args.input)
    if args.command == "prepare":
        out = add_capital_inputs(df, missing_components=args.missing_components, missing_dividends=args.missing_dividends,
                                 require_consecutive=not args.allow_year_gaps)
        files.write_table(out, args.output)
        return 0
    options = {"min_obs": args.min_obs, "min_residual_df": args.min_residual_df}
    if specs.ALIASES.get(args.spec, args.spec) == "bh2006_q_cashflow":
        options["group_cols"] = (args.country_col,)
    files.write_audit(specs.fit_specification(df, args.spec, **options), args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
