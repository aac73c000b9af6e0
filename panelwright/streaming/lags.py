"""Gap-guarded lags over a stream of entity-period rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState


def stream_lag(df: DataFrame, column: str, firm: str = "firm", period: str = "fiscal_year", output: str = "lagged") -> DataFrame:
    """(firm, period, column, output): the value of the period right before, as rows arrive.

    ``df`` is a streaming frame with a numeric period.  The state of a firm is its latest period and value, so
    it does not grow; rows of one batch are taken in period order, and a row at or before the
    latest period seen is late and gets NULL.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        for x in [pd.concat(list(batches)).sort_values(period, kind="stable")]:
            out = []
            for p, v in zip(x[period].tolist(), x[column].tolist(), strict=True):
                v = None if pd.isna(v) else float(v)
                out.append(last[1] if last is not None and p - last[0] == 1 else None)
                if last is None or p > last[0]:
                    last = (int(p), v)
            yield pd.DataFrame({firm: x[firm], period: x[period], column: x[column], output: pd.Series(out, index=x.index, dtype="float64")})
        state.update(last)

    schema = f"{firm} {kinds[firm]}, {period} {kinds[period]}, {column} {kinds[column]}, {output} double"
    return df.select(firm, period, column).groupBy(firm).applyInPandasWithState(step, schema, "p long, v double", "append", "NoTimeout")
