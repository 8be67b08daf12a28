"""Metrics of each symbol over time: one Arrow grouped map over one exchange by symbol, whatever is asked for.

Spark's moving frames are computed anew for every row, at a cost of rows times frame length in interpreted updates, and
recurrences have no operator at all. So a symbol's history goes to NumPy once (barloom.functions.symbol), where only the
steps that the wanted columns need are run. Lags alone stay Catalyst windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import DEFAULT, MONTH, QUARTER, RETURNS, YEAR, Settings
from barloom.functions.frames import by, change, over
from barloom.functions.symbol import KINDS, compute, inputs_of, steps_for

ARROW = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_(), "date": pa.date32(), "string": pa.string()}


def adjusted(bars: DataFrame) -> DataFrame:
    """Bars with adj_factor as prices and volumes that can be compared over time; NaN becomes null."""
    f = F.col("adj_factor")
    prices = {c: F.nanvl(F.col(c), F.lit(None)) * f for c in ("open", "high", "low", "close")}
    return bars.withColumn("raw_close", F.col("close")).withColumns(prices | {"volume": F.col("volume").cast("double") / f}).drop("adj_factor")


def returns(bars: DataFrame) -> DataFrame:
    c = F.col("close")
    near_far = {"ret_12m_1m": (MONTH, YEAR), "ret_3m_2m": (2 * MONTH, QUARTER)}
    lagged = {k: over(F.lag(c, near).over(by()), F.lag(c, far).over(by())) - 1 for k, (near, far) in near_far.items()}
    return bars.withColumns({name: change(c, n) for name, n in RETURNS.items()} | lagged)


def as_arrow(values: np.ndarray, kind: T.DataType) -> pa.Array:
    """A column as Spark takes it; what isn't known is null."""
    if isinstance(kind, T.DoubleType):
        return pa.array(values.astype(np.float64), from_pandas=True)
    if isinstance(kind, T.LongType):
        unknown = np.isnan(values)
        return pa.array(np.rint(np.where(unknown, 0, values)).astype(np.int64), mask=unknown)
    return pa.array(values.tolist(), ARROW[kind.simpleString()])


def measured(bars: DataFrame, only: list[str] | tuple[str, ...] | None = None, s: Settings = DEFAULT, sessions: list | None = None) -> DataFrame:
    """Adjusted bars with the metrics named in only (all without it), for all sessions or those listed alone.

    What isn't known is null: windows that aren't full, or have a null in them. Bars of one symbol and date are expected
    once. An empty table gives an empty result.
    """
    wanted = list(KINDS) if only is None else list(only)
    steps = steps_for(wanted)
    inputs = inputs_of(steps)
    wanted = [c for c in wanted if c not in bars.columns]
    schema = T.StructType(bars.schema.fields + [T.StructField(c, KINDS[c]) for c in wanted])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("trade_date")
        p = {}
        for c in inputs:
            column = group.column(c)
            dates = pa.types.is_date(column.type)
            p[c] = np.array(column.to_pylist(), dtype=object) if dates else column.cast(pa.float64()).to_numpy()
        made = compute(p, steps, s)
        table = pa.table([*group.columns, *(as_arrow(made[c], KINDS[c]) for c in wanted)], names=schema.names)
        return table if sessions is None else table.filter(pa.compute.is_in(table.column("trade_date"), pa.array(sessions, pa.date32())))

    import pyarrow.compute  # noqa: F401

    return bars.groupBy("token").applyInArrow(run, schema)


def series_metrics(bars: DataFrame, s: Settings = DEFAULT, sessions: list | None = None) -> DataFrame:
    """Every by-symbol metric, from bars with adj_factor."""
    return measured(adjusted(bars), None, s, sessions)
