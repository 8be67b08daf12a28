"""From bars to the stored table of daily metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import DEFAULT, Settings
from barloom.operators.adjust import with_factors
from barloom.operators.cross_section import cross_section
from barloom.operators.series import series_metrics


def metrics(
    bars: DataFrame,
    actions: DataFrame,
    instruments: DataFrame,
    index: DataFrame,
    s: Settings = DEFAULT,
    as_of=None,
    excluded: DataFrame | None = None,
    breaks: DataFrame | None = None,
    sessions: list | None = None,
) -> DataFrame:
    """All metrics of all sessions, of the sessions listed, or of the session as_of alone (then later bars are never read).

    The series pass needs each symbol's whole history; its rows of other sessions never leave the workers.
    """
    if as_of is not None:
        sessions = [as_of]
        bars, index = bars.where(F.col("trade_date") <= F.lit(as_of)), index.where(F.col("trade_date") <= F.lit(as_of))
    rows = series_metrics(with_factors(bars, actions), s, sessions)
    named = instruments.select("token", "series", "industry", "name", "float_shares")
    return cross_section(rows.join(named, "token", "left"), index, s, excluded, breaks)
