"""Stops, sizes, costs and tax as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.config import DEFAULT


@dataclass(frozen=True)
class Costs:
    """Rates of a delivery trade. Fixed values."""

    brokerage: float = 0.0
    brokerage_flat: float = 0.0
    stt_sell: float = 0.001
    exchange: float = 0.0000297
    sebi: float = 0.000001
    stamp_buy: float = 0.00015
    gst: float = 0.18
    short_term: float = 0.2392
    long_term: float = 0.1495


def suggest_stop(close: Column, atr: Column, base_low: Column | None = None, k: float = DEFAULT.atr_stop_multiple) -> dict[str, Column]:
    """atr_stop, its distance, the structural stop under a base, and which of them is wider."""
    base_low = F.lit(None).cast("double") if base_low is None else base_low
    stop = F.when((close > 0) & (atr > 0), close - k * atr)
    under = F.when((close > 0) & (base_low > 0) & (base_low < close), base_low)
    wider = (
        F.when(stop.isNotNull() & under.isNotNull(), F.when(under < stop, "structural").otherwise("atr"))
        .when(stop.isNotNull(), "atr")
        .when(under.isNotNull(), "structural")
    )
    return {
        "atr_stop": stop,
        "atr_stop_distance": F.when((stop != 0) & (stop < close), (close - stop) / close),
        "structural_stop": under,
        "wider_stop": wider,
    }


def size_position(close: Column, stop: Column, portfolio: Column, risk: float = DEFAULT.risk_per_trade, weight: float = DEFAULT.max_weight) -> dict[str, Column]:
    """Shares for a risk budget, capped by weight; all null where the stop leaves no risk or no share fits."""
    ok = (close > 0) & (stop < close) & (portfolio > 0)
    budget = portfolio * risk
    wanted = F.when(ok, F.floor(budget / (close - stop)))
    good = wanted > 0
    over = F.when(good, wanted * close > portfolio * weight)
    quantity = F.when(good, F.when(over, F.floor(portfolio * weight / close)).otherwise(wanted))
    return {
        "quantity": quantity,
        "position_value": quantity * close,
        "risk_amount": F.when(good, budget),
        "capped": over,
    }


def tax_rate(days: Column, m: Costs = Costs()) -> Column:
    return F.when(days >= 365, m.long_term).otherwise(m.short_term)


def round_trip(gain: Column, days: Column, m: Costs = Costs()) -> dict[str, Column]:
    """Frictions, tax withheld on what exceeds them, and what is kept; all as shares of the value. GST leaves SEBI out."""
    frictions = 2 * (m.brokerage + m.exchange + m.sebi) + m.stt_sell + m.stamp_buy + m.gst * 2 * (m.brokerage + m.exchange)
    tds = F.greatest(gain - frictions, F.lit(0.0)) * tax_rate(days, m)
    return {
        "frictions": F.lit(frictions),
        "tds": tds,
        "round_trip_cost": F.lit(frictions) + tds,
        "breakeven_move": F.lit(frictions),
        "net_gain": F.greatest(gain - frictions - tds, F.lit(0.0)),
    }


def sellable_date(entry: Column, settlement: int = 1) -> Column:
    """The weekday on which shares bought on entry can be sold: settlement weekdays later."""
    day = entry
    for _ in range(settlement):
        day = F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))
    return day


def days_to_long_term(entry: Column, today: Column) -> Column:
    """Days until the same date next year, 0 when passed; 29 February counts as the 28th."""
    return F.greatest(F.datediff(F.add_months(entry, 12), today), F.lit(0))


def tax_on_gain(gain: Column, days: Column, m: Costs = Costs()) -> Column:
    return F.when(gain > 0, gain * tax_rate(days, m)).otherwise(0.0)
