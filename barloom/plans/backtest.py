"""Replay of a screen: signals and prices by Catalyst, then one sequential fold for each configuration.

A fold can't be split over time, so configurations are the unit of parallelism: they are dealt to the groups of an Arrow
grouped map. What a group reads is a panel of at most a few thousand sessions of the symbols that ever had a signal.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.risk import Costs


@dataclass(frozen=True)
class Config:
    initial: float = 1_000_000.0
    max_positions: int = 10
    risk: float = 0.0075
    weight: float = 0.10
    atr_multiple: float = 2.0
    slippage: float = 0.001
    trailing: bool = True
    #: "atr", or "tiered": stops that lock in gains once two marks are passed
    exit_rule: str = "atr"
    support_buffer: float = 0.5
    first_mark: float = 0.08
    first_give: float = 0.04
    second_mark: float = 0.12
    second_give: float = 0.02
    #: Sessions before a symbol is entered again after an exit (tiered only); None: it may be at once.
    cooldown: int | None = None
    max_hold: int | None = None
    hold_only_losers: bool = False
    withhold: bool = True
    settle_days: int = 1
    costs: Costs = field(default_factory=Costs)


def settled(day, n: int):
    """The first weekday, n weekdays after day."""
    while n:
        day += timedelta(days=1)
        n -= day.weekday() < 5
    return day


def entry_cost(value: float, c: Costs) -> float:
    broker, venue = value * c.brokerage + c.brokerage_flat, value * (c.exchange + c.sebi)
    return broker + venue + value * c.stamp_buy + (broker + venue) * c.gst


def exit_cost(value: float, c: Costs) -> float:
    broker, venue = value * c.brokerage + c.brokerage_flat, value * (c.exchange + c.sebi)
    return broker + venue + value * c.stt_sell + (broker + venue) * c.gst


class Panel:
    """Prices by symbol on one list of sessions; NaN where a symbol has no bar."""

    FIELDS = ("open", "high", "low", "close", "atr", "support")

    def __init__(self, days: list, rows: dict[int, dict[str, np.ndarray]]):
        self.days, self.rows = days, rows

    @classmethod
    def of(cls, pdf: pd.DataFrame, days: list) -> Panel:
        slot = {d: i for i, d in enumerate(days)}
        rows = {}
        for token, part in pdf.groupby("token"):
            at = part["trade_date"].map(slot).to_numpy()
            rows[int(token)] = {}
            for f in cls.FIELDS:
                line = np.full(len(days), np.nan)
                line[at] = part[f].to_numpy(dtype=np.float64)
                rows[int(token)][f] = line
        return cls(days, rows)


@dataclass
class Trade:
    token: int
    entry_date: object
    entry: float
    quantity: int
    stop: float
    paid: float
    free_on: object
    peak: float = 0.0


class Book:
    """Cash, open trades and what has been closed; one step for each session."""

    def __init__(self, panel: Panel, entries: dict, exits: dict, c: Config):
        self.panel, self.entries, self.exits, self.c = panel, entries, exits, c
        self.cash, self.open = c.initial, {}
        self.closed: list[dict] = []
        self.curve: list[tuple] = []
        self.left_at: dict[int, int] = {}

    def at(self, token: int, name: str, slot: int) -> float:
        return float(self.panel.rows[token][name][slot])

    def held(self, slot: int) -> float:
        total = 0.0
        for t in self.open.values():
            close = self.at(t.token, "close", slot)
            total += t.quantity * (close if close == close else t.entry)
        return total

    def fill(self, t: Trade, slot: int) -> tuple[float, str] | None:
        """Price and reason of an exit that is due in this session; the price is NaN if it waits for an open."""
        open_, c, day = self.at(t.token, "open", slot), self.c, self.panel.days[slot]
        if self.at(t.token, "low", slot) <= t.stop:
            return (t.stop if open_ != open_ else min(open_, t.stop)), "stop"
        if slot and t.token in self.exits.get(self.panel.days[slot - 1], ()):
            return open_, "exit_signal"
        if c.max_hold is not None and (day - t.entry_date).days >= c.max_hold:
            # of losers alone: without an open there is no telling, and the trade goes on
            if not c.hold_only_losers or open_ / t.entry - 1 <= 0:
                return open_, "time"
        return None

    def raise_stop(self, t: Trade, slot: int) -> None:
        c, close = self.c, self.at(t.token, "close", slot)
        if c.exit_rule == "tiered":
            t.peak = max(t.peak, close / t.entry - 1)
            for mark, give in ((c.first_mark, c.first_give), (c.second_mark, c.second_give)):
                if t.peak >= mark:
                    t.stop = max(t.stop, t.entry * (1 + t.peak - give))
        elif c.trailing:
            atr = self.at(t.token, "atr", slot)
            if atr == atr:
                t.stop = max(t.stop, close - c.atr_multiple * atr)

    def leave(self, t: Trade, price: float, reason: str, slot: int) -> None:
        c, day = self.c, self.panel.days[slot]
        price *= 1 - c.slippage
        value = price * t.quantity
        cost = exit_cost(value, c.costs)
        days = (day - t.entry_date).days
        gain = value - t.entry * t.quantity - (t.paid + cost)
        rate = c.costs.long_term if days >= 365 else c.costs.short_term
        tds = max(gain, 0.0) * rate if c.withhold else 0.0
        self.cash += value - cost - tds
        self.closed.append(
            {
                "token": t.token, "entry_date": t.entry_date, "exit_date": day, "entry": t.entry, "exit": price,
                "quantity": t.quantity, "reason": reason, "costs": t.paid + cost, "tds": tds, "holding_days": days,
                "net_return_pct": (gain - tds) / (t.entry * t.quantity) * 100,
            }
        )
        del self.open[t.token]
        self.left_at[t.token] = slot

    def enter(self, token: int, slot: int) -> None:
        c = self.c
        if token in self.open or token not in self.panel.rows or not slot:
            return
        if c.exit_rule == "tiered" and c.cooldown is not None and slot - self.left_at.get(token, -c.cooldown) < c.cooldown:
            return
        open_, atr = self.at(token, "open", slot), self.at(token, "atr", slot - 1)
        if not open_ > 0 or atr != atr:
            return
        price = open_ * (1 + c.slippage)
        under = self.at(token, "support", slot - 1) - c.support_buffer * atr if c.exit_rule == "tiered" else price - c.atr_multiple * atr
        if not 0 < under < price:
            return
        worth = self.cash + self.held(slot)
        quantity = math.floor(worth * c.risk / (price - under))
        if quantity * price > worth * c.weight:
            quantity = math.floor(worth * c.weight / price)
        if quantity * price + entry_cost(quantity * price, c.costs) > self.cash:
            quantity = math.floor((self.cash - entry_cost(quantity * price, c.costs)) / price)
        paid = entry_cost(quantity * price, c.costs)
        if quantity <= 0 or quantity * price + paid > self.cash:
            return
        day = self.panel.days[slot]
        self.cash -= quantity * price + paid
        self.open[token] = Trade(token, day, price, quantity, under, paid, settled(day, c.settle_days))

    def step(self, slot: int) -> None:
        day = self.panel.days[slot]
        for t in list(self.open.values()):
            close = self.at(t.token, "close", slot)
            if close != close or day < t.free_on:
                continue
            found = self.fill(t, slot)
            if found is None:
                self.raise_stop(t, slot)
            elif found[0] == found[0]:
                self.leave(t, *found, slot)
        for token in self.entries.get(self.panel.days[slot - 1], ()) if slot else ():
            if len(self.open) >= self.c.max_positions:
                break
            self.enter(token, slot)
        held = self.held(slot)
        worth = self.cash + held
        self.curve.append((day, worth, held / worth if worth else 0.0))

    def run(self) -> Book:
        for slot in range(len(self.panel.days)):
            self.step(slot)
        return self


def price_panel(metrics: DataFrame, tokens: DataFrame) -> DataFrame:
    """(trade_date, token, open, high, low, close, atr, support) of the symbols that have signals."""
    return metrics.join(tokens.select("token").distinct(), "token", "left_semi").select(
        "trade_date", "token", "open", "high", "low", "close", F.col("atr_14").alias("atr"), F.col("support_level").alias("support")
    )


def _by_day(pdf: pd.DataFrame) -> dict:
    return {d: part.sort_values("place")["token"].astype(int).tolist() for d, part in pdf.groupby("trade_date")}


RESULT = "config_id int, kind string, trade_date date, equity double, exposure double, token long, entry_date date, entry double, exit double, quantity long, reason string, costs double, tds double, holding_days int, net_return_pct double"


def played(panel: pd.DataFrame, entries: dict, exits: dict, days: list, number: int, c: Config) -> pd.DataFrame:
    """The rows of RESULT for one configuration over days."""
    book = Book(Panel.of(panel, days), entries, exits, c).run()
    equity = pd.DataFrame(book.curve, columns=["trade_date", "equity", "exposure"]).assign(kind="equity")
    trades = pd.DataFrame(book.closed).assign(kind="trade")
    if len(book.closed):
        trades["trade_date"] = trades["exit_date"]
    whole = pd.concat([equity, trades]).assign(config_id=number)
    whole = whole.reindex(columns=[x.split()[0] for x in RESULT.split(", ")])
    for name in ("token", "quantity", "holding_days"):
        whole[name] = whole[name].astype("Int64")
    for name in ("entry_date", "reason"):
        whole[name] = whole[name].astype(object).where(whole[name].notna(), None)
    return whole


def backtests(metrics: DataFrame, entries: DataFrame, exits: DataFrame | None, configs: list[Config], spans: list[tuple] | None = None) -> DataFrame:
    """Equity (kind "equity") and closed trades (kind "trade") of each configuration, all in parallel.

    entries and exits come from screens.signals(). spans has the first and last date for each configuration; without it
    each runs over all sessions of metrics. Configurations are dealt to as many tasks as there are shuffle partitions at
    most, and each task has one copy of the panel and signals: symbols with signals times sessions.
    """
    spark = metrics.sparkSession
    panel = price_panel(metrics, entries)
    nothing = [F.lit(None).cast("double").alias(c) for c in Panel.FIELDS]
    place = F.lit(None).cast("long").alias("place")
    parts = panel.select(F.lit("p").alias("part"), "trade_date", "token", *Panel.FIELDS, place)
    for name, signals in (("e", entries), ("x", exits)):
        if signals is not None:
            parts = parts.union(signals.select(F.lit(name), "trade_date", "token", *nothing, "place"))
    days = metrics.select("trade_date").distinct()
    parts = parts.union(days.select(F.lit("d"), "trade_date", F.lit(0).cast("long"), *nothing, place))
    tasks = min(len(configs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    copies = parts.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = {k: v for k, v in pdf.groupby("part")}
        empty = pdf.iloc[:0]
        dates, panel = sorted(part["d"]["trade_date"]), part.get("p", empty)
        entries, exits = _by_day(part.get("e", empty)), _by_day(part.get("x", empty))
        made = []
        for number in range(key[0], len(configs), tasks):
            a, b = spans[number] if spans else (dates[0], dates[-1])
            here = [d for d in dates if a <= d <= b]
            rows = panel[(panel["trade_date"] >= a) & (panel["trade_date"] <= b)]
            made.append(played(rows, entries, exits, here, number, configs[number]))
        return pd.concat(made)

    return copies.groupBy("task").applyInPandas(run, RESULT)


def with_and_without_tax(config: Config) -> list[Config]:
    return [config, replace(config, withhold=False)]


# Statistics over equity curves and trades


def performance(equity: DataFrame, initial: float) -> DataFrame:
    """One row for each config_id of equity (config_id, trade_date, equity): returns, risk and drawdown."""
    line = Window.partitionBy("config_id").orderBy("trade_date")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    made = equity.withColumns(
        {
            "ret": F.col("equity") / F.lag("equity").over(line) - 1,
            "dd": F.col("equity") / F.max("equity").over(upto) - 1,
            "rn": F.row_number().over(line),
        }
    )
    made = made.withColumn("under", F.col("rn") - F.coalesce(F.max(F.when(F.col("dd") >= 0, F.col("rn"))).over(upto), F.lit(0)))
    down = F.when(F.col("ret") < 0, F.col("ret"))
    sums = made.groupBy("config_id").agg(
        F.count("*").alias("sessions"),
        F.max_by("equity", "trade_date").alias("final_equity"),
        F.min("dd").alias("_dd"),
        F.max("under").cast("long").alias("max_drawdown_days"),
        F.avg("ret").alias("_mean"),
        F.stddev_samp("ret").alias("_sd"),
        F.stddev_samp(down).alias("_down"),
    )
    year = math.sqrt(252)
    gain = F.col("final_equity") / initial
    return sums.select(
        "config_id",
        "sessions",
        "final_equity",
        ((gain - 1) * 100).alias("total_return_pct"),
        F.when(F.col("final_equity") > 0, (F.pow(gain, 252 / F.col("sessions")) - 1) * 100).otherwise(0.0).alias("cagr_pct"),
        (F.col("_dd") * 100).alias("max_drawdown_pct"),
        "max_drawdown_days",
        F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * year).alias("sharpe"),
        F.when(F.col("_down") > 0, F.col("_mean") / F.col("_down") * year).alias("sortino"),
        (F.col("_sd") * year * 100).alias("volatility_pct"),
    )


def trade_stats(trades: DataFrame) -> DataFrame:
    """One row for each config_id of closed trades; a return of 0 is a loss."""
    r = F.col("net_return_pct")
    win, loss = F.avg(F.when(r > 0, r)), F.avg(F.when(r <= 0, r))
    return trades.groupBy("config_id").agg(
        F.count("*").alias("trades"),
        F.count_if(r > 0).alias("winners"),
        F.count_if(r <= 0).alias("losers"),
        (F.count_if(r > 0) / F.count("*") * 100).alias("hit_rate_pct"),
        win.alias("avg_win_pct"),
        loss.alias("avg_loss_pct"),
        F.when(loss != 0, F.abs(win / loss)).alias("win_loss_ratio"),
        F.avg("holding_days").alias("avg_holding_days"),
        F.median("holding_days").alias("median_holding_days"),
        F.sum("costs").alias("total_costs"),
        F.sum("tds").alias("total_tds"),
    )


def survivorship(members: DataFrame, bars: DataFrame) -> DataFrame:
    """(closed_memberships, first_membership, first_bar, reconstructable): whether history can be replayed as it was."""
    known = members.agg(F.count_if(F.col("valid_to").isNotNull()).alias("closed_memberships"), F.min("valid_from").alias("first_membership"))
    first = bars.agg(F.min("trade_date").alias("first_bar"))  # one row each
    return known.crossJoin(F.broadcast(first)).withColumn(
        "reconstructable", (F.col("closed_memberships") > 0) & (F.col("first_membership") <= F.col("first_bar"))
    )


# Sweeps and walk-forward


def windows(sessions: list, train: int, test: int, step: int | None = None) -> list[tuple]:
    """(train_from, train_to, test_from, test_to) by sessions; step is the test's length unless given."""
    out, at = [], 0
    while at + train + test <= len(sessions):
        part = sessions[at : at + train + test]
        out.append((part[0], part[train - 1], part[train], part[-1]))
        at += step or test
    return out


def sweep(metrics: DataFrame, entries: DataFrame, exits: DataFrame | None, base: Config, name: str, values: list) -> DataFrame:
    """(value_no, value, score): net CAGR for each value of a parameter; all values run in parallel."""
    configs = [replace(base, **{name: v}) for v in values]
    runs = backtests(metrics, entries, exits, configs)
    score = performance(runs.where("kind = 'equity'"), base.initial).select(F.col("config_id").alias("value_no"), F.col("cagr_pct").alias("score"))
    named = metrics.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "value_no int, value double")
    return named.join(F.broadcast(score), "value_no", "left")


def verdict(points: list[tuple[float, float]], tolerance: float = 0.25) -> dict:
    """The best of (value, score) in order, the width of its plateau, and whether it stands alone."""
    known = [(v, s) for v, s in points if s is not None and math.isfinite(s)]
    if not known:
        return {"best": None, "score": None, "narrow": False, "width": 0, "warning": "no usable results"}
    at = max(range(len(known)), key=lambda i: known[i][1])
    best, top = known[at]
    if top <= 0:
        return {"best": best, "score": top, "narrow": False, "width": 0, "warning": "best value does not gain"}
    good = [s >= top * (1 - tolerance) for _, s in known]
    left, right = at, at
    while left and good[left - 1]:
        left -= 1
    while right + 1 < len(good) and good[right + 1]:
        right += 1
    width = right - left + 1
    narrow = width < 3 and len(known) >= 3
    return {"best": best, "score": top, "narrow": narrow, "width": width, "warning": "narrow peak" if narrow else None}


def walk_forward(metrics: DataFrame, entries: DataFrame, base: Config, name: str, values: list, train: int, test: int) -> DataFrame:
    """(train_from, test_from, test_to, value, in_sample, out_of_sample, degraded): choose on one span, measure on the next.

    All windows and values run in one job, then all chosen values in another. The list of sessions (a few thousand dates)
    and one score for each value and window come to the driver. metrics is read by both jobs, so it should be a written
    table.
    """
    spark = metrics.sparkSession
    sessions = [r[0] for r in metrics.select("trade_date").distinct().orderBy("trade_date").collect()]
    cut = windows(sessions, train, test)
    trials = [(w, v) for w in cut for v in values]

    def scores(runs: list[tuple], first: int) -> list[float | None]:
        """Net CAGR of each (window, value) over the window's span that begins at its element `first`."""
        if not runs:
            return []
        configs = [replace(base, **{name: v}) for _, v in runs]
        made = backtests(metrics, entries, None, configs, [(w[first], w[first + 1]) for w, _ in runs])
        found = performance(made.where("kind = 'equity'"), base.initial).select("config_id", "cagr_pct").collect()
        by_run = {r["config_id"]: r["cagr_pct"] for r in found}
        return [by_run.get(k) for k in range(len(runs))]

    seen = scores(trials, 0)
    chosen = []
    for k, w in enumerate(cut):
        best = verdict([(float(v), x) for v, x in zip(values, seen[k * len(values) :])])
        if best["best"] is not None:
            chosen.append((w, best["best"], best["score"]))
    after = scores([(w, v) for w, v, _ in chosen], 2)
    rows = [(w[0], w[2], w[3], float(v), x, y, y is not None and y < x / 2) for (w, v, x), y in zip(chosen, after)]
    return spark.createDataFrame(
        rows, "train_from date, test_from date, test_to date, value double, in_sample double, out_of_sample double, degraded boolean"
    )


def described(config: Config) -> dict:
    return asdict(config)
