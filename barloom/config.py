"""Thresholds of the engine. Fixed values that results depend on."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    index_name: str = "NIFTY500"
    min_history_days: int = 252
    liquidity_floor: float = 5e7
    allowed_series: tuple[str, ...] = ("EQ", "BE")
    momentum_lookback: int = 90
    gap_limit: float = 0.15
    rel_volume_min: float = 1.5
    base_window: int = 15
    base_depth: float = 0.15
    base_contraction: float = 0.75
    base_advance: float = 0.25
    support_tolerance: float = 0.03
    pullback_min: float = 0.03
    pullback_max: float = 0.25
    reversal_min_score: int = 2
    reversal_volume_ratio: float = 1.2
    reversal_rsi: float = 45.0
    reversal_close_position: float = 0.66
    swing_reach: int = 3
    fib_min_amplitude: float = 0.20
    fib_min_leg: int = 15
    fib_max_leg: int = 250
    fib_max_age: int = 60
    fib_max_shock: float = 0.20
    fib_attempts: int = 3
    fib_baseline: int = 50
    fib_impulse_min: float = 1.20
    fib_dryup_max: float = 0.80
    fib_close_position: float = 0.60
    fib_volume_expansion: float = 1.50
    fib_min_baseline: int = 3
    fib_atr_buffer: float = 0.5
    fib_min_reward_risk: float = 2.0
    fib_min_sessions: int = 65
    atr_stop_multiple: float = 2.0
    risk_per_trade: float = 0.0075
    max_weight: float = 0.10
    #: "reference": a swing low supports from the bar it prints on; "confirmed": only from `swing_reach` bars later.
    support_mode: str = "reference"


DEFAULT = Settings()

#: The driver's tables trade in small amounts: a floor that splits their symbols.
DEMO = Settings(liquidity_floor=2e5)

#: Sessions of the return windows.
RETURNS = {
    "ret_1d": 1, "ret_1w": 5, "ret_2w": 10, "ret_3w": 15, "ret_1m": 21,
    "ret_2m": 42, "ret_3m": 63, "ret_6m": 126, "ret_9m": 189, "ret_12m": 252,
}
WEEK, MONTH, QUARTER, YEAR = 5, 21, 63, 252

COMPOSITE_WEIGHTS = {
    "momentum_score": 0.30,
    "ret_12m_1m": 0.20,
    "rs_rating": 0.20,
    "range_position_52w": 0.15,
    "atr_pct_14": -0.10,
    "rel_volume": 0.05,
}
SETUP_WEIGHTS = {
    "momentum_score": 0.30,
    "rs_rating": 0.20,
    "inv_vol_dryup": 0.20,
    "rel_volume": 0.15,
    "fib_sessions_in_zone": 0.15,
}
