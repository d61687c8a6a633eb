"""Tunable constants of the analysis, gathered in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Settings:
    # Seasonal baseline: fixed observation window, both ends inclusive, and the
    # number of days on each side of a day-of-year that contribute to it.
    baseline_start: date = date(2004, 1, 1)
    baseline_end: date = date(2023, 12, 31)
    half_window: int = 7

    # |z| at or above this is an event.
    extreme_z: float = 2.5
    # Length of the riser list kept per region, metric and day.
    top_risers: int = 5

    # Default view: newest of the last ``default_lookback`` days on which at
    # least ``default_coverage`` of the entities report.
    default_lookback: int = 14
    default_coverage: float = 0.5

    # Coupling.
    flow_metric: str = "streamflow"
    overlay_metric: str = "water_temperature"
    min_pairs: int = 5
    lags: tuple[int, ...] = (0, 1, 2)
    min_month_days: int = 25
    spread_floor: float = 1e-9

    # Incremental load: days re-fetched for revisions, and days before the last
    # observation re-fetched for stragglers.
    revision_days: int = 30
    straggler_days: int = 2

    # Data quality.
    expected_metrics: tuple[str, ...] = field(
        default=("streamflow", "gage_height", "water_temperature")
    )
    null_value_tolerance: float = 0.02
    stale_after_days: int = 3
