"""Parameters of the analyses. Everything a caller may want to change is here."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Analysis window (both days included) and thresholds."""

    start_date: dt.date = dt.date(2017, 1, 1)
    end_date: dt.date = dt.date(2018, 8, 31)
    # Sellers below this number of orders are kept out of the risk ranking.
    seller_min_orders: int = 20
    # A review is negative at or below this mean score ...
    negative_score: float = 2.0
    # ... unless fewer than `min_negative_reviews` orders qualify; then this one.
    negative_score_fallback: float = 3.0
    min_negative_reviews: int = 30
    # Groups smaller than this are flagged in the hypothesis tests.
    small_sample: int = 20
    # Number of sellers called strategic.
    strategic_sellers: int = 10
    # Share of days with orders that makes a month usable as forecast base.
    month_coverage: float = 0.8
    # First day of the dashboard calendar and its length past the last purchase.
    calendar_start: dt.date = dt.date(2016, 1, 1)
    calendar_months_ahead: int = 6
