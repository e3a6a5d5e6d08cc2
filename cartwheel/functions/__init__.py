"""Column-level helpers: periods, ratios and the shop's fixed values."""

from cartwheel.functions.periods import monday_weekday, split_label, sunday_week, ts, week_start, year_week
from cartwheel.functions.ratios import count_when, money, ratio, rounded

__all__ = [
    "count_when",
    "monday_weekday",
    "money",
    "ratio",
    "rounded",
    "split_label",
    "sunday_week",
    "ts",
    "week_start",
    "year_week",
]
