from sessiongrid.functions.columns import (
    all_present,
    any_null,
    finite,
    normalize_ticker,
    session_return,
    to_finite_double,
    to_session_date,
)
from sessiongrid.functions.ranks import add_daily_rank

__all__ = [
    "add_daily_rank",
    "all_present",
    "any_null",
    "finite",
    "normalize_ticker",
    "session_return",
    "to_finite_double",
    "to_session_date",
]
