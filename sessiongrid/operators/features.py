"""Backward-looking features over each ticker's sessions, and signal eligibility.

All functions expect the dense panel, where one row is one session. They use the same
window, so Spark partitions and orders the rows once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sessiongrid.functions.columns import all_present, finite, session_change, session_return
from sessiongrid.functions.rolling import add_rolling, series
from sessiongrid.schema import FEATURES

# Horizons of the momentum features and lengths of the rolling windows.
RETURN_HORIZONS = {"ret_1d": 1, "mom_5d": 5, "mom_20d": 20, "mom_60d": 60}
VOLATILITY_WINDOWS = {"vol_5d": 5, "vol_20d": 20}
VOLUME_WINDOW = 20


def _by_ticker() -> WindowSpec:
    return Window.partitionBy("Ticker").orderBy("Date")


def add_momentum(panel: DataFrame) -> DataFrame:
    """Adjusted-close change over 1, 5, 20 and 60 sessions, never bridging a gap."""
    close, by_ticker = F.col("Adj Close"), _by_ticker()
    return panel.withColumns(
        {name: session_return(close, sessions, by_ticker) for name, sessions in RETURN_HORIZONS.items()}
    )


def add_volatility(panel: DataFrame) -> DataFrame:
    """Sample deviation of the last 5 and 20 one-session returns; full windows only."""
    return _add_rolling_features(panel, volatility=True)


def add_volume_ratio(panel: DataFrame) -> DataFrame:
    """20-session mean volume (full windows only) and today's volume relative to it."""
    return _add_rolling_features(panel, volume=True)


def add_rolling_features(panel: DataFrame) -> DataFrame:
    """Both of ``add_volatility`` and ``add_volume_ratio``, in the same passes."""
    return _add_rolling_features(panel, volatility=True, volume=True)


def _add_rolling_features(panel: DataFrame, *, volatility: bool = False, volume: bool = False) -> DataFrame:
    by_ticker, close = _by_ticker(), F.col("Adj Close")

    def earlier_return(rows: int) -> Column:
        # From the closes themselves, so that it is found in the same pass as the returns.
        before = F.lag(close, rows + 1).over(by_ticker)
        return session_change(F.lag(close, rows).over(by_ticker) if rows else close, before)

    rolled = add_rolling(
        panel,
        by_ticker,
        {"return": earlier_return, "volume": series("Volume", by_ticker)},
        means={"volume_ma20": ("volume", VOLUME_WINDOW)} if volume else {},
        deviations={name: ("return", rows) for name, rows in VOLATILITY_WINDOWS.items()} if volatility else {},
    )
    made = {name: finite(F.col(name)) for name in VOLATILITY_WINDOWS} if volatility else {}
    if volume:
        made["volume_ratio_20d"] = finite(F.try_divide(F.col("Volume"), F.col("volume_ma20")))
    return rolled.withColumns(made)


def add_bar_features(panel: DataFrame) -> DataFrame:
    """Daily range relative to the close, and open-to-close return."""
    spread = F.col("High") - F.col("Low")
    return panel.withColumns(
        {
            "range_pct": finite(F.try_divide(spread, F.col("Close"))),
            "intraday_ret": finite(F.try_divide(F.col("Close"), F.col("Open")) - F.lit(1.0)),
        }
    )


def add_signal_eligible(panel: DataFrame) -> DataFrame:
    """A valid quote with all nine features; the label plays no part."""
    return panel.withColumn("SignalEligible", F.col("QuoteValid") & all_present(FEATURES))


def add_next_session_label(panel: DataFrame) -> DataFrame:
    """``LabelEndDate``, the next session, and ``target``, the adjusted-close return until then."""
    close, by_ticker = F.col("Adj Close"), _by_ticker()
    return panel.withColumns(
        {
            "LabelEndDate": F.lead("Date").over(by_ticker),
            "target": finite(F.try_divide(F.lead(close).over(by_ticker), close) - F.lit(1.0)),
        }
    )
