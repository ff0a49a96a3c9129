"""A small made-up market for the tests, as plain rows that a test may change."""

from __future__ import annotations

import datetime as dt
import math

SCHEMA = "Date string, Ticker string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double"
COLUMNS = ["Date", "Ticker", "Open", "High", "Low", "Close", "Adj Close", "Volume"]
TICKERS = ["KAPPA", "MU", "XI"]
SESSIONS = 90


def days(count: int = SESSIONS) -> list[str]:
    """Weekdays from 2020-03-02."""
    start, found = dt.date(2020, 3, 2), []
    while len(found) < count:
        if start.weekday() < 5:
            found.append(start.isoformat())
        start += dt.timedelta(days=1)
    return found


DAYS = days()


def close(ticker: int, session: int) -> float:
    return 40.0 * (ticker + 1) + (0.3 - 0.2 * ticker) * session + 1.5 * math.cos(session * (ticker + 2))


def rows() -> list[dict]:
    made = []
    for number, ticker in enumerate(TICKERS):
        for session, day in enumerate(DAYS):
            price = close(number, session)
            made.append(
                {
                    "Date": day,
                    "Ticker": ticker,
                    "Open": price - 0.4,
                    "High": price + 1.0,
                    "Low": price - 1.0,
                    "Close": price,
                    "Adj Close": price * 0.9,
                    "Volume": 5000.0 + 37 * session + 11 * number,
                }
            )
    return made


def at(data: list[dict], ticker: str, session: int) -> dict:
    return next(row for row in data if row["Ticker"] == ticker and row["Date"] == DAYS[session])


def frame(spark, data: list[dict], schema: str = SCHEMA):
    return spark.createDataFrame([tuple(row[name] for name in COLUMNS) for row in data], schema)


def by_key(df) -> dict:
    """Collected rows by (ticker, session number)."""
    return {(row["Ticker"], DAYS.index(str(row["Date"]))): row for row in df.collect()}
