"""Raw rows to one quote per (Date, Ticker)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.functions.columns import (
    INFER,
    computed_once,
    finite,
    in_calendar,
    infer_date_format,
    normalize_ticker,
    to_day,
    to_double,
    to_session_date,
)
from sessiongrid.schema import QUOTE_COLUMNS, RAW_COLUMNS, quoted, require_columns

CONFLICT = "Conflicting quotes for one date and ticker"


def normalize_quotes(raw: DataFrame, *, date_format: str | None = None) -> DataFrame:
    """Required columns only, with typed keys and finite numbers.

    ``date_format`` is a pattern for text dates, or ``"infer"`` for the one that fits the whole
    column, which is found in a job of its own; see ``infer_date_format``.
    """
    raw = require_columns(raw, RAW_COLUMNS)
    date_format = _format_of(raw, date_format)
    types = {field.name: field.dataType for field in raw.schema}
    typed = raw.select(
        to_session_date(F.col("Date"), types["Date"], date_format).alias("Date"),
        normalize_ticker(F.col("Ticker")).alias("Ticker"),
        *[to_double(F.col(quoted(name)), types[name]).alias(name) for name in QUOTE_COLUMNS],
    )
    if isinstance(types["Date"], T.StringType):
        typed = computed_once(typed, "Date", "Ticker")  # text is slow to read
    # A projection of its own, so that text is parsed once although the check uses it twice.
    return typed.select("Date", "Ticker", *[finite(F.col(quoted(name))).alias(name) for name in QUOTE_COLUMNS])


def _format_of(raw: DataFrame, date_format: str | None) -> str | None:
    return infer_date_format(raw) if date_format == INFER else date_format


def drop_invalid_keys(quotes: DataFrame) -> DataFrame:
    """Rows that have a date and a non-blank ticker."""
    # A missing ticker fails the comparison as well.
    return quotes.filter(F.col("Date").isNotNull() & (F.col("Ticker") != ""))


def unusable_keys(raw: DataFrame, *, date_format: str | None = None) -> DataFrame:
    """(reason, rows) of the rows without a usable key; reasons may overlap."""
    kind = raw.schema["Date"].dataType
    day, ticker = to_day(F.col("Date"), kind, _format_of(raw, date_format)), normalize_ticker(F.col("Ticker"))
    counts = raw.select(day.alias("day"), ticker.alias("ticker")).agg(
        F.count_if(F.col("day").isNull()).alias("unreadable_date"),
        F.count_if(~in_calendar(F.col("day"))).alias("date_out_of_range"),
        F.count_if(F.coalesce(F.col("ticker"), F.lit("")) == "").alias("missing_ticker"),
    )
    return counts.unpivot([], counts.columns, "reason", "rows")


def dedupe_quotes(quotes: DataFrame) -> DataFrame:
    """Distinct rows, missing equal to missing, with the number of ``Copies`` of each.

    A plain grouping, so copies collapse inside each input task before anything is shuffled.
    """
    return quotes.groupBy(*[quoted(name) for name in RAW_COLUMNS]).agg(F.count("*").alias("Copies"))


def clean_quotes(raw: DataFrame, *, date_format: str | None = None) -> DataFrame:
    """Normalise, drop invalid keys and remove exact copies. Bad values are kept."""
    return dedupe_quotes(drop_invalid_keys(normalize_quotes(raw, date_format=date_format)))


def conflicting_keys(quotes: DataFrame) -> DataFrame:
    """Keys that still have several, different quotes after exact copies are gone."""
    return quotes.groupBy("Date", "Ticker").agg(F.count("*").alias("records")).filter("records > 1")


def quote_metrics() -> dict[str, Column]:
    """Aggregates of the distinct quotes that decide whether they can be used.

    They see ``_nth``, the number of a quote among those of its key, and ``_before``, the raw rows of
    the quotes before it. A key had several raw rows if one of its quotes is or holds the second.
    """
    second = (F.col("_before") < 2) & (F.col("_before") + F.col("Copies") >= 2)
    conflict = F.col("_nth") == 2
    return {
        "keys": F.count_if(F.col("_nth") == 1),
        "repeated_raw_keys": F.count_if(second),
        "example": F.min(F.when(conflict, F.struct("Date", "Ticker"))),
    }


def check_quote_counts(found: Mapping) -> None:
    """Raise if the counts tell of no quote at all or of a conflict."""
    if found["keys"] == 0:
        raise ValueError("Not a single row has a usable Date and Ticker.")
    if found["example"] is not None:
        raise ValueError(f"{CONFLICT}: {found['example'].asDict()}")


def check_quotes(quotes: DataFrame) -> None:
    """Raise if the cleaned quotes are empty or hold a conflict. Runs one job."""
    found = (
        quotes.groupBy("Date", "Ticker")
        .agg(F.count("*").alias("records"))
        .agg(
            F.count("*").alias("keys"),
            F.min(F.when(F.col("records") > 1, F.struct("Date", "Ticker"))).alias("example"),
        )
        .first()
    )
    check_quote_counts(found.asDict())
