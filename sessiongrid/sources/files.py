"""Readers for stock details, quotes, predictions and the model table."""

from __future__ import annotations

import csv
import json
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.functions.columns import normalize_ticker, to_finite_double, to_session_date
from sessiongrid.schema import DETAIL_COLUMNS, KEY_COLUMNS, MODEL_SCHEMA, QUOTE_COLUMNS, quoted, require_columns

_TEXT = T.StringType()


def constituents(details: DataFrame) -> DataFrame:
    """Ticker and details from a table that has a Symbol; the case of the symbol is kept."""
    named = require_columns(details, DETAIL_COLUMNS)
    return named.select(
        normalize_ticker(F.col("Symbol"), upper=False).alias("Ticker"), *[quoted(name) for name in DETAIL_COLUMNS[1:]]
    )


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    """Stock details from CSV, all columns as text; a Ticker is derived if only Symbol is there."""
    details = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return details if "Ticker" in details.columns else constituents(details)


class WideQuotes(NamedTuple):
    """A wide table by position: (Date, cells) rows, and the (ticker, field) pair of each cell.

    Its plan has one expression for all cells, so it does not grow with the number of tickers.
    """

    rows: DataFrame
    pairs: list[tuple[str, str]]


def _cells(line: Column) -> Column:
    """The cells of a CSV line in one array; quoted ones without their quotes."""
    plain = F.split(line, ",", -1)
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*+"|[^,]*)'), 1)
    bare = F.transform(
        raw, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    )
    return F.when(line.contains('"'), bare).otherwise(plain)


def read_wide_prices(spark: SparkSession, path: str) -> WideQuotes:
    """Quotes from CSV with one row per date and a cell per ticker and field.

    The first two lines name ticker and field of each column, a third may name the index.
    Only those lines are read ahead. They are then dropped by their first cell (if it is blank, by
    their second), so that a row with a bad date stays and is counted later. Each line is cut
    once; missing cells at its end are missing values.
    """
    lines = spark.read.text(path)
    ahead = lines.limit(2).collect()
    if len(ahead) < 2:
        raise ValueError("A wide price file starts with a ticker line and a field line.")
    tickers, fields = (next(csv.reader([line["value"]])) for line in ahead)
    pairs = list(zip(tickers[1:], fields[1:], strict=True))
    if "Adj Close" not in {field for _, field in pairs}:
        raise ValueError("Adj Close is missing; quotes must not be adjusted beforehand.")
    cut = lines.filter(F.trim("value") != "").select(_cells(F.col("value")).alias("cells"))
    first, second = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    named = first.isin([cell for cell in (tickers[0], fields[0], "Date") if cell])
    heading = named | ((first == "") & second.isin(tickers[1], fields[1]))
    rows = cut.filter(~F.coalesce(heading, F.lit(False))).select(
        to_session_date(first, _TEXT).alias("Date"),
        F.transform(F.slice("cells", 2, len(pairs)), lambda c: to_finite_double(c, _TEXT)).alias("cells"),
    )
    return WideQuotes(rows, pairs)


def _by_position(wide: DataFrame) -> WideQuotes:
    """A table with a ``ticker/field`` column per pair, its values in one array."""
    names = [name for name in wide.columns if "/" in name]
    pairs = [(ticker, field) for ticker, _, field in (name.rpartition("/") for name in names)]
    return WideQuotes(wide.select("Date", F.array(*[F.col(quoted(name)).cast("double") for name in names]).alias("cells")), pairs)


def wide_to_long(wide: DataFrame | WideQuotes, fields=tuple(QUOTE_COLUMNS)) -> DataFrame:
    """One row per date and ticker of a wide table, rows of missing quotes included.

    ``wide`` comes from ``read_wide_prices`` or has ``ticker/field`` columns. A row expands in place
    into one struct per ticker, so nothing is shuffled. Which cells belong to a ticker is a single constant.
    Absent fields become missing, other fields are dropped.
    """
    rows, pairs = wide if isinstance(wide, WideQuotes) else _by_position(wide)
    places: dict[str, dict[str, int]] = {}
    for at, (ticker, field) in enumerate(pairs):
        places.setdefault(ticker, {}).setdefault(field, at)
    header = [{"ticker": ticker, "at": [own.get(field) for field in fields]} for ticker, own in places.items()]
    table = F.from_json(F.lit(json.dumps(header)), "array<struct<ticker:string,at:array<int>>>")

    def record(one: Column) -> Column:
        cells = [F.get("cells", F.get(one["at"], F.lit(i))).alias(field) for i, field in enumerate(fields)]
        return F.struct(one["ticker"].alias("Ticker"), *cells)

    return rows.select("Date", F.inline(F.transform(table, record)))


def conform_tickers(quotes: DataFrame, tickers: DataFrame) -> DataFrame:
    """Quotes of the expected tickers only; an expected ticker without any gets missing quotes.

    Such a ticker gets a row per session date present, as a column of missing values in a wide
    file would. Dates are made session dates first, so that the list of them is a single value
    bounded by the calendar; unreadable ones stay as rows without a date, to be counted later.
    """
    quotes = require_columns(quotes, [*KEY_COLUMNS, *QUOTE_COLUMNS])
    quotes = quotes.withColumn("Date", to_session_date(F.col("Date"), quotes.schema["Date"].dataType))
    expected = tickers.select("Ticker").distinct()
    kept = quotes.join(expected, "Ticker", "left_semi")
    absent = expected.join(quotes.select("Ticker").distinct(), "Ticker", "left_anti")
    dates = quotes.filter("Date IS NOT NULL").select("Date").distinct().agg(F.array_sort(F.collect_list("Date"))).scalar()
    empty = [F.lit(None).cast(quotes.schema[name].dataType).alias(name) for name in QUOTE_COLUMNS]
    filler = absent.select(F.explode(dates).alias("Date"), "Ticker", *empty)
    return kept.select(*[quoted(name) for name in quotes.columns]).unionByName(filler)


def raw_price_report(quotes: DataFrame, start: str, end: str) -> DataFrame:
    """One row: rows, keys, repeated keys, first and last date, rows outside [start, end)."""
    inside = (F.col("Date") >= F.lit(start).cast("date")) & (F.col("Date") < F.lit(end).cast("date"))
    return (
        quotes.groupBy("Date", "Ticker")
        .agg(F.count("*").alias("rows"))
        .agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.count("*").alias("keys"),
            F.count_if(F.col("rows") > 1).alias("repeated_keys"),
            F.min("Date").alias("first_date"),
            F.max("Date").alias("last_date"),
            F.coalesce(F.sum(F.when(~inside, F.col("rows"))), F.lit(0)).alias("rows_out_of_range"),
        )
    )


def raw_metrics(start: str, end: str) -> dict[str, Column]:
    """The counts of ``raw_price_report`` that need no keys, as aggregates of raw rows, and the rows without a usable key."""
    inside = (F.col("Date") >= F.lit(start).cast("date")) & (F.col("Date") < F.lit(end).cast("date"))
    return {
        "rows": F.count(F.lit(1)),
        "rows_out_of_range": F.count_if(~inside),
        "unusable_rows": F.count_if(_unusable()),
    }


def _unusable() -> Column:
    return F.col("Date").isNull() | (F.coalesce(normalize_ticker(F.col("Ticker")), F.lit("")) == "")


def repeated_unusable_keys(quotes: DataFrame) -> int:
    """Keys of several rows among the rows without a usable key; only these are shuffled."""
    keys = quotes.filter(_unusable()).groupBy("Date", "Ticker").agg(F.count("*").alias("rows"))
    return keys.filter("rows > 1").count()


def check_raw_prices(quotes: DataFrame, start: str, end: str) -> None:
    """Raise unless there are quotes, no key is repeated and all dates lie in [start, end)."""
    require_columns(quotes, [*KEY_COLUMNS, *QUOTE_COLUMNS])
    check_raw_report(raw_price_report(quotes, start, end).first().asDict(), start, end)


def check_raw_report(report: Mapping, start: str, end: str) -> None:
    """Raise on the first fault that the counts tell of."""
    if report["rows"] == 0 or report["repeated_keys"]:
        found = f"{report['repeated_keys']} keys have several rows" if report["rows"] else "the table is empty"
        raise ValueError(f"The raw prices cannot be used: {found}.")
    if report["rows_out_of_range"]:
        raise ValueError(f"{report['rows_out_of_range']} prices lie outside {start} to {end} (exclusive).")


def read_model_table(spark: SparkSession, path: str) -> DataFrame:
    """The shared model table, from CSV files with a header."""
    return spark.read.schema(MODEL_SCHEMA).option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A submission (Date, Ticker, prediction) from CSV.

    Every cell is read as text, so an unusable one becomes NULL and is reported rather than
    stopping the read.
    """
    text = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return normalize_predictions(text)


def normalize_predictions(predictions: DataFrame) -> DataFrame:
    """Typed keys and finite predictions."""
    named = require_columns(predictions, [*KEY_COLUMNS, "prediction"])
    types = {field.name: field.dataType for field in named.schema}
    return named.select(
        to_session_date(F.col("Date"), types["Date"]).alias("Date"),
        normalize_ticker(F.col("Ticker")).alias("Ticker"),
        to_finite_double(F.col("prediction"), types["prediction"]).alias("prediction"),
    )
