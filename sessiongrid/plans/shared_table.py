"""Saved inputs to the shared model table: load, conform, clean, split, check, export."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from sessiongrid.operators.clean import check_quote_counts, clean_quotes, quote_metrics
from sessiongrid.operators.dataset import add_date_splits, check_model_report, make_model_dataset, model_metrics, split_summary
from sessiongrid.operators.quality import audit_metrics, audit_of, tickers_without_quotes
from sessiongrid.plans.panel import checked_panel, public_panel
from sessiongrid.schema import KEY_COLUMNS, export_columns
from sessiongrid.sources.files import (
    check_raw_report,
    conform_tickers,
    raw_metrics,
    read_constituents,
    read_wide_prices,
    repeated_unusable_keys,
    wide_to_long,
)
from sessiongrid.sources.storage import bucketed, fingerprint, save_set, saved_set, write_table


@dataclass(frozen=True)
class Settings:
    """Date range [start, end), cut-offs and export of one shared table."""

    start: str = "2016-01-01"
    end: str = "2026-01-01"
    train_end: str = "2022-12-31"
    validation_end: str = "2023-12-31"
    format: str = "parquet"
    mode: str = "errorifexists"


class SharedTable(NamedTuple):
    model: DataFrame
    panel: DataFrame
    audit: DataFrame
    without_quotes: DataFrame
    summary: DataFrame
    fingerprint: DataFrame


def build_shared_table(
    spark: SparkSession, prices: DataFrame, details: DataFrame, out: str, settings: Settings = Settings()
) -> SharedTable:
    """Build the model table under ``out`` and return it with its panel and reports.

    ``prices`` are long quotes, ``details`` the expected tickers with their details. Each table
    that is written is read back by what follows: the conformed raw quotes, the distinct
    quotes, the panel with its reason flags, the eligible rows, and the model table in order of
    date and ticker. ``prices`` are read only for the first: for its quotes, its tickers and its
    dates.

    Every check and count is collected by the write of the table it concerns. The distinct
    quotes are cut by ticker when written, so the gaps are filled and the windows run without
    another shuffle, and quotes of one key lie next to each other there. Raw keys count as
    repeated by their normalised tickers.
    """
    shape = write_table(conform_tickers(prices, details), f"{out}/raw", mode=settings.mode, metrics=raw_metrics(settings.start, settings.end))
    raw = spark.read.parquet(f"{out}/raw")
    distinct = clean_quotes(raw)
    with bucketed(
        distinct, f"{out}/quotes", "Ticker", "Date", mode=settings.mode, metrics=quote_metrics(), weight="Copies"
    ) as (quotes, keys):
        repeated = keys["repeated_raw_keys"] + (repeated_unusable_keys(raw) if shape["unusable_rows"] > 1 else 0)
        check_raw_report({**shape, "repeated_keys": repeated}, settings.start, settings.end)
        check_quote_counts(keys)
        counts = write_table(checked_panel(quotes, details), f"{out}/panel", mode=settings.mode, metrics=audit_metrics())
    panel = public_panel(spark.read.parquet(f"{out}/panel"))

    write_table(panel.filter("SignalEligible"), f"{out}/eligible", mode=settings.mode)
    dataset = make_model_dataset(spark.read.parquet(f"{out}/eligible"), labeled_only=False)
    model = export_columns(add_date_splits(dataset, settings.train_end, settings.validation_end))
    path = f"{out}/model_data"
    split = None if settings.format == "csv" else "Split"
    report = write_table(
        model, path, settings.format, settings.mode, split, sort_by=KEY_COLUMNS, metrics=model_metrics(), count_repeats=True
    )
    check_model_report(report)
    reader = spark.read.schema(model.schema).format(settings.format)
    saved = export_columns(reader.option("header", True).load(path) if settings.format == "csv" else reader.load(path))
    return SharedTable(
        model=saved,
        panel=panel,
        audit=audit_of(spark, shape["rows"], counts),
        without_quotes=tickers_without_quotes(panel),
        summary=split_summary(saved),
        fingerprint=fingerprint(saved),
    )


def build_from_files(
    spark: SparkSession, constituents: str, prices: str, out: str, settings: Settings = Settings(), *, refresh: bool = False
) -> SharedTable:
    """The whole way from a constituents file and a wide price file to the shared table.

    Both inputs are saved below ``out`` as one set (constituents by ticker, quotes by date and
    ticker) and reused by later builds, unless ``refresh`` is wanted or there is no complete set.
    """
    saved = save_inputs(spark, constituents, prices, f"{out}/inputs", refresh=refresh)
    return build_shared_table(spark, spark.read.parquet(saved["prices"]), spark.read.parquet(saved["constituents"]), out, settings)


def save_inputs(spark: SparkSession, constituents: str, prices: str, root: str, *, refresh: bool = False) -> dict[str, str]:
    """Paths of the saved ``constituents`` and ``prices`` of one reading, read and saved where needed."""
    saved = None if refresh else saved_set(spark, root)
    if saved is None:

        def write(place) -> None:
            write_table(read_constituents(spark, constituents), place("constituents"), sort_by=["Ticker"])
            write_table(wide_to_long(read_wide_prices(spark, prices)), place("prices"), sort_by=KEY_COLUMNS)

        saved = save_set(spark, root, write)
    return saved
