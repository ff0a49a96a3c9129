"""Predictions and saved quotes to daily returns and a results table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.operators.clean import check_quotes, clean_quotes, drop_invalid_keys, normalize_quotes
from sessiongrid.operators.dataset import split_rows
from sessiongrid.operators.grid import session_calendar
from sessiongrid.operators.portfolio import (
    COST,
    DAYS_PER_YEAR,
    TOP_K,
    benchmark_selection,
    daily_returns,
    portfolio_metrics,
    select_top,
    trades,
    uncovered_dates,
)
from sessiongrid.operators.scoring import check_submission, daily_spearman, spearman_summary
from sessiongrid.sources.storage import write_table

MODEL, BENCHMARK = "model", "equal_weight_eligible"
RULES = "signal after close; buy next session open, sell its close; cash overnight; no shorts"


class BacktestResult(NamedTuple):
    daily: DataFrame
    results: DataFrame
    trades: DataFrame
    uncovered: DataFrame


def complete_days(daily: DataFrame, calendar: DataFrame, signals: DataFrame) -> DataFrame:
    """Give every covered session from the first to the last signal a row per portfolio.

    A session on which nothing qualified is a day in cash.
    """
    first = signals.agg(F.min("Date")).scalar()
    last = signals.agg(F.max("Date")).scalar()
    sessions = calendar.filter("NextDate IS NOT NULL").select("Date", F.col("NextDate").alias("EntryDate"))
    names = F.explode(F.array(F.lit(MODEL), F.lit(BENCHMARK)))
    slots = sessions.filter(F.col("Date").between(first, last)).select(names.alias("Portfolio"), "Date", "EntryDate")
    idle = F.col("unresolved").isNull()

    def filled(name, zero):
        return F.when(idle, F.lit(zero)).otherwise(F.col(name)).alias(name)

    return slots.join(daily, ["Portfolio", "Date", "EntryDate"], "left").select(
        "Portfolio",
        "Date",
        "EntryDate",
        filled("filled", 0),
        filled("cash_slots", 0),
        filled("gross", 0.0),
        filled("net", 0.0),
        F.coalesce("unresolved", F.lit(0)).alias("unresolved"),
    )


def backtest(
    predictions: DataFrame,
    raw_quotes: DataFrame,
    dataset: DataFrame,
    *,
    k: int = TOP_K,
    cost: float = COST,
    split: str = "test",
    validate: bool = True,
    scratch: str | None = None,
) -> BacktestResult:
    """Score predictions for one split and trade the top ``k`` against all eligible stocks.

    ``predictions`` are as returned by ``normalize_predictions``; ``raw_quotes`` are the raw
    rows the panel was made from; ``dataset`` carries ``Split`` and keeps unlabeled rows. Pass a
    written dataset, as several results read it.
    ``validate`` raises unless the submission covers exactly the eligible rows and the quotes
    hold no conflict. Without it predictions for other keys are left out, and a conflict fails
    the query that meets it. With ``scratch``, a new path in shared storage that the caller removes
    when done, the calendar, the trades and the scored pairs are written below it once, so the quotes
    are evaluated twice for all results (dates, trades), and such a conflict fails this call;
    without it every result evaluates them for itself.
    """
    eligible = split_rows(dataset, split, labeled=False)
    quotes = clean_quotes(raw_quotes)
    if validate:
        check_submission(predictions, eligible)
        check_quotes(quotes)
    predictions = predictions.join(eligible.select("Date", "Ticker"), ["Date", "Ticker"], "left_semi")
    # Copies do not change the dates, so these need no grouping of whole quotes.
    calendar = session_calendar(drop_invalid_keys(normalize_quotes(raw_quotes)))

    def once(table: DataFrame, name: str) -> DataFrame:
        if scratch is None:
            return table
        write_table(table, f"{scratch}/{name}")
        return table.sparkSession.read.parquet(f"{scratch}/{name}")

    calendar = once(calendar, "calendar")
    top = select_top(predictions, k)
    chosen = top.select(F.lit(MODEL).alias("Portfolio"), "Date", "Ticker", "weight").unionByName(
        benchmark_selection(eligible).select(F.lit(BENCHMARK).alias("Portfolio"), "Date", "Ticker", "weight")
    )
    # One join of both selections with the quotes, so that these are shuffled once.
    traded = once(trades(chosen, calendar, quotes, cost), "trades")
    daily = complete_days(daily_returns(traded), calendar, eligible)

    left_out = uncovered_dates(eligible, calendar)
    pairs = None if scratch is None else f"{scratch}/pairs"
    scores = spearman_summary(daily_spearman(predictions, eligible, scratch=pairs))
    of_model = F.col("Portfolio") == MODEL
    results = portfolio_metrics(daily).select(
        "*",
        *[
            F.when(of_model, scores.select(name).scalar()).alias(name)
            for name in ("scored_dates", "undefined_dates", "mean_score")
        ],
        left_out.agg(F.array_join(F.array_sort(F.collect_list(F.col("Date").cast("string"))), " ")).scalar().alias("uncovered_dates"),
        F.when(of_model, F.lit(k)).alias("slots"),
        F.lit(float(cost)).alias("cost_per_side"),
        F.lit(DAYS_PER_YEAR).alias("days_per_year"),
        F.lit(BENCHMARK).alias("benchmark"),
        F.lit(RULES).alias("rules"),
    )
    return BacktestResult(daily, results, traded, left_out)


def write_backtest(result: BacktestResult, out: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Save daily returns, results and trades below ``out``, in order of portfolio and date."""
    for name, table, order in (
        ("daily", result.daily, ["Portfolio", "Date"]),
        ("results", result.results, ["Portfolio"]),
        ("trades", result.trades, ["Portfolio", "Date", "Ticker"]),
    ):
        write_table(table, f"{out}/{name}", format, mode, sort_by=order)
