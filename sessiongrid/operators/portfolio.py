"""Daily open-to-close portfolios: selection, trades, returns and their metrics.

A prediction made after session t is bought at the open and sold at the close of the next
market session; cash is held overnight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessiongrid.functions.columns import holds, to_finite_double
from sessiongrid.operators.clean import CONFLICT
from sessiongrid.schema import require_date

# Slots of the portfolio and the cost of each buy and each sell.
TOP_K = 10
COST = 0.001
# Our choice: trading days in a year; the risk-free rate is taken as zero.
DAYS_PER_YEAR = 252


def select_top(predictions: DataFrame, k: int = TOP_K) -> DataFrame:
    """(Date, Ticker, slot, weight) of the ``k`` highest finite predictions of each date.

    Ties go by ticker. Each slot weighs 1/k, so unfilled slots stay in cash. Spark limits the
    groups inside each input task first, so at most ``k`` rows per date leave a task.
    """
    order = Window.partitionBy("Date").orderBy(F.desc("prediction"), "Ticker")
    number = to_finite_double(F.col("prediction"), predictions.schema["prediction"].dataType)
    return (
        predictions.withColumn("prediction", number)
        .filter("prediction IS NOT NULL")
        .withColumn("slot", F.row_number().over(order))
        .filter(F.col("slot") <= k)
        .select("Date", "Ticker", "slot", F.lit(1.0 / k).alias("weight"))
    )


def benchmark_selection(eligible: DataFrame) -> DataFrame:
    """(Date, Ticker, weight): all eligible stocks of a date at equal weight."""
    sizes = require_date(eligible).groupBy("Date").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    # One row per calendar day, hence bounded.
    return eligible.select("Date", "Ticker").join(F.broadcast(sizes), "Date").select("Date", "Ticker", "weight")


def uncovered_dates(selection: DataFrame, calendar: DataFrame) -> DataFrame:
    """Selection dates without a next session in the calendar."""
    following = require_date(calendar).filter("NextDate IS NOT NULL").select("Date").distinct()
    return selection.select("Date").distinct().join(F.broadcast(following), "Date", "left_anti")


def _tradable(price: Column) -> Column:
    return holds((price > 0) & (price < F.lit(float("inf"))))


def trades(selection: DataFrame, calendar: DataFrame, quotes: DataFrame, cost: float = COST) -> DataFrame:
    """One row per selected slot with its status and its contribution to the day's return.

    ``quotes`` are cleaned but unmasked, as only the open and the close of the entry session
    matter. No usable open leaves the slot in cash; an open without a usable close leaves
    the trade ``unresolved``, with NULL returns. Costs are charged on the traded value of
    both sides. Two different quotes of one traded key fail the job.

    Only the quotes of entry dates are needed. These dates, bounded by the calendar, are
    broadcast, and Spark moves the filter below the removal of copies to where quotes are read.
    """
    sessions = require_date(calendar, "Date", "NextDate").filter("NextDate IS NOT NULL")
    sessions = sessions.select("Date", F.col("NextDate").alias("EntryDate")).distinct()
    entries = require_date(selection).join(F.broadcast(sessions), "Date")
    days = entries.select(F.col("EntryDate").alias("Date")).distinct()
    traded = quotes.join(F.broadcast(days), "Date", "left_semi").groupBy(F.col("Date").alias("EntryDate"), "Ticker")
    conflict = F.raise_error(F.concat_ws(" ", F.lit(CONFLICT + ":"), F.col("EntryDate").cast("string"), F.col("Ticker")))
    bars = traded.agg(F.count("*").alias("_n"), F.max("Open").alias("_open"), F.max("Close").alias("Close")).select(
        "EntryDate", "Ticker", F.when(F.col("_n") > 1, conflict.cast("double")).otherwise(F.col("_open")).alias("Open"), "Close"
    )
    held = entries.join(bars, ["EntryDate", "Ticker"], "left")

    status = (
        F.when(~_tradable(F.col("Open")), "cash_no_open")
        .when(~_tradable(F.col("Close")), "unresolved")
        .otherwise("filled")
    )
    growth = F.try_divide(F.col("Close"), F.col("Open"))
    fee = F.lit(float(cost))
    filled, cash = F.col("status") == "filled", F.col("status") == "cash_no_open"
    gross = F.col("weight") * (growth - 1.0)
    net = F.col("weight") * ((growth - 1.0) - fee - fee * growth)
    return held.withColumn("status", status).select(
        *[name for name in selection.columns],
        "EntryDate",
        "Open",
        "Close",
        "status",
        F.when(filled, gross).when(cash, 0.0).alias("gross"),
        F.when(filled, net).when(cash, 0.0).alias("net"),
    )


def daily_returns(traded: DataFrame) -> DataFrame:
    """Return per date (and ``Portfolio``) before and after costs; NULL while a trade is unresolved."""
    keys = [name for name in ("Portfolio", "Date", "EntryDate") if name in traded.columns]
    unresolved = F.count_if(F.col("status") == "unresolved")

    def total(name):
        return F.when(unresolved == 0, F.sum(name)).alias(name)

    return traded.groupBy(*keys).agg(
        F.count_if(F.col("status") == "filled").alias("filled"),
        F.count_if(F.col("status") == "cash_no_open").alias("cash_slots"),
        unresolved.alias("unresolved"),
        total("gross"),
        total("net"),
    )


def portfolio_metrics(daily: DataFrame) -> DataFrame:
    """Per ``Portfolio``: cumulative returns, annualised Sharpe ratio and maximum drawdown.

    All are NULL as long as a day is unresolved. The input has one row per portfolio and
    session, so a portfolio's whole history fits in one task.
    """
    so_far = Window.partitionBy("Portfolio").orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = daily.withColumn("_wealth", F.product(1.0 + F.col("net")).over(so_far))
    drawdown = wealth.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_wealth").over(so_far))).withColumn(
        "_drawdown", F.col("_wealth") / F.col("_peak") - 1.0
    )
    open_days = F.count_if(F.col("net").isNull())

    def resolved(metric, name):
        return F.when(open_days == 0, metric).alias(name)

    sharpe = F.try_divide(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.lit(float(DAYS_PER_YEAR)))
    return drawdown.groupBy("Portfolio").agg(
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
        F.max("EntryDate").alias("last_exit"),
        F.count("*").alias("days"),
        open_days.alias("unresolved_days"),
        resolved(F.product(1.0 + F.col("gross")) - 1.0, "cumulative_gross"),
        resolved(F.product(1.0 + F.col("net")) - 1.0, "cumulative_net"),
        resolved(sharpe, "sharpe"),
        resolved(F.min("_drawdown"), "max_drawdown"),
    )
