"""Stock details: one record per ticker, joined many-to-one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.functions.columns import normalize_ticker
from sessiongrid.schema import PANEL_COLUMNS, quoted


def clean_details(details: DataFrame) -> DataFrame:
    """Normalised tickers, exact copies removed."""
    if "Ticker" not in details.columns:
        raise ValueError("Stock details have no Ticker column.")
    return details.withColumn("Ticker", normalize_ticker(F.col("Ticker"))).dropDuplicates()


def details_issues(cleaned: DataFrame) -> DataFrame:
    """(issue, Ticker, records) for blank tickers and for tickers with several records."""
    blank = F.col("Ticker").isNull() | (F.col("Ticker") == "")
    counted = cleaned.groupBy("Ticker").agg(F.count("*").alias("records"))
    issue = F.when(blank, "missing_ticker").when(F.col("records") > 1, "repeated_ticker")
    return counted.select(issue.alias("issue"), "Ticker", "records").filter("issue IS NOT NULL")


def check_details(cleaned: DataFrame) -> None:
    """Raise on the first kind of issue found. Runs one job."""
    found = details_issues(cleaned).agg(
        F.count_if(F.col("issue") == "missing_ticker").alias("missing"),
        F.min(F.when(F.col("issue") == "repeated_ticker", F.col("Ticker"))).alias("repeated"),
    ).first()
    if found["missing"]:
        raise ValueError("Stock details hold a missing ticker.")
    if found["repeated"] is not None:
        raise ValueError(f"Stock details must have one record per ticker; {found['repeated']} has several.")


def join_details(panel: DataFrame, details: DataFrame, *, validate: bool = True) -> DataFrame:
    """Left join of the details on ``Ticker``; unmatched tickers get missing details.

    There is no broadcast hint: Spark broadcasts small details by their measured size, and
    otherwise only the details move, as the panel is already partitioned by ticker.
    """
    cleaned = clean_details(details)
    clash = sorted((set(cleaned.columns) - {"Ticker"}) & (set(PANEL_COLUMNS) | set(panel.columns)))
    if clash:
        raise ValueError(f"Stock details use column names of the price panel: {clash}")
    if validate:
        check_details(cleaned)
    extras = [name for name in cleaned.columns if name != "Ticker"]
    records = F.count("*")
    single = cleaned.groupBy("Ticker").agg(
        F.when(records > 1, F.raise_error(F.concat(F.lit("Details must have one record per ticker: "), F.col("Ticker"))))
        .otherwise(F.first(F.struct(*[quoted(name) for name in extras])) if extras else F.lit(True))
        .alias("_details")
    )
    joined = panel.join(single, "Ticker", "left")
    return joined.select(
        *[quoted(name) for name in panel.columns],
        *[F.col("_details")[name].alias(name) for name in extras],
    )
