"""Quote checks, masking and the audit of what was found."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongrid.functions.columns import any_null, holds
from sessiongrid.schema import PRICE_COLUMNS, QUOTE_COLUMNS, quoted

# The public names of the overlapping reasons.
REASONS = [
    "missing_or_nonfinite_quote",
    "nonpositive_price",
    "nonpositive_volume",
    "invalid_ohlc_bounds",
]
AUDIT_COUNTS = [
    "input_rows",
    "dropped_invalid_keys",
    "duplicate_rows_removed",
    "grid_rows",
    "inserted_missing_rows",
    "valid_quote_rows",
    "invalid_quote_rows",
    "signal_eligible_rows",
]


def _outside_bounds() -> Column:
    # greatest and least skip missing operands; Adj Close is on another scale and not compared.
    above = F.col("High") < F.greatest("Open", "Low", "Close")
    below = F.col("Low") > F.least("Open", "High", "Close")
    return holds(above) | holds(below)


def add_quote_reasons(panel: DataFrame) -> DataFrame:
    """Add one flag per reason, several of which may hold at once, and ``QuoteValid``."""
    flags = {
        "missing_or_nonfinite_quote": any_null(QUOTE_COLUMNS),
        "nonpositive_price": reduce(or_, [holds(F.col(quoted(name)) <= 0) for name in PRICE_COLUMNS]),
        "nonpositive_volume": holds(F.col("Volume") <= 0),
        "invalid_ohlc_bounds": _outside_bounds(),
    }
    return panel.withColumns(flags).withColumn("QuoteValid", ~reduce(or_, [F.col(name) for name in REASONS]))


def mask_invalid_quotes(panel: DataFrame) -> DataFrame:
    """Blank all six quotes of a row that failed any check."""
    return panel.withColumns({name: F.when(F.col("QuoteValid"), F.col(quoted(name))) for name in QUOTE_COLUMNS})


def audit_metrics() -> dict[str, Column]:
    """Aggregates of the checked panel (flags and Copies kept) that the audit is made of."""
    rows, quotes = F.count(F.lit(1)), F.count("Copies")
    kept = F.coalesce(F.sum("Copies"), F.lit(0))
    return {
        "_kept": kept,
        "duplicate_rows_removed": kept - quotes,
        "grid_rows": rows,
        "inserted_missing_rows": rows - quotes,
        "valid_quote_rows": F.count_if("QuoteValid"),
        "invalid_quote_rows": F.count_if(~F.col("QuoteValid")),
        "signal_eligible_rows": F.count_if("SignalEligible"),
        **{name: F.count_if(name) for name in REASONS},
    }


def _audit_columns(total: DataFrame) -> DataFrame:
    return total.withColumn("dropped_invalid_keys", F.col("input_rows") - F.col("_kept")).select(
        *AUDIT_COUNTS, *REASONS, F.lit(True).alias("reason_counts_overlap")
    )


def audit(raw: DataFrame, checked: DataFrame) -> DataFrame:
    """One row of counts from the raw input and the checked panel (flags and Copies kept).

    The raw side is a bare row count, which a columnar source answers without reading
    columns; all else is one pass over the panel.
    """
    of_panel = checked.agg(*[expression.alias(name) for name, expression in audit_metrics().items()])
    of_raw = raw.agg(F.count(F.lit(1)).alias("input_rows"))
    both = of_panel.unionByName(of_raw, allowMissingColumns=True)
    return _audit_columns(both.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in both.columns]))


def audit_of(spark: SparkSession, input_rows: int, metrics: Mapping[str, int]) -> DataFrame:
    """The audit from counts that the write of the panel collected (``audit_metrics``)."""
    counts = {"input_rows": input_rows, **{name: metrics.get(name, 0) for name in audit_metrics()}}
    schema = ", ".join(f"{name} long" for name in counts)
    return _audit_columns(spark.createDataFrame([tuple(counts.values())], schema))


def audit_long(audit_row: DataFrame) -> DataFrame:
    """The audit counts as (metric, value) rows."""
    names = [name for name in audit_row.columns if name != "reason_counts_overlap"]
    return audit_row.unpivot([], names, "metric", "value")


def audit_dict(audit_row: DataFrame) -> dict:
    """The audit as a nested Python dict; collects its single row."""
    row = audit_row.first()
    return {
        **{name: row[name] for name in AUDIT_COUNTS},
        "invalid_reason_counts": {name: row[name] for name in REASONS},
        "reason_counts_overlap": row["reason_counts_overlap"],
    }


def valid_quotes_per_ticker(panel: DataFrame) -> DataFrame:
    return panel.groupBy("Ticker").agg(F.count_if("QuoteValid").alias("valid_quotes"))


def tickers_without_quotes(panel: DataFrame) -> DataFrame:
    """Tickers that have no usable quote at any session."""
    return valid_quotes_per_ticker(panel).filter("valid_quotes = 0").select("Ticker")
