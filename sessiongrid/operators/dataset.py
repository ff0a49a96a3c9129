"""Model dataset, date splits and the contract of the shared model table."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongrid.functions.columns import any_null, holds, to_finite_double, to_session_date
from sessiongrid.functions.ranks import add_daily_rank
from sessiongrid.schema import FEATURES, SPLITS, quoted
from sessiongrid.sources.storage import write_table


def make_model_dataset(panel: DataFrame, *, labeled_only: bool = True, scratch: str | None = None) -> DataFrame:
    """Eligible rows with ``target_rank``, the percent rank of the target within its day.

    With ``labeled_only=False`` rows whose next return is unknown stay, without a rank. The
    rank counts only kept rows with a known target.

    Rows, ranks and later the purged dates are all taken from the kept rows. With ``scratch``,
    a new path in shared storage that the caller removes when done, these are written there
    once, so the panel is evaluated a single time; without it, once for each of those uses.
    """
    target = to_finite_double(F.col("target"), panel.schema["target"].dataType)
    kept = panel.withColumn("target", target).filter("SignalEligible")
    if labeled_only:
        kept = kept.filter(F.col("target").isNotNull())
    if scratch is not None:
        write_table(kept, scratch)
        kept = panel.sparkSession.read.parquet(scratch)
    return add_daily_rank(kept, "target", "target_rank")


def _cutoff(value) -> date:
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    try:
        return datetime.fromisoformat(str(value).strip()).date()
    except ValueError:
        raise ValueError(f"Not a cut-off date: {value!r}") from None


def crossing_dates(dataset: DataFrame, train_end, validation_end) -> DataFrame:
    """Dates with a row whose label reaches past the end of the row's own period.

    Outside the test period a missing label date counts as reaching past it.
    """
    train_day, validation_day = F.lit(_cutoff(train_end)), F.lit(_cutoff(validation_end))
    day, label = F.col("Date"), F.col("LabelEndDate")
    period_end = F.when(day <= train_day, train_day).when(day <= validation_day, validation_day)
    crossing = period_end.isNotNull() & (label.isNull() | holds(label > period_end))
    return dataset.filter(crossing).select("Date").distinct()


def add_date_splits(
    dataset: DataFrame, train_end="2022-12-31", validation_end="2023-12-31", *, validate: bool = True
) -> DataFrame:
    """Add ``Split``: train, validation or test by date, or purged.

    One row whose label crosses a cut-off purges its whole date. The purged dates are distinct
    calendar days and thus bounded (see FIRST_DATE), so they are broadcast.
    ``validate`` looks for missing dates in a job of its own; otherwise one fails the query.
    """
    train_day, validation_day = _cutoff(train_end), _cutoff(validation_end)
    if validation_day <= train_day:
        raise ValueError("validation_end has to lie after train_end.")
    types = {field.name: field.dataType for field in dataset.schema}
    dated = dataset.withColumns(
        {name: to_session_date(F.col(name), types[name]) for name in ("Date", "LabelEndDate")}
    )
    if validate and not dated.filter("Date IS NULL").limit(1).isEmpty():
        raise ValueError("At least one row has no Date.")
    day = F.coalesce(F.col("Date"), F.raise_error(F.lit("At least one row has no Date.")))
    purged = crossing_dates(dated, train_day, validation_day).withColumn("_purged", F.lit(True))
    split = (
        F.when(F.col("_purged"), "purged")
        .when(F.col("Date") <= F.lit(train_day), "train")
        .when(F.col("Date") <= F.lit(validation_day), "validation")
        .otherwise("test")
    )
    columns = [name for name in dataset.columns if name != "Split"]
    return (
        dated.withColumn("Date", day)
        .join(F.broadcast(purged), "Date", "left")
        .select(*[quoted(name) for name in columns], split.alias("Split"))
    )


def split_rows(dataset: DataFrame, split: str, labeled: bool = True) -> DataFrame:
    """Rows of one split; ``labeled`` keeps only those with a known target."""
    if split not in SPLITS:
        raise ValueError(f"Unknown split {split!r}; choose one of {SPLITS}")
    rows = dataset.filter(F.col("Split") == split)
    return rows.dropna(subset=["target"]) if labeled else rows


def split_summary(dataset: DataFrame) -> DataFrame:
    """Rows and known targets per split."""
    return dataset.groupBy("Split").agg(F.count("*").alias("rows"), F.count("target").alias("known_targets"))


def model_table_report(dataset: DataFrame) -> DataFrame:
    """One row of counts that decide whether the table can be shared.

    Grouping by key first finds repeated keys without a distinct count over all of them.
    """
    per_key = dataset.groupBy("Date", "Ticker").agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col("Split") == split).alias(split) for split in SPLITS],
        F.count_if(any_null(FEATURES)).alias("incomplete"),
    )
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    return per_key.agg(
        total("rows").alias("rows"),
        *[total(split).alias(f"{split}_rows") for split in SPLITS],
        F.count_if(F.col("rows") > 1).alias("repeated_keys"),
        total("incomplete").alias("rows_with_missing_features"),
    )


def model_metrics() -> dict[str, Column]:
    """The counts of ``model_table_report`` but for repeated keys, as aggregates of the rows."""
    return {
        "rows": F.count(F.lit(1)),
        **{f"{split}_rows": F.count_if(F.col("Split") == split) for split in SPLITS},
        "rows_with_missing_features": F.count_if(any_null(FEATURES)),
    }


def check_model_table(dataset: DataFrame) -> None:
    """Raise unless the table is non-empty, has all periods, unique keys and all features."""
    check_model_report(model_table_report(dataset).first().asDict())


def check_model_report(report: Mapping[str, int]) -> None:
    """Raise on the first fault that the counts tell of."""
    if report["rows"] == 0:
        raise ValueError("No row has all nine features; look at the audit counts.")
    absent = [split for split in ("train", "validation", "test") if report[f"{split}_rows"] == 0]
    if absent:
        raise ValueError(f"These periods have no rows: {absent}. Check the dates and the price history.")
    if report["repeated_keys"]:
        raise ValueError(f"{report['repeated_keys']} (Date, Ticker) keys occur more than once.")
    if report["rows_with_missing_features"]:
        raise ValueError(f"{report['rows_with_missing_features']} rows lack a feature.")


def dataset_counts(details: DataFrame, raw: DataFrame, dataset: DataFrame) -> DataFrame:
    """(metric, value): stocks, raw rows, known targets per period and predictable test rows."""
    known = F.col("target").isNotNull()
    rows = dataset.agg(
        *[
            F.count_if(known & (F.col("Split") == split)).alias(f"{split}_rows_with_target")
            for split in ("train", "validation", "test")
        ],
        F.count_if(F.col("Split") == "test").alias("test_rows"),
    )
    parts = [details.agg(F.count("*").alias("stocks")), raw.agg(F.count("*").alias("raw_rows")), rows]
    long = [part.unpivot([], part.columns, "metric", "value") for part in parts]
    return long[0].unionByName(long[1]).unionByName(long[2])
