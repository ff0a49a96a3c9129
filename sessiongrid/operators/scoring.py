"""Checks of a prediction submission and its daily rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.functions.columns import to_finite_double
from sessiongrid.functions.ranks import join_ranks
from sessiongrid.sources.storage import write_table


def submission_issues(predictions: DataFrame, eligible: DataFrame) -> DataFrame:
    """(issue, Date, Ticker) rows: missing, extra, duplicate and not_finite predictions.

    Both key sets are counted in a single grouping, so one shuffle answers all four checks
    and repeated keys collapse before it.
    """
    zero, one = F.lit(0), F.lit(1)
    number = to_finite_double(F.col("prediction"), predictions.schema["prediction"].dataType)
    submitted = predictions.select(
        "Date", "Ticker", one.alias("given"), number.isNull().cast("int").alias("bad"), zero.alias("due")
    )
    expected = eligible.select("Date", "Ticker", zero.alias("given"), zero.alias("bad"), one.alias("due"))
    counts = (
        submitted.unionByName(expected)
        .groupBy("Date", "Ticker")
        .agg(*[F.sum(name).alias(name) for name in ("given", "bad", "due")])
    )
    given, bad, due = F.col("given"), F.col("bad"), F.col("due")
    issues = F.array(
        F.when((due > 0) & (given == 0), "missing"),
        F.when((due == 0) & (given > 0), "extra"),
        F.when(given > 1, "duplicate"),
        F.when(bad > 0, "not_finite"),
    )
    return counts.select(F.explode(F.array_compact(issues)).alias("issue"), "Date", "Ticker")


def check_submission(predictions: DataFrame, eligible: DataFrame) -> None:
    """Raise with the number of each issue unless the submission covers exactly the eligible keys."""
    counts = submission_issues(predictions, eligible).groupBy("issue").count().orderBy("issue")
    found = {row["issue"]: row["count"] for row in counts.collect()}
    if found:
        raise ValueError(f"The submission does not match the eligible rows: {found}")


def daily_spearman(predictions: DataFrame, dataset: DataFrame, *, scratch: str | None = None) -> DataFrame:
    """(Date, n, score, undefined) for every date with a prediction.

    The score is the correlation of average ranks over the rows that have a finite prediction
    and a known target. It is NULL where it has no value, and ``undefined`` then says why:
    ``no_known_target`` if there is no such row, ``constant`` if there is one row only or all
    predictions or all targets are equal. Plain ``corr`` would raise on those days.

    Both rankings and the scores use the matched pairs. With ``scratch``, a new path in shared
    storage that the caller removes when done, the pairs are written there once; without it
    they are matched for each use.
    """
    known = dataset.select("Date", "Ticker", "target").filter("target IS NOT NULL")
    number = to_finite_double(F.col("prediction"), predictions.schema["prediction"].dataType)
    given = predictions.select("Date", "Ticker", number.alias("prediction"))
    pairs = given.filter("prediction IS NOT NULL").join(known, ["Date", "Ticker"])
    if scratch is not None:
        write_table(pairs, scratch)
        pairs = predictions.sparkSession.read.parquet(scratch)
    ranked = join_ranks(pairs, pairs, "prediction", "_predicted", pct=False, how="inner")
    ranked = join_ranks(ranked, pairs, "target", "_realised", pct=False, how="inner")
    spread = F.stddev_pop("_predicted") * F.stddev_pop("_realised")
    scores = ranked.groupBy("Date").agg(
        F.count("*").alias("n"),
        F.try_divide(F.covar_pop("_predicted", "_realised"), spread).alias("score"),
    )
    why = F.when(F.col("n").isNull(), "no_known_target").when(F.col("score").isNull(), "constant")
    dates = given.select("Date").distinct()
    return dates.join(scores, "Date", "left").select("Date", F.coalesce("n", F.lit(0)).alias("n"), "score", why.alias("undefined"))


def spearman_summary(daily: DataFrame) -> DataFrame:
    """One row: scored and undefined dates, and the mean over the scored ones."""
    return daily.agg(
        F.count("score").alias("scored_dates"),
        F.count_if(F.col("score").isNull()).alias("undefined_dates"),
        F.avg("score").alias("mean_score"),
    )
