"""The market calendar and the dense ticker-by-session grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessiongrid.operators.clean import CONFLICT
from sessiongrid.schema import QUOTE_COLUMNS, RAW_COLUMNS, quoted


def session_calendar(quotes: DataFrame) -> DataFrame:
    """One row per session: ``Date``, the next session's ``NextDate``, ``Session`` number
    from 1 and the number of the ``LastSession``.

    The windows have no partition key, but they run over distinct dates, of which the date
    range allows about 214 thousand.
    """
    in_order = Window.orderBy("Date")
    return (
        quotes.select("Date")
        .distinct()
        .select(
            "Date",
            F.lead("Date").over(in_order).alias("NextDate"),
            F.row_number().over(in_order).alias("Session"),
            F.count("*").over(Window.partitionBy()).cast("int").alias("LastSession"),
        )
    )


def densify(quotes: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Every ticker at every session, with missing quotes where it has no row.

    Adds ``Inserted``. There is no ticker-by-date product and no join against one: each quote
    emits itself and the gap up to the ticker's next quote. The calendar is the only other
    input; it is bounded, so it is broadcast to number the sessions and serves as one array
    of dates to cut the gaps from. After the one shuffle by ticker, a ticker has at most one
    row per session, so no ticker can be a hot key.

    Two quotes at one session are a conflict and fail the job.
    """
    if calendar is None:
        calendar = session_calendar(quotes)
    by_ticker = Window.partitionBy("Ticker").orderBy("Date")
    dates = calendar.agg(F.array_sort(F.collect_list("Date"))).scalar()
    here, following = F.col("Session"), F.col("_following")
    start = F.when(F.col("_first"), F.lit(1)).otherwise(here)
    gap = F.slice(dates, start, F.coalesce(following, F.col("LastSession") + 1) - start)
    conflict = F.raise_error(F.concat_ws(" ", F.lit(CONFLICT + ":"), F.col("Date").cast("string"), F.col("Ticker")))

    filled = (
        quotes.join(F.broadcast(calendar.select("Date", "Session", "LastSession")), "Date")
        .withColumns(
            {
                "_following": F.lead("Session").over(by_ticker),
                "_first": F.lag("Session").over(by_ticker).isNull(),
            }
        )
        .withColumn("_at", F.explode(F.when(following == here, conflict).otherwise(gap)))
    )
    own = F.col("_at") == F.col("Date")
    others = [name for name in quotes.columns if name not in RAW_COLUMNS]
    return filled.select(
        "Ticker",
        F.col("_at").alias("Date"),
        *[F.when(own, F.col(quoted(name))).alias(name) for name in [*QUOTE_COLUMNS, *others]],
        (~own).alias("Inserted"),
    )
