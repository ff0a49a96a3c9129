"""Average ranks within a session, without putting a whole session into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessiongrid.schema import quoted, require_date

RANGES = 64
HOT = 1_000_000  # rows of one value on one date that one task still joins
SALTS = 64


def daily_ranks(df: DataFrame, value: str, out: str, *, pct: bool = True, ranges: int = RANGES) -> DataFrame:
    """(Date, value, rank): the ascending rank of every known value among those of its ``Date``.

    Ties share their average rank; ``pct`` divides by the number of known values. ``Date`` must
    be of type date, as made by ``to_session_date``.

    A session may hold any number of stocks, and a large part of them may share one value
    (unchanged prices all return 0). So no window is ever partitioned by ``Date`` alone:

    * equal values are counted first, which collapses them before the shuffle;
    * up to ``ranges`` values per session, chosen by hash and therefore the same in every
      evaluation, cut the distinct values into ranges; each range is ordered in its own task;
    * a range starts at the number of rows in the ranges before it.

    More ranges suit sessions of very many distinct values. The table of cuts has one row of at
    most ``ranges`` numbers per session; Spark broadcasts it if it is small.
    """
    require_date(df)
    val = F.col(quoted(value))
    ties = df.filter(val.isNotNull()).groupBy("Date", val.alias("_value")).agg(F.count("*").alias("_ties"))
    # Always true; it keeps the plan of `ties` the same for all its uses, so they share one shuffle.
    ties = ties.filter(F.col("_ties") > 0)

    cuts = (
        ties.groupBy("Date", F.pmod(F.xxhash64("_value"), F.lit(ranges)).alias("_slot"))
        .agg(F.min_by("_value", F.xxhash64(F.lit("cut"), F.col("_value"))).alias("_cut"))
        .groupBy("Date")
        .agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))
    )
    ranged = ties.join(cuts, "Date").select(
        "Date",
        "_value",
        "_ties",
        F.size(F.filter("_cuts", lambda cut: cut < F.col("_value"))).alias("_range"),
    )

    by_date = Window.partitionBy("Date")
    before = by_date.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("Date", "_range")
        .agg(F.sum("_ties").alias("_rows"))
        .select(
            "Date",
            "_range",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
            F.sum("_rows").over(by_date).alias("_known"),
        )
    )

    below = Window.partitionBy("Date", "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    rank = (
        F.col("_before") + F.coalesce(F.col("_below"), F.lit(0)) + (F.col("_ties") + F.lit(1.0)) / F.lit(2.0)
    )
    return (
        ranged.withColumn("_below", F.sum("_ties").over(below))
        .join(starts, ["Date", "_range"])
        .select("Date", F.col("_value").alias(value), (rank / F.col("_known") if pct else rank).alias(out))
    )


def join_ranks(rows: DataFrame, ranked: DataFrame, value: str, out: str, *, pct: bool = True, hot: int = HOT, how: str = "left") -> DataFrame:
    """``rows`` with the rank ``out`` of their ``value`` among those of ``ranked``, see ``daily_ranks``.

    A value shared by ``hot`` or more rows of one date is spread over ``SALTS`` tasks, with a copy of its rank for
    each. There is at most one such value for each ``hot`` rows (some 20 MB for 10**12 rows), so their list is
    broadcast. Rows without a value match nothing and are spread as well.
    """
    hash_of_row = F.xxhash64(*[quoted(name) for name in rows.columns])
    missing = F.col(quoted(value)).isNull()
    ranks = daily_ranks(ranked, value, out, pct=pct).withColumnsRenamed({"Date": "_date", value: "_value"})
    many = (
        ranked.filter(~missing).groupBy("Date", F.col(quoted(value)).alias("_many")).agg(F.count("*").alias("_ties")).filter(F.col("_ties") >= hot)
    ).select(F.col("Date").alias("_day"), "_many", F.lit(True).alias("_hot"))
    many = F.broadcast(many)
    is_hot = lambda day, v: (F.col(day) == F.col("_day")) & (v == F.col("_many"))
    salt = F.when(missing | F.col("_hot"), F.pmod(hash_of_row, F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    marked = rows.join(many, is_hot("Date", F.col(quoted(value))), "left").withColumn("_salt", salt)
    copies = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    copied = ranks.join(many, is_hot("_date", F.col("_value")), "left").select("_date", "_value", out, copies.alias("_part"))
    same = (F.col("Date") == F.col("_date")) & (F.col(quoted(value)) == F.col("_value")) & (F.col("_salt") == F.col("_part"))
    return marked.join(copied, same, how).select(*[quoted(name) for name in rows.columns], quoted(out))


def add_daily_rank(df: DataFrame, value: str, out: str, *, pct: bool = True, hot: int = HOT) -> DataFrame:
    """Add the rank of ``value`` from ``daily_ranks``; a missing value has none.

    ``df`` is used for its rows and for its ranks; pass a written table if it is expensive.
    """
    rows = df.select(*[quoted(name) for name in df.columns if name != out])
    return join_ranks(rows, df, value, out, pct=pct, hot=hot)
