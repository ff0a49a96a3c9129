"""Quote feeds derived from the given tables.

The tables hold no stock quotes, so a supplier stands for a stock and a month for a session:
a bar summarises the unit prices of the supplier's lines shipped in that month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongrid.schema import QUOTE_COLUMNS, RAW_COLUMNS, quoted

TRAIN_END = "2000-09-30"
VALIDATION_END = "2001-03-31"
# A month of the test period, counted from year 0, in which some stocks cannot be traded.
LATE_MONTH = 2001 * 12 + 4
# More than any price in cents.
_DAY = 10**10
# Fixed value: the nation table has 25 rows at every scale factor.
NATIONS = [f"NATION_{i}" for i in range(25)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars_by(lines: DataFrame, *keys: str) -> DataFrame:
    """Monthly bars of unit prices in cents.

    The open is the lowest price of the first day with a line, the close the highest of the
    last day. Day and price share one integer, so that plain minima and maxima find them
    and the aggregation stays a hash aggregation.
    """
    px = F.col("l_extendedprice") / F.col("l_quantity")
    adjusted = px * (F.lit(1.0) - F.col("l_discount"))
    shipped = F.col("l_shipdate").cast("date")
    cents, adjusted_cents = (F.floor(price * 100.0 + 0.5) for price in (px, adjusted))
    day = F.unix_date(shipped).cast("long") * _DAY

    def price(packed):
        return packed % _DAY / F.lit(100.0)

    return lines.groupBy(*keys, F.trunc(shipped, "MM").alias("Date")).agg(
        price(F.min(day + cents)).alias("Open"),
        price(F.max(cents)).alias("High"),
        price(F.min(cents)).alias("Low"),
        price(F.max(day + cents)).alias("Close"),
        price(F.max(day + adjusted_cents)).alias("Adj Close"),
        F.sum("l_quantity").alias("Volume"),
    )


def _keyed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars_by(table(spark, sf_dir, "lineitem"), "l_suppkey").select(
        F.concat(F.lit("S."), F.col("l_suppkey").cast("string")).alias("Ticker"),
        "Date",
        *[quoted(name) for name in QUOTE_COLUMNS],
        (F.col("l_suppkey") % 10).alias("s"),
        (F.year("Date") * 12 + F.month("Date") - 1).alias("m"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid quotes, with the natural gaps of the data; tickers are written with a dot."""
    return _keyed_bars(spark, sf_dir).select(*[quoted(name) for name in RAW_COLUMNS])


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars with bad values, exact copies, and extra rows without a usable key."""
    s, m = F.col("s"), F.col("m")
    spoiled = _keyed_bars(spark, sf_dir).withColumns(
        {
            "High": F.when((s == 3) & (m % 29 == 7), 0.01).otherwise(F.col("High")),
            "Volume": F.when((s == 4) & (m % 31 == 5), 0.0).otherwise(F.col("Volume")),
            "Close": F.when((s == 5) & (m % 37 == 11), float("inf"))
            .when((s == 1) & (m == LATE_MONTH), F.lit(None))
            .otherwise(F.col("Close")),
            "Adj Close": F.when((s == 6) & (m % 41 == 13), -1.0).otherwise(F.col("Adj Close")),
            "Open": F.when(((s == 7) & (m % 43 == 3)) | ((s == 0) & (m == LATE_MONTH)), F.lit(None)).otherwise(F.col("Open")),
        }
    )
    kinds = F.array(
        F.lit("row"),
        F.when((s == 8) & (m % 23 == 2), "copy"),
        F.when((s == 9) & (m % 19 == 4), "blank"),
        F.when((s == 2) & (m % 17 == 6), "undated"),
    )
    rows = spoiled.withColumn("kind", F.explode(F.array_compact(kinds)))
    return rows.select(
        F.when(F.col("kind") != "undated", F.col("Date")).alias("Date"),
        F.when(F.col("kind") == "blank", " \t").otherwise(F.col("Ticker")).alias("Ticker"),
        *[quoted(name) for name in QUOTE_COLUMNS],
    )


def reversal(eligible: DataFrame) -> DataFrame:
    """A stand-in model: yesterday's move reverses."""
    return eligible.select("Date", "Ticker", (F.lit(0.0) - F.col("ret_1d")).alias("prediction"))


def predictions(eligible: DataFrame) -> DataFrame:
    """The reversal, from a model that fails for some stocks (not a number, infinite), gives one
    value to all in April, and knows few stocks in every second month."""
    k, m = F.substring_index("Ticker", "-", -1).cast("int"), F.year("Date") * 12 + F.month("Date") - 1
    value = (
        F.when(k % 13 == 5, float("nan"))
        .when(k % 17 == 3, float("inf"))
        .when(m % 12 == 3, 0.25)
        .when((m % 2 == 0) | (k % 25 == 1), F.lit(0.0) - F.col("ret_1d"))
    )
    return eligible.select("Date", "Ticker", value.alias("prediction"))


def conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars with altered second records of some keys."""
    extra = F.when((F.col("s") == 1) & (F.col("m") % 13 == 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        _keyed_bars(spark, sf_dir)
        .withColumn("extra", F.explode(extra))
        .withColumn("Volume", F.col("Volume") + F.col("extra"))
        .select(*[quoted(name) for name in RAW_COLUMNS])
    )


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.withColumn("Ticker", F.concat(F.lit("S."), F.col("s_suppkey").cast("string")))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of the suppliers that are not in debt, so some tickers have none."""
    return (
        _suppliers(spark, sf_dir)
        .filter("s_acctbal > 0")
        .select("Ticker", F.col("s_name").alias("Security"), F.col("n_name").alias("Nation"))
    )


def untidy_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers, with exact copies, blank tickers and second records."""
    s = F.col("s_suppkey") % 10
    kinds = F.array(
        F.lit("row"), F.when(s == 1, "copy"), F.when(s == 2, "blank"), F.when(s == 3, "second"), F.when(s == 4, "lower")
    )
    rows = _suppliers(spark, sf_dir).withColumn("kind", F.explode(F.array_compact(kinds)))
    return rows.select(
        F.when(F.col("kind") == "blank", "  ")
        .when(F.col("kind") == "lower", F.concat(F.lit(" "), F.lower("Ticker"), F.lit("\n")))
        .otherwise(F.col("Ticker"))
        .alias("Ticker"),
        F.when(F.col("kind") == "second", "second record").otherwise(F.col("s_name")).alias("Security"),
        F.col("n_name").alias("Nation"),
    )


def expected_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers of the suppliers not in debt, and one per nation, which has no quotes."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("N."), F.col("n_nationkey").cast("string")).alias("Ticker"))
    return details(spark, sf_dir).select("Ticker").union(nations)


def wide_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per month and a ``nation/field`` column per nation and quote field."""
    lines = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    by_nation = _bars_by(lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")), "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = by_nation.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    wide = (
        named.groupBy("Date")
        .pivot("n_name", NATIONS)
        .agg(*[F.first(quoted(field)).alias(field) for field in QUOTE_COLUMNS])
    )
    names = [f"{nation}/{field}" for nation in NATIONS for field in QUOTE_COLUMNS]
    return wide.toDF("Date", *names)
