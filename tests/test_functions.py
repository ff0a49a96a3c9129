"""Parsing tables, contracts, and ranks against brute force."""

from __future__ import annotations

import datetime as dt
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid import add_date_splits, model_inputs, prepare_price_panel
from sessiongrid.functions.columns import date_format_report, infer_date_format, normalize_ticker, to_finite_double, to_session_date
from sessiongrid.functions.ranks import add_daily_rank, join_ranks
from sessiongrid.functions.rolling import add_rolling, series
from sessiongrid.operators.clean import check_quotes, clean_quotes, unusable_keys
from sessiongrid.operators.details import check_details, clean_details, details_issues, join_details
from sessiongrid.schema import pick_table, require_columns
from tests import market


def one_column(spark, expression, values, type_name="string"):
    rows = [(i, value) for i, value in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {type_name}").select("i", expression(F.col("x")).alias("y"))
    return [row["y"] for row in df.orderBy("i").collect()]


def test_date_text(spark):
    day = dt.date(2021, 5, 6)
    cases = {
        "2021-05-06": day,
        "  2021-05-06 ": day,
        "2021-5-6": day,
        "2021-05-06 23:59:59": day,
        "2021-05-06T23:30:00-05:00": dt.date(2021, 5, 7),
        "2021-05-06T01:30:00+02:00": dt.date(2021, 5, 5),
        "2021-05-06T23:30:00.25Z": day,
        "2021": None,
        "2021-05": None,
        "2021-05-06T": day,
        "12:30": None,
        "06/05/2021": None,
        "2021-02-30": None,
        "later": None,
        "": None,
        None: None,
        "1600-01-01": None,
        "2300-01-01": None,
        "1677-09-20": None,
        "1677-09-21": dt.date(1677, 9, 21),
        "2262-04-11T23:59Z": dt.date(2262, 4, 11),
        "2262-04-12": None,
        "2021-05-06 23:30-05:00": dt.date(2021, 5, 7),
        "2021-5-6 23:30-5": dt.date(2021, 5, 7),
        "2021-05-06T01:15:00.5+0530": dt.date(2021, 5, 5),
        "2021-05-06 00:10 -0:30": day,
        "2021-05-06 23:30:00 America/New_York": None,
        "20210506": day,
        "20210506 23:30-05": dt.date(2021, 5, 7),
        "2021/05/06": day,
        "2021/5/6 07:00": day,
        "2021-05/06": None,
        "2021-05-06 25:00": None,
    }
    assert one_column(spark, lambda c: to_session_date(c, T.StringType()), list(cases)) == list(cases.values())
    with_format = one_column(spark, lambda c: to_session_date(c, T.StringType(), "dd/MM/yyyy"), ["06/05/2021", "2021-05-06"])
    assert with_format == [day, None]
    with pytest.raises(ValueError, match="dates"):
        to_session_date(F.lit(1), T.LongType())


def test_text_keys_are_read_once(spark):
    """Neither a filter on the keys nor a lambda makes Spark read a text a second time or without compiled code."""
    rows = [("2021-05-06 23:30-5", " s.1 "), ("2021-05-06|1|2", "S.1"), ("2021-05-06", "  "), ("later", None), (None, "S.1")]
    raw = spark.createDataFrame(rows, "Date string, Ticker string")
    raw = raw.select("*", *[F.lit(1.0).alias(name) for name in ("Open", "High", "Low", "Close", "Adj Close", "Volume")])
    quotes = clean_quotes(raw)
    assert [(row["Date"], row["Ticker"]) for row in quotes.collect()] == [(dt.date(2021, 5, 7), "S-1")]
    plan = quotes._jdf.queryExecution().optimizedPlan().toString()
    reading = [line for line in plan.splitlines() if "regexp_replace" in line]
    assert len(reading) == 1 and "Project" in reading[0] and "lambda" not in reading[0]


def test_ticker_text(spark):
    cases = {" brk.b ": "BRK-B", "\tbf.b\n": "BF-B", " x ": "X", "a b": "A B", "": "", " ": "", None: None, "straße": "STRASSE"}
    assert one_column(spark, normalize_ticker, list(cases)) == list(cases.values())
    assert one_column(spark, lambda c: normalize_ticker(c, upper=False), [" brk.b "]) == ["brk-b"]


def test_number_text(spark):
    cases = {
        "12": 12.0, " 12 ": 12.0, "1e3": 1000.0, ".5": 0.5, "-7": -7.0, "1.5d": None, "2f": None, "1,000": None,
        "0x1A": None, "1_000": None, "inf": None, "-Infinity": None, "nan": None, "": None, "many": None, None: None,
    }
    assert one_column(spark, lambda c: to_finite_double(c, T.StringType()), list(cases)) == list(cases.values())
    values = [1.5, float("nan"), float("inf"), float("-inf"), None]
    assert one_column(spark, lambda c: to_finite_double(c, T.DoubleType()), values, "double") == [1.5] + [None] * 4
    assert one_column(spark, lambda c: to_finite_double(c, T.BooleanType()), [True, False], "boolean") == [1.0, 0.0]


def brute_ranks(values):
    known = [value for value in values if value is not None]
    below = lambda v: sum(1 for other in known if other < v)
    return [None if v is None else (below(v) + (known.count(v) + 1) / 2) / len(known) for v in values]


@pytest.mark.parametrize("shape", ["spread", "one hot value", "all equal", "near constant", "mostly missing", "few"])
def test_daily_rank_equals_brute_force(spark, shape):
    pick = random.Random(shape)
    make = {
        "spread": lambda: pick.gauss(0, 0.02),
        "one hot value": lambda: 0.0 if pick.random() < 0.5 else round(pick.gauss(0, 1), 3),
        "all equal": lambda: -0.25,
        "near constant": lambda: 0.0005 + pick.random() * 1e-12 if pick.random() < 0.99 else pick.gauss(0, 100),
        "mostly missing": lambda: pick.random() if pick.random() < 0.05 else None,
        "few": lambda: float(pick.randint(0, 3)),
    }[shape]
    size = 6 if shape == "few" else 600
    data = {dt.date(2021, 1, day): [make() for _ in range(size)] for day in (4, 5, 6)}
    rows = [(day, f"T{i}", value) for day, values in data.items() for i, value in enumerate(values)]
    df = spark.createDataFrame(rows, "Date date, Ticker string, v double")
    found = {(r["Date"], r["Ticker"]): r["rank"] for r in add_daily_rank(df, "v", "rank").collect()}
    assert len(found) == len(rows)
    for day, values in data.items():
        for i, rank in enumerate(brute_ranks(values)):
            assert found[day, f"T{i}"] == (None if rank is None else pytest.approx(rank, abs=1e-12))


def test_a_hot_value_is_spread_over_tasks(spark):
    """One value in half of a day's rows: no task of the join back gets much more than its share."""
    day = dt.date(2021, 1, 4)
    rows = [(day, f"T{i}", 0.0 if i % 2 else float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "Date date, Ticker string, v double").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        largest = {}
        for hot in (1_000_000, 100):
            ranked = join_ranks(df, df, "v", "rank", hot=hot)
            sizes = ranked.groupBy(F.spark_partition_id()).count().collect()
            largest[hot] = max(row["count"] for row in sizes)
            found = {row["Ticker"]: row["rank"] for row in ranked.collect()}
            expected = brute_ranks([v for _, _, v in rows])
            assert all(found[t] == pytest.approx(rank, abs=1e-12) for (_, t, _), rank in zip(rows, expected, strict=True))
        assert largest[1_000_000] > 2000 and largest[100] < 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("shape", ["prices of 1e9", "one huge value", "gaps", "volumes", "constant"])
def test_rolling_moments_equal_exact_sums(spark, shape):
    pick = random.Random(shape)
    values = {
        "prices of 1e9": lambda i: 1e9 + i * 1e-6 + pick.random() * 1e-5,
        "one huge value": lambda i: 1e12 if i == 3 else pick.gauss(0, 1e-3),
        "gaps": lambda i: None if pick.random() < 0.05 else pick.gauss(5, 2),
        "volumes": lambda i: float(pick.randint(1, 10**12)),
        "constant": lambda i: 0.1,
    }[shape]
    line = [values(i) for i in range(150)]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(line)] + [("B", i, 1.0) for i in range(3)], "k string, i int, v double")
    window = Window.partitionBy("k").orderBy("i")
    lengths = [1, 2, 5, 7, 20, 60]
    made = add_rolling(df, window, {"v": series("v", window)}, means={f"m{n}": ("v", n) for n in lengths}, deviations={f"d{n}": ("v", n) for n in lengths if n > 1})
    assert made.columns == ["k", "i", "v", *[f"m{n}" for n in lengths], *[f"d{n}" for n in lengths if n > 1]]
    for row in made.filter("k = 'A'").collect():
        for n in lengths:
            own = line[row["i"] - n + 1 : row["i"] + 1] if row["i"] >= n - 1 else [None]
            if None in own:
                assert row[f"m{n}"] is None and (n == 1 or row[f"d{n}"] is None)
                continue
            exact = [Fraction(v) for v in own]
            mean = sum(exact) / n
            assert row[f"m{n}"] == pytest.approx(float(mean), rel=1e-14)
            if n > 1:
                deviation = math.sqrt(sum((v - mean) ** 2 for v in exact) / (n - 1))
                assert row[f"d{n}"] == pytest.approx(deviation, rel=1e-9, abs=1e-17)


def test_one_format_for_a_column(spark):
    def chosen(*texts):
        return infer_date_format(spark.createDataFrame([(t,) for t in texts], "Date string"))

    assert chosen("2021-05-06", " ", None, "20210507") is None
    assert chosen("6 May 2021", "17 March 2021") == "d MMMM yyyy"
    assert chosen("06/05/2021", "17/05/2021 ") == "d/M/yyyy"
    assert chosen("soon", "17/05/2021") is None and chosen(None) is None
    with pytest.raises(ValueError, match="several ways.*M/d/yyyy.*d/M/yyyy"):
        chosen("06/05/2021", "07/05/2021")
    # Both formats read the same days, so nothing is open.
    assert chosen("5/5/2021", "06/06/2021") == "M/d/yyyy"
    assert infer_date_format(spark.createDataFrame([(dt.date(2021, 1, 1),)], "Date date")) is None


def test_equal_texts_are_read_once(spark):
    """Formats are tried above the grouping of equal texts, and rows are counted all the same."""
    texts = ["6/5/2021"] * 3 + [" 6/5/2021 "] * 2 + ["13/5/2021", " ", None, "soon"]
    report = date_format_report(spark.createDataFrame([(t,) for t in texts], "Date string"))
    found = {row["format"]: (row["rows"], row["fits"]) for row in report.collect()}
    assert found["M/d/yyyy"] == (7, 5) and found["d/M/yyyy"] == (7, 6) and found["iso"] == (7, 0)
    above, grouping, below = report._jdf.queryExecution().optimizedPlan().toString().partition("Aggregate [Date")
    assert grouping and "gettimestamp" in above and "gettimestamp" not in below and "Filter" not in below
    empty = date_format_report(spark.createDataFrame([], "Date string")).collect()
    assert {(row["rows"], row["fits"]) for row in empty} == {(0, 0)}


def test_inferred_dates_reach_the_panel(spark):
    data = [dict(row, Date=dt.date.fromisoformat(row["Date"]).strftime("%d.%m.%Y")) for row in market.rows()]
    panel = prepare_price_panel(market.frame(spark, data), date_format="infer", validate=False).panel
    expected = prepare_price_panel(market.frame(spark, market.rows()), validate=False).panel
    assert {k: tuple(v) for k, v in market.by_key(panel).items()} == {k: tuple(v) for k, v in market.by_key(expected).items()}
    faults = {row["reason"]: row["rows"] for row in unusable_keys(market.frame(spark, data), date_format="infer").collect()}
    assert faults == {"unreadable_date": 0, "date_out_of_range": 0, "missing_ticker": 0}


def test_negative_zero_ties_with_zero(spark):
    rows = [(dt.date(2021, 1, 4), name, value) for name, value in (("A", -0.0), ("B", 0.0), ("C", 1.0))]
    df = spark.createDataFrame(rows, "Date date, Ticker string, v double")
    found = {r["Ticker"]: r["rank"] for r in add_daily_rank(df, "v", "rank", pct=False).collect()}
    assert found == {"A": 1.5, "B": 1.5, "C": 3.0}


def test_rank_plan_never_partitions_rows_by_date_alone(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 4), "A", 1.0)], "Date date, Ticker string, v double")
    plan = add_daily_rank(df, "v", "rank")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "+- Window" in line or "- Window" in line]
    # Windows by date alone run over the ranges, of which a date has at most 65.
    assert all("_rows" in line for line in windows if "[Date" in line and "_ties" not in line)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_missing_columns_are_listed_sorted(spark):
    df = market.frame(spark, market.rows()).drop("Volume", "Low")
    with pytest.raises(ValueError, match=r"\['Low', 'Volume'\]"):
        prepare_price_panel(df)
    with pytest.raises(ValueError, match="nope"):
        require_columns(df, ["nope"])


def test_empty_input(spark):
    none = market.frame(spark, market.rows()).withColumn("Ticker", F.lit(" "))
    with pytest.raises(ValueError, match="Not a single row"):
        check_quotes(clean_quotes(none))


def test_model_inputs_refuse_labels(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "ret_1d double, target double, target_rank double")
    assert model_inputs(df, ["ret_1d"]).columns == ["ret_1d", "target"]
    with pytest.raises(ValueError, match="target_rank"):
        model_inputs(df, ["ret_1d", "target_rank"])


def test_pick_table(spark):
    first = spark.createDataFrame([(1,)], "a int")
    second = spark.createDataFrame([(1, 2, 3)], "c int, b int, a int")
    assert pick_table([first, second], ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError, match="No candidate"):
        pick_table([first], ["a", "b"])


@pytest.mark.parametrize("cutoffs", [("2021-01-01", "2021-01-01"), ("2021-02-01", "2021-01-01"), ("x", "2021-01-01"), (None, None)])
def test_cutoffs_must_be_ordered_dates(spark, cutoffs):
    df = spark.createDataFrame([], "Date date, LabelEndDate date, Ticker string")
    with pytest.raises(ValueError):
        add_date_splits(df, *cutoffs)


def test_split_needs_dates(spark):
    df = spark.createDataFrame([("A", None, None)], "Ticker string, Date date, LabelEndDate date")
    with pytest.raises(ValueError, match="no Date"):
        add_date_splits(df)
    with pytest.raises(Exception, match="no Date"):
        add_date_splits(df, validate=False).collect()


def test_details_contract(spark):
    panel = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "Ticker string, Close double")
    frame = lambda rows: spark.createDataFrame(rows, "Ticker string, Sector string")
    joined = join_details(panel, frame([(" a ", "x"), ("A", "x"), ("C", "z")]))
    assert {tuple(row) for row in joined.collect()} == {("A", 1.0, "x"), ("B", 2.0, None)}
    with pytest.raises(ValueError, match="one record per"):
        join_details(panel, frame([("A", "x"), ("a", "y")]))
    with pytest.raises(Exception, match="one record per"):
        join_details(panel, frame([("A", "x"), ("a", "y")]), validate=False).collect()
    for blank in (" ", None):
        with pytest.raises(ValueError, match="missing ticker"):
            join_details(panel, frame([(blank, "x")]))
    with pytest.raises(ValueError, match="no Ticker"):
        join_details(panel, spark.createDataFrame([(1,)], "Symbol int"))
    for taken in ("Close", "ret_1d"):
        with pytest.raises(ValueError, match=taken):
            join_details(panel, frame([("A", "x")]).withColumnRenamed("Sector", taken))
    only_tickers = join_details(panel, frame([("A", "x")]).select("Ticker"))
    assert only_tickers.columns == panel.columns and only_tickers.count() == 2
    issues = details_issues(clean_details(frame([("A", "x"), ("A", "y"), ("", "q")])))
    assert {tuple(row) for row in issues.collect()} == {("repeated_ticker", "A", 2), ("missing_ticker", "", 1)}
    check_details(clean_details(frame([("A", "x")])))
