"""Submission checks, rank correlation and portfolios against hand computations."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sessiongrid.operators.clean import clean_quotes
from sessiongrid.operators.grid import session_calendar
from sessiongrid.operators.portfolio import (
    benchmark_selection,
    daily_returns,
    portfolio_metrics,
    select_top,
    trades,
    uncovered_dates,
)
from sessiongrid.operators.scoring import check_submission, daily_spearman, spearman_summary, submission_issues
from sessiongrid.plans.backtest import BENCHMARK, MODEL, backtest, write_backtest
from sessiongrid.sources.files import normalize_predictions

D = [dt.date(2024, 1, day) for day in (2, 3, 4, 5, 8)]
PREDICTED = "Date date, Ticker string, prediction double"
BARS = "Date date, Ticker string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double"
QUOTED = "Date date, Ticker string, Open double, Close double"


def test_submission_issues(spark):
    eligible = spark.createDataFrame([(D[0], t) for t in "ABCD"], "Date date, Ticker string")
    rows = [(D[0], "A", 1.0), (D[0], "B", 1.0), (D[0], "B", 1.0), (D[0], "C", math.nan), (D[1], "A", 2.0)]
    predictions = normalize_predictions(spark.createDataFrame(rows, PREDICTED))
    found = {tuple(row) for row in submission_issues(predictions, eligible).collect()}
    assert found == {
        ("duplicate", D[0], "B"), ("not_finite", D[0], "C"), ("missing", D[0], "D"), ("extra", D[1], "A"),
    }
    with pytest.raises(ValueError, match="'duplicate': 1.*'missing': 1"):
        check_submission(predictions, eligible)
    check_submission(eligible.withColumn("prediction", F.lit(0.0)), eligible)


def ranks(values):
    return [sum(o < v for o in values) + (values.count(v) + 1) / 2 for v in values]


def test_daily_spearman(spark, tmp_path):
    pick = random.Random(5)
    rows = [(D[0], f"T{i}", float(pick.randint(0, 9)), pick.gauss(0, 1)) for i in range(40)]
    rows += [(D[1], f"T{i}", 1.0, pick.gauss(0, 1)) for i in range(5)]
    rows += [(D[2], "T0", 1.0, 0.5), (D[3], "T0", 1.0, None), (D[4], "T0", 2.0, 0.1), (D[4], "T1", 1.0, 0.2)]
    rows += [(D[4], "T2", None, 0.4)]
    df = spark.createDataFrame(rows, "Date date, Ticker string, prediction double, target double")
    daily = daily_spearman(df.drop("target"), df.drop("prediction"))
    found = daily.collect()
    scores = {row["Date"]: (row["n"], row["score"]) for row in found}
    reasons = {row["Date"]: row["undefined"] for row in found}
    assert reasons == {D[0]: None, D[1]: "constant", D[2]: "constant", D[3]: "no_known_target", D[4]: None}
    written = daily_spearman(df.drop("target"), df.drop("prediction"), scratch=str(tmp_path / "pairs"))
    again = {row["Date"]: row["score"] for row in written.collect()}
    assert again == {day: pytest.approx(score) if score is not None else None for day, (_, score) in scores.items()}
    a, b = ([row[i] for row in rows if row[0] == D[0]] for i in (2, 3))
    assert scores[D[0]] == (40, pytest.approx(statistics.correlation(ranks(a), ranks(b))))
    assert scores[D[1]] == (5, None) and scores[D[2]] == (1, None)
    assert scores[D[3]] == (0, None) and scores[D[4]] == (2, pytest.approx(-1.0))
    summary = spearman_summary(daily).first()
    assert (summary["scored_dates"], summary["undefined_dates"]) == (2, 3)
    assert summary["mean_score"] == pytest.approx((scores[D[0]][1] - 1.0) / 2)


def test_select_top(spark):
    rows = [(D[0], f"T{i:02d}", float(-(i // 2))) for i in range(25)] + [(D[1], "A", 0.1), (D[1], "B", None)]
    top = select_top(spark.createDataFrame(rows, PREDICTED))
    by_date = {}
    for row in top.orderBy("Date", "slot").collect():
        by_date.setdefault(row["Date"], []).append((row["slot"], row["Ticker"]))
        assert row["weight"] == 0.1
    assert by_date[D[0]] == [(i + 1, f"T{i:02d}") for i in range(10)]
    assert by_date[D[1]] == [(1, "A")]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_trades_and_daily_returns(spark):
    quotes = spark.createDataFrame(
        [(D[0], t, 9.0, 9.0) for t in "ABC"]
        + [(D[1], "A", 10.0, 11.0), (D[1], "C", 5.0, 4.0)]
        + [(D[2], "A", 10.0, None), (D[2], "B", -1.0, 3.0), (D[2], "C", 2.0, 2.0)],
        QUOTED,
    )
    chosen = spark.createDataFrame([(day, t, 0.1) for day in D[:3] for t in "ABC"], "Date date, Ticker string, weight double")
    calendar = session_calendar(quotes)
    done = trades(chosen, calendar, quotes)
    rows = {(row["Date"], row["Ticker"]): row for row in done.collect()}
    assert set(rows) == {(day, t) for day in D[:2] for t in "ABC"}
    a, b, c = (rows[D[0], t] for t in "ABC")
    assert (a["status"], b["status"], c["status"]) == ("filled", "cash_no_open", "filled")
    assert a["EntryDate"] == D[1] and a["gross"] == pytest.approx(0.01)
    assert a["net"] == pytest.approx(0.1 * (0.1 - 0.001 - 0.001 * 1.1))
    assert b["gross"] == b["net"] == 0.0 and c["gross"] == pytest.approx(-0.02)
    assert rows[D[1], "A"]["status"] == "unresolved" and rows[D[1], "A"]["net"] is None
    assert rows[D[1], "B"]["status"] == "cash_no_open"
    daily = {row["Date"]: row for row in daily_returns(done).collect()}
    assert daily[D[0]]["gross"] == pytest.approx(-0.01) and daily[D[0]]["cash_slots"] == 1
    assert daily[D[1]]["unresolved"] == 1 and daily[D[1]]["gross"] is None and daily[D[1]]["net"] is None
    assert [row["Date"] for row in uncovered_dates(chosen, calendar).collect()] == [D[2]]


def test_quotes_are_cut_to_entry_dates_where_they_are_read(spark):
    bars = spark.createDataFrame([(D[0], "A", *[1.0] * 6), (D[1], "A", *[1.0] * 6)], BARS)
    quotes = clean_quotes(bars)
    chosen = spark.createDataFrame([(D[0], "A", 0.1)], "Date date, Ticker string, weight double")
    plan = trades(chosen, session_calendar(quotes), quotes)._jdf.queryExecution().optimizedPlan().toString()
    # The copies are removed above the filter by date, so only quotes of entry dates are shuffled.
    semi = next(line for line in plan.splitlines() if "LeftSemi" in line)
    copies = next(line for line in plan.splitlines() if "Aggregate" in line and "Adj Close" in line)
    assert semi.index("Join") > copies.index("Aggregate")


def test_conflicting_quotes_are_not_traded(spark):
    quotes = spark.createDataFrame([(D[0], "A", 1.0, 1.0), (D[1], "A", 1.0, 2.0), (D[1], "A", 1.0, 1.5)], QUOTED)
    chosen = spark.createDataFrame([(D[0], "A", 0.1)], "Date date, Ticker string, weight double")
    with pytest.raises(PySparkException, match="Conflicting quotes"):
        trades(chosen, session_calendar(quotes), quotes).collect()


def test_dates_have_to_be_dates(spark):
    quotes = spark.createDataFrame([(D[0], "A", 1.0, 1.0)], QUOTED)
    chosen = spark.createDataFrame([("2024-01-02", "A", 0.1)], "Date string, Ticker string, weight double")
    with pytest.raises(ValueError, match="has to be a date"):
        trades(chosen, session_calendar(quotes), quotes)
    with pytest.raises(ValueError, match="has to be a date"):
        benchmark_selection(chosen)


@pytest.mark.parametrize("kind", ["double", "string"])
def test_only_finite_predictions_count(spark, kind):
    rows = [(D[0], t, v) for t, v in zip("ABCDE", (1.0, math.nan, math.inf, -math.inf, 3.0), strict=True)]
    given = spark.createDataFrame(rows, "Date date, Ticker string, prediction double")
    given = given.withColumn("prediction", F.col("prediction").cast(kind))
    assert [r["Ticker"] for r in select_top(given, 2).orderBy("slot").collect()] == ["E", "A"]
    issues = {(r["issue"], r["Ticker"]) for r in submission_issues(given, given).collect()}
    assert issues == {("not_finite", t) for t in "BCD"}


def test_benchmark_weights(spark):
    eligible = spark.createDataFrame([(D[0], t) for t in "ABCD"] + [(D[1], "A")], "Date date, Ticker string")
    rows = {(row["Date"], row["Ticker"]): row["weight"] for row in benchmark_selection(eligible).collect()}
    assert rows[D[0], "C"] == 0.25 and rows[D[1], "A"] == 1.0 and len(rows) == 5


def test_metrics(spark):
    nets = {"a": [-0.1, 0.05, -0.2, 0.3], "flat": [0.0, 0.0, 0.0, 0.0], "open": [0.1, None, 0.1, 0.1]}
    rows = [(name, D[i], D[i + 1], net, net) for name, series in nets.items() for i, net in enumerate(series)]
    df = spark.createDataFrame(rows, "Portfolio string, Date date, EntryDate date, gross double, net double")
    found = {row["Portfolio"]: row for row in portfolio_metrics(df).collect()}
    a = found["a"]
    assert a["cumulative_net"] == pytest.approx(0.9 * 1.05 * 0.8 * 1.3 - 1)
    assert a["max_drawdown"] == pytest.approx(0.9 * 1.05 * 0.8 - 1)
    assert a["sharpe"] == pytest.approx(statistics.mean(nets["a"]) / statistics.stdev(nets["a"]) * math.sqrt(252))
    assert (a["first_date"], a["last_date"], a["last_exit"], a["days"]) == (D[0], D[3], D[4], 4)
    assert found["flat"]["sharpe"] is None and found["flat"]["max_drawdown"] == 0.0
    unresolved = found["open"]
    assert unresolved["unresolved_days"] == 1
    assert all(unresolved[name] is None for name in ("cumulative_gross", "cumulative_net", "sharpe", "max_drawdown"))


@pytest.fixture(scope="module")
def market_days(spark):
    """Five sessions of twelve stocks; nothing is eligible at the third."""
    raw = [
        (day, f"T{i:02d}", 100.0, 103.0 + i, 90.0, 100.0 + (i - 4) * (n + 1) / 10, 100.0, 1000.0)
        for n, day in enumerate(D)
        for i in range(12)
    ]
    quotes = spark.createDataFrame(
        raw, "Date date, Ticker string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double"
    )
    rows = [(day, f"T{i:02d}", "test", None if day == D[4] else i / 100) for day in D if day != D[2] for i in range(12)]
    dataset = spark.createDataFrame(rows, "Date date, Ticker string, Split string, target double")
    predictions = dataset.select("Date", "Ticker", (F.substring("Ticker", 2, 2).cast("double") / 50).alias("prediction"))
    return predictions, quotes, dataset


def test_backtest(market_days):
    result = backtest(*market_days)
    daily = {(row["Portfolio"], row["Date"]): row for row in result.daily.collect()}
    # The last session has no next one; the third has no stocks and is a day in cash.
    assert set(daily) == {(name, day) for name in (MODEL, BENCHMARK) for day in D[:4]}
    assert daily[MODEL, D[2]]["gross"] == daily[MODEL, D[2]]["net"] == 0.0 and daily[MODEL, D[2]]["filled"] == 0
    moves = [(i - 4) * 2 / 1000 for i in range(12)]
    assert daily[MODEL, D[0]]["gross"] == pytest.approx(statistics.mean(moves[2:]))
    assert daily[BENCHMARK, D[0]]["gross"] == pytest.approx(statistics.mean(moves))
    cost = statistics.mean(0.001 + 0.001 * (1 + move) for move in moves[2:])
    assert daily[MODEL, D[0]]["net"] == pytest.approx(statistics.mean(moves[2:]) - cost)
    results = {row["Portfolio"]: row for row in result.results.collect()}
    model, market = results[MODEL], results[BENCHMARK]
    assert model["uncovered_dates"] == str(D[4]) and [row["Date"] for row in result.uncovered.collect()] == [D[4]]
    assert model["mean_score"] == pytest.approx(1.0) and model["scored_dates"] == 3 and market["mean_score"] is None
    nets = [daily[MODEL, day]["net"] for day in D[:4]]
    assert model["cumulative_net"] == pytest.approx(math.prod(1 + net for net in nets) - 1)
    assert model["cost_per_side"] == 0.001 and model["slots"] == 10 and model["days_per_year"] == 252
    assert model["last_exit"] == D[4] and "next session open" in model["rules"]
    assert result.trades.filter(F.col("Portfolio") == MODEL).count() == 30


def test_backtest_without_checks(market_days):
    predictions, quotes, dataset = market_days
    stray = predictions.withColumn("Ticker", F.lit("T99"))
    plain, other = backtest(*market_days), backtest(predictions.unionByName(stray), quotes, dataset, validate=False)
    assert sorted(map(str, plain.daily.collect())) == sorted(map(str, other.daily.collect()))
    twice = quotes.unionByName(quotes.filter("Ticker = 'T05'").withColumn("Volume", F.lit(7.0)))
    with pytest.raises(ValueError, match="Conflicting quotes"):
        backtest(predictions, twice, dataset)
    with pytest.raises(PySparkException, match="Conflicting quotes"):
        backtest(predictions, twice, dataset, validate=False).daily.collect()


def test_quotes_are_evaluated_once_for_all_results(spark, market_days, tmp_path):
    """With a scratch path no result reads the quotes again, and all are the same as without it."""
    predictions, quotes, dataset = market_days
    quotes.write.parquet(str(tmp_path / "quotes"))
    given = predictions, spark.read.parquet(str(tmp_path / "quotes")), dataset
    plain, once = backtest(*given), backtest(*given, scratch=str(tmp_path / "scratch"))
    for name in ("daily", "results", "trades", "uncovered"):
        plan = getattr(once, name)._jdf.queryExecution().executedPlan().toString()
        assert f"{tmp_path}/quotes" not in plan and f"{tmp_path}/quotes" in getattr(plain, name)._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, getattr(plain, name).collect())) == sorted(map(str, getattr(once, name).collect()))


def test_backtest_results_can_be_written(spark, market_days, tmp_path):
    result = backtest(*market_days)
    for format in ("csv", "parquet"):
        write_backtest(result, str(tmp_path / format), format)
    saved = spark.read.option("header", True).csv(str(tmp_path / "csv" / "results"))
    assert saved.columns == result.results.columns and saved.count() == 2
    assert spark.read.parquet(str(tmp_path / "parquet" / "trades")).count() == result.trades.count()


def test_backtest_refuses_incomplete_submissions(market_days):
    predictions, quotes, dataset = market_days
    with pytest.raises(ValueError, match="'missing': 4"):
        backtest(predictions.filter("Ticker <> 'T03'"), quotes, dataset)
