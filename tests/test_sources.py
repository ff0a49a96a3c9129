"""Files in and out, saved inputs, fingerprints and the whole shared-table build."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from sessiongrid import QUOTE_COLUMNS, Settings, audit_dict, build_shared_table
from sessiongrid.operators.clean import clean_quotes, quote_metrics
from sessiongrid.plans.panel import checked_panel
from sessiongrid.plans.shared_table import build_from_files
from sessiongrid.schema import EXPORT_COLUMNS
from sessiongrid.sources import files, storage
from tests import market
from tests.market import DAYS

WIDE = """Ticker,A,A,A,A,A,A,B,B
Field,Open,High,Low,Close,Adj Close,Volume,Close,Extra
Date,,,,,,,,
2024-01-02,1.0,2.0,0.5,1.5,1.4,100,7.0,9
2024-01-03,,,,,,,8.0,9
soon,1,1,1,1,1,1,1,1
"""


def test_wide_file_to_long(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text(WIDE)
    wide = files.read_wide_prices(spark, str(path))
    assert wide.pairs[:2] == [("A", "Open"), ("A", "High")] and wide.rows.count() == 3
    long = {(row["Date"], row["Ticker"]): row for row in files.wide_to_long(wide).collect()}
    second, third = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    assert set(long) == {(d, t) for d in (second, third, None) for t in "AB"}
    assert [long[second, "A"][name] for name in QUOTE_COLUMNS] == [1.0, 2.0, 0.5, 1.5, 1.4, 100.0]
    assert all(long[third, "A"][name] is None for name in QUOTE_COLUMNS)
    assert long[third, "B"]["Close"] == 8.0 and long[third, "B"]["Volume"] is None


def test_wide_file_needs_adjusted_close(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("Ticker,A\nField,Close\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="Adj Close"):
        files.read_wide_prices(spark, str(path))
    path.write_text("Ticker,A\n")
    with pytest.raises(ValueError, match="ticker line"):
        files.read_wide_prices(spark, str(path))


def test_many_tickers_unpivot(spark):
    names = [f"T{i}/{field}" for i in range(450) for field in ("Open", "Adj Close")]
    wide = spark.range(2).select(F.lit(dt.date(2024, 1, 2)).alias("Date"), *[F.lit(1.0).alias(name) for name in names])
    long = files.wide_to_long(wide)
    assert long.count() == 900 and long.select("Ticker").distinct().count() == 450


def test_constituents(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("Symbol,Security,GICS Sector,GICS Sub-Industry,Added\n brk.B ,Berk,Fin,Multi,1990\n")
    row = files.read_constituents(spark, str(path)).first()
    assert row.asDict() == {"Ticker": "brk-B", "Security": "Berk", "GICS Sector": "Fin", "GICS Sub-Industry": "Multi"}


def test_conform_and_checks(spark):
    quotes = market.frame(spark, market.rows()).withColumn("Date", F.col("Date").cast("date"))
    expected = spark.createDataFrame([("MU",), ("GHOST",)], "Ticker string")
    conformed = files.conform_tickers(quotes, expected)
    counts = {row["Ticker"]: (row["n"], row["k"]) for row in conformed.groupBy("Ticker").agg(F.count("*").alias("n"), F.count("Close").alias("k")).collect()}
    assert counts == {"MU": (90, 90), "GHOST": (90, 0)}
    files.check_raw_prices(conformed, DAYS[0], "2021-01-01")
    with pytest.raises(ValueError, match="outside"):
        files.check_raw_prices(conformed, DAYS[1], "2021-01-01")
    with pytest.raises(ValueError, match="outside"):
        files.check_raw_prices(conformed, DAYS[0], DAYS[-1])
    with pytest.raises(ValueError, match="180 keys have several rows"):
        files.check_raw_prices(conformed.union(conformed), DAYS[0], "2021-01-01")
    with pytest.raises(ValueError, match="the table is empty"):
        files.check_raw_prices(conformed.filter("false"), DAYS[0], "2021-01-01")
    with pytest.raises(ValueError, match="lacks"):
        files.check_raw_prices(conformed.drop("Adj Close"), DAYS[0], "2021-01-01")


def test_cells_with_quotes_and_short_lines(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text('Ticker,"A,1",B\nField,Adj Close,Adj Close\n\n2024-01-02,"1,5",2\n"2024-01-03","3"\n,4,5\n')
    long = {(row["Date"], row["Ticker"]): row["Adj Close"] for row in files.wide_to_long(files.read_wide_prices(spark, str(path))).collect()}
    second, third = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    # A comma is no part of a number; a line without a date stays.
    assert long == {(second, "A,1"): None, (second, "B"): 2.0, (third, "A,1"): 3.0, (third, "B"): None, (None, "A,1"): 4.0, (None, "B"): 5.0}


def test_wide_plan_does_not_grow_with_the_width(spark, tmp_path):
    def plan(tickers):
        path = tmp_path / f"wide{tickers}.csv"
        pairs = [(f"T{i}", field) for i in range(tickers) for field in QUOTE_COLUMNS]
        lines = [["", *[t for t, _ in pairs]], ["", *[f for _, f in pairs]]]
        lines += [[f"2024-01-{day:02d}", *[str(day * 1000 + i) for i in range(len(pairs))]] for day in (2, 3, 4)]
        path.write_text("\n".join(",".join(line) for line in lines) + "\n")
        long = files.wide_to_long(files.read_wide_prices(spark, str(path)))
        tree = long._jdf.queryExecution().analyzed().toJSON()
        return long, len(json.loads(tree)), tree.count('"class"')

    few, many = plan(3), plan(500)
    assert few[1:] == many[1:]
    rows = {(row["Date"].day, row["Ticker"]): row for row in many[0].collect()}
    assert len(rows) == 1500
    assert [rows[3, "T499"][name] for name in QUOTE_COLUMNS] == [3000.0 + 499 * 6 + i for i in range(6)]


def _one(spark, value):
    return spark.createDataFrame([(value,)], "x int")


def test_saved_inputs(spark, tmp_path):
    root, calls = str(tmp_path / "inputs"), []

    def loader():
        calls.append(1)
        return {name: _one(spark, len(calls)) for name in ("prices", "details")}

    def read(**options):
        return {name: df.first()["x"] for name, df in storage.cached(spark, root, loader, **options).items()}

    assert storage.saved_set(spark, root) is None
    assert read() == {"prices": 1, "details": 1}
    assert read() == {"prices": 1, "details": 1} and len(calls) == 1
    assert read(refresh=True) == {"prices": 2, "details": 2}
    assert not storage.is_complete(spark, str(tmp_path / "nowhere"))
    assert storage.drop_old_sets(spark, root) == 1 and read() == {"prices": 2, "details": 2}


def test_a_failed_save_leaves_the_set_before(spark, tmp_path):
    root = str(tmp_path / "inputs")
    storage.cached(spark, root, lambda: {"prices": _one(spark, 1), "details": _one(spark, 1)})
    old = storage.saved_set(spark, root)
    broken = _one(spark, 2).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(PySparkException, match="lost"):
        storage.cached(spark, root, lambda: {"prices": _one(spark, 2), "details": broken}, refresh=True)
    # The first table of the new set is there, but nothing reads it.
    assert storage.saved_set(spark, root) == old
    now = storage.cached(spark, root, dict)
    assert {name: df.first()["x"] for name, df in now.items()} == {"prices": 1, "details": 1}
    assert storage.drop_old_sets(spark, root) == 1


def test_a_set_that_lost_a_table_is_passed_over(spark, tmp_path):
    root = str(tmp_path / "inputs")
    for value in (1, 2):
        storage.cached(spark, root, lambda value=value: {"prices": _one(spark, value), "details": _one(spark, value)}, refresh=True)
    newest = storage.saved_set(spark, root)
    (Path(newest["details"]) / "_SUCCESS").unlink()
    found = storage.saved_set(spark, root)
    assert found and found != newest and spark.read.parquet(found["prices"]).first()["x"] == 1


def test_metrics_come_with_the_write(spark, tmp_path):
    rows = [("2024-01-02", "A", 1), ("2024-01-02", "A", 2), ("2024-01-02", "A", 3), ("2024-01-02", "B", 4), ("2024-01-03", "A", 5)]
    df = spark.createDataFrame(rows, "Date string, Ticker string, x int").repartition(4)
    metrics = {"rows": F.count(F.lit(1)), "total": F.sum("x")}
    found = storage.write_table(df, str(tmp_path / "a"), sort_by=["Date", "Ticker"], metrics=metrics, count_repeats=True)
    assert found == {"rows": 5, "total": 15, "repeated_keys": 1}
    saved = spark.read.parquet(str(tmp_path / "a"))
    assert saved.columns == ["Date", "Ticker", "x"] and sorted(map(tuple, saved.collect())) == rows
    empty = storage.write_table(df.filter("false"), str(tmp_path / "b"), sort_by=["Date"], metrics=metrics, count_repeats=True)
    assert empty == {"rows": 0, "total": None, "repeated_keys": 0}
    assert storage.write_table(df, str(tmp_path / "c")) == {}


def test_bucketed_quotes_need_no_shuffle_by_ticker(spark, tmp_path):
    quotes = clean_quotes(market.frame(spark, market.rows() + market.rows()[:7]))
    path = str(tmp_path / "quotes")
    with storage.bucketed(quotes, path, "Ticker", "Date", metrics=quote_metrics(), weight="Copies") as (saved, found):
        assert found["keys"] == 270 and found["repeated_raw_keys"] == 7 and found["example"] is None
        checked = checked_panel(saved)
        plan = checked._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and not re.search(r"Exchange hashpartitioning\(Ticker", plan)
        expected = {k: tuple(v) for k, v in market.by_key(checked_panel(quotes)).items()}
        assert {k: tuple(v) for k, v in market.by_key(checked).items()} == expected
    assert spark.read.parquet(path).count() == 270
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    with pytest.raises(AnalysisException):
        with storage.bucketed(quotes, path, "Ticker", "Date"):
            pass
    with storage.bucketed(quotes.limit(3), path, "Ticker", "Date", mode="overwrite") as (saved, _):
        assert saved.count() == 3


def test_write_modes(spark, tmp_path):
    df, path = spark.createDataFrame([(1, None), (2, "b")], "x int, y string"), str(tmp_path / "t")
    storage.write_table(df, path)
    with pytest.raises(AnalysisException):
        storage.write_table(df, path)
    storage.write_table(df.limit(1), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 1


def test_scratch_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = storage.scratch_path(spark, "a"), storage.scratch_path(spark, "a")
    assert one.startswith(f"{root}/a-") and one != two


def test_fingerprint_sees_rows_not_layout(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (2, 2)], "a int, b int")
    value = lambda frame: tuple(storage.fingerprint(frame).first())
    assert value(df) == value(df.repartition(3).select("b", "a"))
    swapped = spark.createDataFrame([(1, None), (1, None), (2, 2)], "a int, b int")
    assert value(df) != value(swapped)
    assert value(df) != value(df.union(df.limit(1)).union(df.limit(1)))


def test_shared_table(spark, tmp_path):
    quotes = market.frame(spark, market.rows() + [dict(market.rows()[0], Ticker="UNLISTED")])
    prices = quotes.withColumn("Date", F.col("Date").cast("date"))
    details = spark.createDataFrame(
        [("KAPPA", "a"), ("MU", "b"), ("XI", "c"), ("GHOST", "d")], "Ticker string, Security string"
    )
    settings = Settings(DAYS[0], "2021-01-01", DAYS[70], DAYS[80], format="csv")
    out = str(tmp_path / "out")
    shared = build_shared_table(spark, prices, details, out, settings)
    assert shared.model.columns == EXPORT_COLUMNS and shared.model.count() == 90
    assert [row["Ticker"] for row in shared.without_quotes.collect()] == ["GHOST"]
    counts = audit_dict(shared.audit)
    assert counts["input_rows"] == 360 and counts["grid_rows"] == 360 and counts["inserted_missing_rows"] == 0
    assert counts["signal_eligible_rows"] == 90 and counts["invalid_quote_rows"] == 90
    assert shared.fingerprint.first()["rows"] == 90
    assert {row["Split"]: row["rows"] for row in shared.summary.collect()} == {
        "train": 30, "validation": 27, "purged": 6, "test": 27,
    }
    again = files.read_model_table(spark, f"{out}/model_data")
    assert storage.fingerprint(again).collect() == shared.fingerprint.collect()
    with pytest.raises(AnalysisException):
        build_shared_table(spark, prices, details, out, settings)
    before = shared.fingerprint.collect(), shared.audit.collect()
    again = build_shared_table(spark, prices, details, out, replace(settings, mode="overwrite"))
    assert (again.fingerprint.collect(), again.audit.collect()) == before


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda rows: rows + rows[:2], "2 keys have several rows"),
        (lambda rows: rows + [dict(rows[0], Volume=1.0)], "1 keys have several rows"),
        (lambda rows: rows + [dict(rows[0], Date=None), dict(rows[1], Date=None), dict(rows[2], Date=None)], "1 keys have several rows"),
        (lambda rows: rows + [dict(rows[0], Date=dt.date(2031, 1, 1))], "1 prices lie outside"),
        (lambda rows: [dict(row, Ticker="OTHER") for row in rows], "No row has all nine features"),
        (lambda rows: [row for row in rows if row["Date"] < dt.date.fromisoformat(DAYS[72])], "no rows.*validation.*test"),
    ],
)
def test_shared_table_refuses(spark, tmp_path, change, message):
    rows = change([dict(row, Date=dt.date.fromisoformat(row["Date"])) for row in market.rows()])
    prices = market.frame(spark, rows, market.SCHEMA.replace("Date string", "Date date"))
    details = spark.createDataFrame([("KAPPA", "a"), ("MU", "b"), ("XI", "c")], "Ticker string, Security string")
    with pytest.raises(ValueError, match=message):
        build_shared_table(spark, prices, details, str(tmp_path / "out"), Settings(DAYS[0], "2021-01-01", DAYS[74], DAYS[80]))


def test_shared_table_of_nothing(spark, tmp_path):
    prices = market.frame(spark, [], market.SCHEMA.replace("Date string", "Date date"))
    details = spark.createDataFrame([("MU", "b")], "Ticker string, Security string")
    with pytest.raises(ValueError, match="the table is empty"):
        build_shared_table(spark, prices, details, str(tmp_path / "out"), Settings(DAYS[0], "2021-01-01", DAYS[74], DAYS[80]))


def test_files_are_saved_once(spark, tmp_path):
    pairs = [(row["Ticker"], name) for row in market.rows()[:: len(DAYS)] for name in QUOTE_COLUMNS]
    by_day = {}
    for row in market.rows():
        by_day.setdefault(row["Date"], []).extend(str(row[name]) for name in QUOTE_COLUMNS)
    lines = [["", *[t for t, _ in pairs]], ["", *[f for _, f in pairs]], *[[day, *cells] for day, cells in by_day.items()]]
    (tmp_path / "wide.csv").write_text("\n".join(map(",".join, lines)) + "\n")
    (tmp_path / "list.csv").write_text("Symbol,Security,GICS Sector,GICS Sub-Industry\nMU,m,x,y\nXI,i,x,y\nKAPPA,k,x,y\n")
    settings = Settings(DAYS[0], "2021-01-01", DAYS[70], DAYS[80])
    args = (spark, str(tmp_path / "list.csv"), str(tmp_path / "wide.csv"), str(tmp_path / "out"))
    first = build_from_files(*args, settings).fingerprint.collect()
    (tmp_path / "wide.csv").unlink()
    second = build_from_files(*args, replace(settings, mode="overwrite"))
    assert second.fingerprint.collect() == first and second.model.count() == 90


def test_predictions_file(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("Date,Ticker,prediction\n2025-01-02,aapl,0.0012\n2025-01-02,MSFT,inf\nbad,BRK.B,high\n")
    rows = {tuple(row) for row in files.read_predictions(spark, str(path)).collect()}
    day = dt.date(2025, 1, 2)
    assert rows == {(day, "AAPL", 0.0012), (day, "MSFT", None), (None, "BRK-B", None)}
