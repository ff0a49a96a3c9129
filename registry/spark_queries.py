"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry import feeds
from registry.feeds import TRAIN_END, VALIDATION_END
from sessiongrid.functions.columns import INFER, computed_once, date_format_report, normalize_ticker, to_finite_double, to_session_date
from sessiongrid.operators.clean import clean_quotes, conflicting_keys, drop_invalid_keys, normalize_quotes, unusable_keys
from sessiongrid.operators.dataset import (
    add_date_splits,
    crossing_dates,
    dataset_counts,
    make_model_dataset,
    model_table_report,
    split_rows,
    split_summary,
)
from sessiongrid.operators.details import clean_details, details_issues, join_details
from sessiongrid.operators.features import (
    add_bar_features,
    add_momentum,
    add_next_session_label,
    add_volatility,
    add_volume_ratio,
)
from sessiongrid.operators.grid import densify, session_calendar
from sessiongrid.operators.portfolio import (
    benchmark_selection,
    daily_returns,
    portfolio_metrics,
    select_top,
    trades,
    uncovered_dates,
)
from sessiongrid.operators.quality import (
    REASONS,
    add_quote_reasons,
    audit_long,
    mask_invalid_quotes,
    tickers_without_quotes,
    valid_quotes_per_ticker,
)
from sessiongrid.operators.scoring import daily_spearman, spearman_summary, submission_issues
from sessiongrid.plans.backtest import BENCHMARK, MODEL, backtest, write_backtest
from sessiongrid.plans.panel import checked_panel, prepare_price_panel, public_panel
from sessiongrid.plans.shared_table import Settings, build_shared_table, save_inputs
from sessiongrid.schema import FEATURES, QUOTE_COLUMNS, export_columns, model_inputs, quoted
from sessiongrid.sources.files import (
    conform_tickers,
    raw_price_report,
    read_constituents,
    read_model_table,
    read_predictions,
    read_wide_prices,
    wide_to_long,
)
from sessiongrid.sources.storage import fingerprint, scratch_path, stage, write_table

Query = Callable[[SparkSession, str], DataFrame]

START, END = "1996-01-01", "2001-06-01"
DERIVED = {*FEATURES, "volume_ma20", "target", "target_rank"}


def _round(name: str) -> Column:
    value = F.round(F.col(quoted(name)), 8)
    return F.when(value == 0, 0.0).otherwise(value).alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Computed doubles to 8 digits, without negative zero, for the comparison."""
    chosen = set(names) or DERIVED
    return df.select(*[_round(name) if name in chosen else quoted(name) for name in df.columns])


def _quotes(spark, sf):
    return clean_quotes(feeds.bars(spark, sf))


def _masked(spark, sf):
    return mask_invalid_quotes(add_quote_reasons(densify(_quotes(spark, sf))))


def _panel(spark, sf):
    return public_panel(checked_panel(_quotes(spark, sf)))


def _dataset(spark, sf, labeled_only=False):
    return make_model_dataset(_panel(spark, sf), labeled_only=labeled_only, scratch=scratch_path(spark, "kept"))


def _splits(spark, sf):
    return add_date_splits(_dataset(spark, sf), TRAIN_END, VALIDATION_END, validate=False)


def _evaluated(spark, sf, feed=feeds.bars):
    """Raw quotes and the test rows made from them, both written, because every evaluation reads them several times."""
    raw = stage(feed(spark, sf), "raw")
    panel = public_panel(checked_panel(clean_quotes(raw)))
    dataset = make_model_dataset(panel, labeled_only=False, scratch=scratch_path(spark, "kept"))
    splits = add_date_splits(dataset, TRAIN_END, VALIDATION_END, validate=False)
    return raw, stage(split_rows(splits, "test", labeled=False), "test")


def _test_rows(spark, sf):
    return _evaluated(spark, sf)[1]


# --- cleaning -------------------------------------------------------------------------


def bars_ohlcv(spark, sf):
    return feeds.bars(spark, sf)


def normalize_keys(spark, sf):
    day = F.col("l_shipdate").cast("date").cast("string")
    parts = [F.date_format(F.col("l_shipdate").cast("date"), form) for form in ("yyyyMMdd", "yyyy/M/d", "yyyy-M-d")]
    kind = F.col("l_orderkey") % 16
    text = (
        F.when(kind == 0, day)
        .when(kind == 1, F.concat(day, F.lit(" 13:45:00")))
        .when(kind == 2, F.concat(day, F.lit("T23:30:00-05:00")))
        .when(kind == 3, "not-a-date")
        .when(kind == 4, F.substring(day, 1, 4))
        .when(kind == 5, F.concat(F.lit("  "), day))
        .when(kind == 7, parts[0])
        .when(kind == 8, parts[1])
        .when(kind == 9, F.concat(day, F.lit(" 23:30-05:00")))
        .when(kind == 10, F.concat(parts[2], F.lit(" 23:30-5")))
        .when(kind == 11, F.concat(day, F.lit(" 23:30:00 America/New_York")))
        .when(kind == 12, F.lit("1677-09-20"))
        .when(kind == 13, F.lit("1677-09-21 00:00"))
        .when(kind == 14, F.concat(day, F.lit("T01:15:00.5+0530")))
        .when(kind == 15, F.lit("2262-04-11T23:59Z"))
    )
    number, form = F.col("l_suppkey").cast("string"), F.col("l_linenumber") % 5
    ticker = (
        F.when(form == 0, F.concat(F.lit("s."), number))
        .when(form == 1, F.concat(F.lit("\ts."), number, F.lit(" \n")))
        .when(form == 2, F.concat(F.lit(" S."), number, F.lit(" ")))
        .when(form == 3, "   ")
        .otherwise(F.concat(F.lit("S-"), number))
    )
    texts = feeds.table(spark, sf, "lineitem").select(text.alias("day"), ticker.alias("name"))
    keys = texts.select(to_session_date(F.col("day"), T.StringType()).alias("Date"), normalize_ticker(F.col("name")).alias("Ticker"))
    return drop_invalid_keys(computed_once(keys, "Date", "Ticker")).groupBy("Date", "Ticker").agg(F.count("*").alias("rows"))


def date_formats(spark, sf):
    """Which formats read three columns of day text: month names, day first, and one that leaves it open."""
    day = F.col("l_shipdate").cast("date")
    early = F.make_date(F.year(day), F.month(day), F.least(F.dayofmonth(day), F.lit(12)))
    texts = feeds.table(spark, sf, "lineitem").select(
        F.date_format(day, "d MMMM yyyy").alias("named"),
        F.date_format(day, "dd/MM/yyyy").alias("day_first"),
        F.date_format(early, "dd/MM/yyyy").alias("open"),
    )
    found = [date_format_report(texts, name).select(F.lit(name).alias("column_name"), "*") for name in texts.columns]
    report = found[0].unionByName(found[1]).unionByName(found[2])
    return report.withColumn("fits_all", F.col("fits") == F.col("rows"))


def inferred_dates(spark, sf):
    """Quotes whose dates are written with month names, in the one format that reads them all."""
    named = feeds.bars(spark, sf).withColumn("Date", F.concat(F.lit(" "), F.date_format("Date", "MMMM d, yyyy")))
    return normalize_quotes(named, date_format=INFER)


def coerce_numeric(spark, sf):
    number, kind = F.col("l_quantity").cast("int").cast("string"), F.col("l_orderkey") % 9
    text = (
        F.when(kind == 0, number)
        .when(kind == 1, F.concat(F.lit(" "), number, F.lit(" ")))
        .when(kind == 2, F.concat(number, F.lit("d")))
        .when(kind == 3, "inf")
        .when(kind == 4, "nan")
        .when(kind == 5, F.concat(F.lit("1,"), number))
        .when(kind == 6, F.concat(number, F.lit("e2")))
        .when(kind == 7, F.concat(F.lit("-."), number))
        .otherwise("")
    )
    return (
        feeds.table(spark, sf, "lineitem")
        .select(kind.alias("kind"), to_finite_double(text, T.StringType()).alias("number"))
        .groupBy("kind", "number")
        .agg(F.count("*").alias("rows"))
    )


def key_faults(spark, sf):
    raw = feeds.dirty(spark, sf).withColumn(
        "Date",
        F.when(F.month("Date") == 2, F.lit("1500-02-01")).when(F.month("Date") == 3, "soon").otherwise(F.col("Date").cast("string")),
    )
    return unusable_keys(raw)


def dedupe_quotes(spark, sf):
    return clean_quotes(feeds.dirty(spark, sf))


def conflict_keys(spark, sf):
    return conflicting_keys(clean_quotes(feeds.conflicting(spark, sf)))


def calendar(spark, sf):
    return session_calendar(_quotes(spark, sf))


def dense_grid(spark, sf):
    return densify(_quotes(spark, sf)).select(
        "Ticker", "Date", *[quoted(name) for name in QUOTE_COLUMNS], "Inserted"
    )


def quote_validity(spark, sf):
    checked = add_quote_reasons(densify(clean_quotes(feeds.dirty(spark, sf))))
    return checked.select("Ticker", "Date", *REASONS, "QuoteValid")


def masked_quotes(spark, sf):
    masked = mask_invalid_quotes(add_quote_reasons(densify(clean_quotes(feeds.dirty(spark, sf)))))
    return masked.select("Ticker", "Date", *[quoted(name) for name in QUOTE_COLUMNS], "QuoteValid")


def audit_counts(spark, sf):
    return prepare_price_panel(feeds.dirty(spark, sf), validate=False).audit


def audit_rows(spark, sf):
    """Counted by the tasks that write the panel."""
    return audit_long(prepare_price_panel(feeds.dirty(spark, sf), validate=False, scratch=scratch_path(spark, "panel")).audit)


def quotes_per_ticker(spark, sf):
    return valid_quotes_per_ticker(add_quote_reasons(densify(clean_quotes(feeds.dirty(spark, sf)))))


# --- files ------------------------------------------------------------------------------


def _wide_file(spark, sf):
    """The wide table as a file with its two header lines."""
    wide = feeds.wide_bars(spark, sf)
    path = scratch_path(spark, "wide_csv")
    names = [name.split("/") for name in wide.columns[1:]]
    heads = [["", *[ticker for ticker, _ in names]], ["", *[field for _, field in names]]]
    cells = [F.coalesce(F.col(quoted(name)).cast("string"), F.lit("")) for name in wide.columns]
    lines = wide.select(F.concat_ws(",", *cells).alias("value"), F.col("Date").cast("string").alias("at"))
    head = spark.createDataFrame([(",".join(cells), f"{i}") for i, cells in enumerate(heads)], "value string, at string")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return path


def wide_csv_roundtrip(spark, sf):
    """The wide file, read and turned into quotes."""
    return wide_to_long(read_wide_prices(spark, _wide_file(spark, sf)))


def _constituents_file(spark, sf):
    path = scratch_path(spark, "constituents_csv")
    details = feeds.details(spark, sf).select(
        F.concat(F.lit(" "), F.lower("Ticker")).alias("Symbol"), "Security", F.col("Nation").alias("GICS Sector"), F.lit(None).cast("string").alias("GICS Sub-Industry")
    )
    write_table(details, path, "csv", sort_by=["Symbol"])
    return path


def _saved_inputs(spark, sf):
    """Both inputs saved as a set; a second build finds it, and an interrupted refresh leaves it."""
    root = scratch_path(spark, "inputs")
    constituents, prices = _constituents_file(spark, sf), _wide_file(spark, sf)
    save_inputs(spark, constituents, prices, root)
    try:
        save_inputs(spark, constituents, f"{prices}/missing", root, refresh=True)
    except AnalysisException:
        pass  # the refresh fails at its second table
    return save_inputs(spark, f"{constituents}/missing", prices, root)


def cached_inputs(spark, sf):
    return spark.read.parquet(_saved_inputs(spark, sf)["prices"])


def _file_order(table, keys):
    """Whether the files of a table follow each other in order: their key ranges."""
    rows = table.select(*keys, F.input_file_name().alias("file"))
    key = F.struct(*keys)
    files = rows.groupBy("file").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))
    before = Window.orderBy("file")  # one row for each file
    return files.withColumn("follows", F.coalesce(F.lag("high").over(before) < F.col("low"), F.lit(True))).agg(
        F.sum("rows").alias("rows"), F.every("follows").alias("in_order"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def saved_inputs_order(spark, sf):
    """Constituents lie in order of their ticker, quotes in order of date and ticker."""
    saved = _saved_inputs(spark, sf)
    tables = {"constituents": ["Ticker"], "prices": ["Date", "Ticker"]}
    found = [_file_order(spark.read.parquet(saved[name]), keys).select(F.lit(name).alias("table_name"), "rows", "in_order") for name, keys in tables.items()]
    return found[0].unionByName(found[1])


def constituents_roundtrip(spark, sf):
    """Details with a Symbol only, as a file; saved in order of the ticker made from it."""
    return read_constituents(spark, _constituents_file(spark, sf))


def sorted_export(spark, sf):
    path = scratch_path(spark, "sorted_export")
    write_table(export_columns(_splits(spark, sf)), path, sort_by=["Date", "Ticker"])
    return _file_order(spark.read.parquet(path), ["Date", "Ticker"]).select(
        "rows", "in_order", F.col("low.Date").alias("first_date"), F.col("high.Date").alias("last_date")
    )


def predictions_csv(spark, sf):
    """A submission as a file, with cells that are not numbers."""
    path = scratch_path(spark, "predictions_csv")
    sent = feeds.predictions(_test_rows(spark, sf)).withColumn(
        "prediction", F.when(F.month("Date") == 5, "n/a").otherwise(F.col("prediction").cast("string"))
    )
    write_table(sent, path, "csv")
    return rounded(read_predictions(spark, path), "prediction")


def training_inputs(spark, sf):
    return rounded(model_inputs(split_rows(_splits(spark, sf), "train"), ["mom_5d", "vol_20d", "range_pct"]))


# --- details and raw-table checks -----------------------------------------------------


def metadata_join(spark, sf):
    dense = densify(_quotes(spark, sf)).select("Ticker", "Date", "Close")
    return join_details(dense, feeds.details(spark, sf), validate=False)


def details_dedupe(spark, sf):
    return clean_details(feeds.untidy_details(spark, sf))


def details_problems(spark, sf):
    return details_issues(clean_details(feeds.untidy_details(spark, sf)))


def price_report(spark, sf):
    return raw_price_report(feeds.conflicting(spark, sf), START, END)


def conform(spark, sf):
    return conform_tickers(feeds.bars(spark, sf), feeds.expected_tickers(spark, sf))


def without_quotes(spark, sf):
    conformed = conform_tickers(feeds.bars(spark, sf), feeds.expected_tickers(spark, sf))
    return tickers_without_quotes(add_quote_reasons(densify(clean_quotes(conformed))))


def unpivot_wide(spark, sf):
    return wide_to_long(feeds.wide_bars(spark, sf))


# --- features and labels --------------------------------------------------------------


def momentum(spark, sf):
    return rounded(add_momentum(_masked(spark, sf)).select("Ticker", "Date", "ret_1d", "mom_5d", "mom_20d", "mom_60d"))


def volatility(spark, sf):
    return rounded(add_volatility(add_momentum(_masked(spark, sf))).select("Ticker", "Date", "vol_5d", "vol_20d"))


def volume_ratio(spark, sf):
    return rounded(add_volume_ratio(_masked(spark, sf)).select("Ticker", "Date", "volume_ma20", "volume_ratio_20d"))


def intraday(spark, sf):
    return rounded(add_bar_features(_masked(spark, sf)).select("Ticker", "Date", "range_pct", "intraday_ret"))


def signal_eligible(spark, sf):
    return _panel(spark, sf).select("Ticker", "Date", "SignalEligible")


def next_session_label(spark, sf):
    return rounded(add_next_session_label(_masked(spark, sf)).select("Ticker", "Date", "LabelEndDate", "target"))


def prepare_panel_full(spark, sf):
    dirty, details = feeds.dirty(spark, sf), feeds.details(spark, sf)
    return rounded(prepare_price_panel(dirty, details, validate=False).panel)


# --- dataset and splits ---------------------------------------------------------------


def model_table(spark, sf):
    """The whole way from untidy quotes to the table that is shared."""
    panel = prepare_price_panel(feeds.dirty(spark, sf), feeds.details(spark, sf), validate=False).panel
    dataset = make_model_dataset(panel, labeled_only=False, scratch=scratch_path(spark, "kept"))
    return rounded(export_columns(add_date_splits(dataset, TRAIN_END, VALIDATION_END, validate=False)))


def model_dataset_labeled(spark, sf):
    return rounded(_dataset(spark, sf, labeled_only=True).select("Date", "Ticker", *FEATURES, "target", "target_rank"))


def model_dataset_all(spark, sf):
    return rounded(_dataset(spark, sf).select("Date", "Ticker", *FEATURES, "target", "target_rank"))


def target_rank(spark, sf):
    return rounded(_dataset(spark, sf).select("Date", "Ticker", "target_rank"))


def date_splits(spark, sf):
    return _splits(spark, sf).select("Date", "Ticker", "Split")


def splits_summary(spark, sf):
    return split_summary(_splits(spark, sf))


def purged_dates(spark, sf):
    return crossing_dates(_panel(spark, sf).filter("SignalEligible"), TRAIN_END, VALIDATION_END)


def train_rows(spark, sf):
    return rounded(split_rows(_splits(spark, sf), "train").select("Date", "Ticker", "target"))


def model_contract(spark, sf):
    """The report over a table with repeated keys and missing features."""
    k = F.substring_index("Ticker", "-", -1).cast("int")
    turns = F.explode(F.sequence(F.lit(1), F.when(k % 7 == 4, 2).otherwise(1)))
    damaged = [F.when(k % 9 != i, F.col(name)).alias(name) for i, name in enumerate(FEATURES)]
    splits = _splits(spark, sf)
    rest = [name for name in splits.columns if name not in FEATURES]
    return model_table_report(splits.select(*[quoted(name) for name in rest], *damaged, turns))


def counts(spark, sf):
    return dataset_counts(feeds.details(spark, sf), feeds.bars(spark, sf), _splits(spark, sf))


def shared_table(spark, sf):
    dashed = F.translate("Ticker", ".", "-")
    prices = feeds.bars(spark, sf).withColumn("Ticker", dashed)
    details = feeds.details(spark, sf).withColumn("Ticker", dashed)
    settings = Settings("1990-01-01", "2010-01-01", TRAIN_END, VALIDATION_END)
    return rounded(build_shared_table(spark, prices, details, scratch_path(spark, "shared"), settings).model)


def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "model_csv")
    write_table(export_columns(_splits(spark, sf)), path, "csv")
    return rounded(read_model_table(spark, path))


def dataset_fingerprint(spark, sf):
    return fingerprint(export_columns(_splits(spark, sf)), digits=8)


# --- evaluation -----------------------------------------------------------------------


def submission_check(spark, sf):
    eligible = _test_rows(spark, sf)
    number = F.substring_index("Ticker", "-", -1).cast("int") % 11
    kinds = F.array(
        F.when(~number.isin(1, 3), "row"), F.when(number == 2, "copy"), F.when(number == 3, "blank"), F.when(number == 4, "other")
    )
    number_or_text = feeds.reversal(eligible).withColumn("prediction", F.col("prediction").cast("string"))
    rows = number_or_text.withColumn("kind", F.explode(F.array_compact(kinds)))
    submitted = rows.select(
        "Date",
        F.when(F.col("kind") == "other", F.concat("Ticker", F.lit("X"))).otherwise(F.col("Ticker")).alias("Ticker"),
        F.when(F.col("kind") != "blank", F.col("prediction"))
        .otherwise(F.element_at(F.array(*map(F.lit, ["NaN", "Infinity", "high"])), (F.month("Date") % 3 + 1).cast("int")))
        .alias("prediction"),
    )
    return submission_issues(submitted, eligible)


def spearman_daily(spark, sf):
    eligible = _test_rows(spark, sf)
    daily = daily_spearman(feeds.predictions(eligible), eligible, scratch=scratch_path(spark, "pairs"))
    return rounded(daily, "score")


def spearman_totals(spark, sf):
    eligible = _test_rows(spark, sf)
    daily = daily_spearman(feeds.predictions(eligible), eligible, scratch=scratch_path(spark, "pairs"))
    return rounded(spearman_summary(daily), "mean_score")


def top10_selection(spark, sf):
    return select_top(feeds.predictions(_test_rows(spark, sf)))


def _dirty_trades(spark, sf):
    raw, eligible = _evaluated(spark, sf, feeds.dirty)
    quotes = clean_quotes(raw)
    return trades(select_top(feeds.predictions(eligible)), session_calendar(quotes), quotes)


def top10_trades(spark, sf):
    return rounded(_dirty_trades(spark, sf), "gross", "net")


def top10_daily(spark, sf):
    return rounded(daily_returns(_dirty_trades(spark, sf)), "gross", "net")


def benchmark_daily(spark, sf):
    raw, eligible = _evaluated(spark, sf)
    quotes, chosen = clean_quotes(raw), benchmark_selection(eligible)
    return rounded(daily_returns(trades(chosen, session_calendar(quotes), quotes)), "gross", "net")


def left_out_dates(spark, sf):
    raw, eligible = _evaluated(spark, sf)
    return uncovered_dates(eligible, session_calendar(clean_quotes(raw)))


def metrics(spark, sf):
    raw, eligible = _evaluated(spark, sf)
    quotes = clean_quotes(raw)
    chosen = select_top(feeds.predictions(eligible)).select(F.lit(MODEL).alias("Portfolio"), "Date", "Ticker", "weight")
    market = benchmark_selection(eligible).select(F.lit(BENCHMARK).alias("Portfolio"), "Date", "Ticker", "weight")
    daily = daily_returns(trades(chosen.unionByName(market), session_calendar(quotes), quotes))
    return rounded(portfolio_metrics(daily), "cumulative_gross", "cumulative_net", "sharpe", "max_drawdown")


def backtest_results(spark, sf):
    raw, eligible = _evaluated(spark, sf)
    predictions = feeds.predictions(eligible)
    stray = predictions.withColumn("Ticker", F.lit("S-X"))  # not eligible, so never traded
    done = backtest(
        predictions.unionByName(stray), raw, eligible, validate=False, scratch=scratch_path(spark, "backtest")
    )
    values = ("cumulative_gross", "cumulative_net", "sharpe", "max_drawdown", "mean_score")
    return rounded(done.results, *values)


def _saved_backtest(spark, sf):
    """A backtest with unresolved trades, saved as files."""
    raw, eligible = _evaluated(spark, sf, feeds.dirty)
    path = scratch_path(spark, "results")
    done = backtest(feeds.predictions(eligible), raw, eligible, validate=False, scratch=scratch_path(spark, "backtest"))
    write_backtest(done, path)
    return done, lambda name: spark.read.option("header", True).schema(getattr(done, name).schema).csv(f"{path}/{name}")


def results_csv(spark, sf):
    """Results as saved and read again; an unresolved trade leaves the metrics missing."""
    _, saved = _saved_backtest(spark, sf)
    return rounded(saved("results"), "cumulative_gross", "cumulative_net", "sharpe", "max_drawdown", "mean_score")


def daily_csv(spark, sf):
    _, saved = _saved_backtest(spark, sf)
    return rounded(saved("daily"), "gross", "net")


def trades_csv(spark, sf):
    _, saved = _saved_backtest(spark, sf)
    return rounded(saved("trades"), "gross", "net", "weight")


QUERIES: dict[str, Query] = {
    "bars_ohlcv": bars_ohlcv,
    "normalize_keys": normalize_keys,
    "unusable_keys": key_faults,
    "coerce_numeric": coerce_numeric,
    "dedupe_quotes": dedupe_quotes,
    "conflict_keys": conflict_keys,
    "session_calendar": calendar,
    "dense_grid": dense_grid,
    "quote_validity": quote_validity,
    "masked_quotes": masked_quotes,
    "audit_counts": audit_counts,
    "audit_long": audit_rows,
    "valid_quotes_per_ticker": quotes_per_ticker,
    "metadata_join": metadata_join,
    "details_dedupe": details_dedupe,
    "details_issues": details_problems,
    "raw_price_report": price_report,
    "conform_tickers": conform,
    "tickers_without_quotes": without_quotes,
    "wide_to_long": unpivot_wide,
    "momentum": momentum,
    "volatility": volatility,
    "volume_ratio": volume_ratio,
    "intraday": intraday,
    "signal_eligible": signal_eligible,
    "next_session_label": next_session_label,
    "prepare_panel_full": prepare_panel_full,
    "model_table": model_table,
    "model_dataset_labeled": model_dataset_labeled,
    "model_dataset_all": model_dataset_all,
    "target_rank": target_rank,
    "date_splits": date_splits,
    "split_summary": splits_summary,
    "purged_dates": purged_dates,
    "split_rows": train_rows,
    "model_contract": model_contract,
    "dataset_counts": counts,
    "build_shared_table": shared_table,
    "csv_roundtrip": csv_roundtrip,
    "dataset_fingerprint": dataset_fingerprint,
    "submission_issues": submission_check,
    "daily_spearman": spearman_daily,
    "spearman_summary": spearman_totals,
    "top10_selection": top10_selection,
    "trades": top10_trades,
    "daily_returns": top10_daily,
    "benchmark_returns": benchmark_daily,
    "uncovered_dates": left_out_dates,
    "portfolio_metrics": metrics,
    "backtest_results": backtest_results,
    "results_csv": results_csv,
    "daily_csv": daily_csv,
    "trades_csv": trades_csv,
    "cached_inputs": cached_inputs,
    "saved_inputs_order": saved_inputs_order,
    "date_formats": date_formats,
    "inferred_dates": inferred_dates,
    "wide_csv_roundtrip": wide_csv_roundtrip,
    "constituents_roundtrip": constituents_roundtrip,
    "sorted_export": sorted_export,
    "predictions_csv": predictions_csv,
    "training_inputs": training_inputs,
}
