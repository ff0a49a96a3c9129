"""Fixed column names and the schema contracts checked before any job runs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Public column names, in their published order.
KEY_COLUMNS = ["Date", "Ticker"]
PRICE_COLUMNS = ["Open", "High", "Low", "Close", "Adj Close"]
QUOTE_COLUMNS = ["Open", "High", "Low", "Close", "Adj Close", "Volume"]
FEATURES = [
    "ret_1d",
    "mom_5d",
    "mom_20d",
    "mom_60d",
    "vol_5d",
    "vol_20d",
    "volume_ratio_20d",
    "range_pct",
    "intraday_ret",
]
SPLITS = ["train", "validation", "test", "purged"]
DETAIL_COLUMNS = ["Symbol", "Security", "GICS Sector", "GICS Sub-Industry"]

RAW_COLUMNS = KEY_COLUMNS + QUOTE_COLUMNS
EXPORT_COLUMNS = ["Date", "Ticker", "Split", "LabelEndDate", *FEATURES, "target", "target_rank"]
NOT_MODEL_INPUTS = {"Date", "Ticker", "LabelEndDate", "Split", "target", "target_rank"}

# Columns the panel owns; stock details may not reuse them.
PANEL_COLUMNS = [
    "Ticker",
    "Date",
    *QUOTE_COLUMNS,
    "QuoteValid",
    "ret_1d",
    "mom_5d",
    "mom_20d",
    "mom_60d",
    "vol_5d",
    "vol_20d",
    "volume_ma20",
    "volume_ratio_20d",
    "range_pct",
    "intraday_ret",
    "SignalEligible",
    "LabelEndDate",
    "target",
]

# The first and last day of a calendar that counts 64-bit nanoseconds. Other
# days are missing, and counted as such by ``unusable_keys``. A table with one row per date
# thus has at most 213,504 rows.
FIRST_DATE = "1677-09-21"
LAST_DATE = "2262-04-11"

MODEL_SCHEMA = T.StructType(
    [
        T.StructField("Date", T.DateType()),
        T.StructField("Ticker", T.StringType()),
        T.StructField("Split", T.StringType()),
        T.StructField("LabelEndDate", T.DateType()),
        *[T.StructField(name, T.DoubleType()) for name in FEATURES],
        T.StructField("target", T.DoubleType()),
        T.StructField("target_rank", T.DoubleType()),
    ]
)


def quoted(name: str) -> str:
    """A column name that is safe to pass to ``F.col`` whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def require_date(df: DataFrame, *names: str) -> DataFrame:
    """``df``, once its columns ``names`` (by default ``Date``) are known to be of type date."""
    for name in names or ("Date",):
        kind = df.schema[name].dataType
        if not isinstance(kind, T.DateType):
            raise ValueError(f"{name} has to be a date, not {kind.simpleString()}; see to_session_date.")
    return df


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep exactly ``names``, in order; raise if any is absent."""
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise ValueError(f"The table lacks required columns: {absent}")
    return df.select(*[quoted(name) for name in names])


def export_columns(df: DataFrame) -> DataFrame:
    """The columns of the shared model table."""
    return require_columns(df, EXPORT_COLUMNS)


def model_inputs(df: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Feature columns plus ``target``; refuses labels, keys and the split as inputs."""
    leaking = sorted(NOT_MODEL_INPUTS & set(features))
    if leaking:
        raise ValueError(f"These columns must not be model inputs: {leaking}")
    return require_columns(df, [*features, "target"])


def pick_table(candidates: Iterable[DataFrame], required: Sequence[str]) -> DataFrame:
    """The first candidate that has all ``required`` columns, reduced to them."""
    for candidate in candidates:
        if set(required) <= set(candidate.columns):
            return require_columns(candidate, required)
    raise ValueError(f"No candidate table has all of these columns: {list(required)}")
