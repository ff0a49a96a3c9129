"""Column expressions used by the operators.

Everything here is built from Spark's own functions, so it is evaluated inside generated
code. A missing value is always NULL: NaN and infinities are turned into NULL on entry.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.schema import FIRST_DATE, LAST_DATE, quoted

# Every character that counts as white space in Unicode text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A day as 2021-05-06, 2021/5/6 or 20210506, then perhaps a time, then perhaps an offset.
# Names of time zones do not match, so such text is missing.
_DAY_TIME_OFFSET = (
    r"^\s*(\d{4})(?:([-/])(\d{1,2})\2(\d{1,2})|(\d{2})(\d{2}))"
    r"(?:[T\s]\s*(?:(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(?:Z|([+-])(\d{1,2})(?::?(\d{2}))?)?)?)?\s*$"
)
# The day and time, the hours and the minutes of the offset. $80 is group 8 and a zero, as there is no group 80.
_THREE_PARTS = "$1-$3$5-$4$6 $7|$80$9|$80$10"
# The other ways to write a day that a whole column may share, as Spark patterns.
DATE_FORMATS = [
    "M/d/yyyy",
    "d/M/yyyy",
    "M-d-yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
]
ISO = "iso"  # the forms that are read row by row without a pattern
INFER = "infer"  # asks for a format that fits the whole column
# Spark reads a Java type suffix ("1.5d") as part of a number.
_NUMBER_SUFFIX = r"[dDfF]\s*$"


def _utc_date(instant: Column) -> Column:
    # Counted from the epoch, so the session time zone does not matter.
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / F.lit(86400.0)).cast("int"))


def _text_to_day(c: Column) -> Column:
    # Text that does not match keeps its form, without bars, so that it has no second part and gives NULL.
    # No condition and no lambda: Spark then compiles all of it and computes the parts once.
    parts = F.split(F.regexp_replace(F.translate(c, "|", "?"), _DAY_TIME_OFFSET, _THREE_PARTS), r"\|", -1)
    day_time, hours, minutes = (F.get(parts, F.lit(i)) for i in range(3))
    shift = hours.try_cast("int") * 60 + minutes.try_cast("int")
    return (F.trim(day_time).try_cast("timestamp_ntz") - F.make_dt_interval(mins=shift)).cast("date")


def to_day(c: Column, dtype: T.DataType, fmt: str | None = None) -> Column:
    """The UTC calendar day of a date, timestamp or text column, whatever its year."""
    if isinstance(dtype, T.StringType):
        return _text_to_day(c) if fmt is None else F.try_to_date(F.trim(c, F.lit(WHITESPACE)), fmt)
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, T.TimestampNTZType):
        return c.cast("date")
    if isinstance(dtype, T.TimestampType):
        return _utc_date(c)
    raise ValueError(f"Cannot read dates from a column of type {dtype.simpleString()}")


def in_calendar(day: Column) -> Column:
    """Whether a day lies in the calendar, see FIRST_DATE."""
    return day.between(F.lit(FIRST_DATE).cast("date"), F.lit(LAST_DATE).cast("date"))


def to_session_date(c: Column, dtype: T.DataType, fmt: str | None = None) -> Column:
    """The UTC calendar day of a date, timestamp or text column; NULL if it is not one.

    Text is read row by row as year, month and day (with dashes, slashes or two digits each
    and nothing between them), perhaps followed by a time and that by an offset, unless
    ``fmt`` gives another pattern. Without an offset it is taken as UTC. Days outside the
    calendar are NULL.
    """
    day = to_day(c, dtype, fmt)
    return F.when(in_calendar(day), day)


def _distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """(text, times): the texts of a column, each once, trimmed and not blank, with their numbers of rows."""
    each = df.groupBy(F.col(quoted(column)).alias("given")).agg(F.count("*").alias("times"))
    trimmed = each.select(F.trim("given", F.lit(WHITESPACE)).alias("text"), "times")
    return computed_once(trimmed, "text").filter("text <> ''")


def date_format_report(df: DataFrame, column: str = "Date", formats: Sequence[str] = tuple(DATE_FORMATS)) -> DataFrame:
    """(format, rows, fits): how many rows that are not blank there are, and how many of them each format reads.

    One pass, whatever the number of formats; only days inside the calendar count. Equal texts are counted
    first, inside each input task too, so each is read once: a text that a format does not read is slow to try.
    """
    given = _distinct_texts(df, column)
    reads = {ISO: _text_to_day(F.col("text"))} | {fmt: F.try_to_date("text", fmt) for fmt in formats}
    rows_where = lambda fits: F.coalesce(F.sum(F.when(fits, F.col("times"))), F.lit(0))
    counts = given.agg(
        rows_where(F.lit(True)).alias("rows"), *[rows_where(in_calendar(day)).alias(f"fits_{i}") for i, day in enumerate(reads.values())]
    )
    each = F.array(*[F.struct(F.lit(fmt).alias("format"), F.col("rows").alias("rows"), F.col(f"fits_{i}").alias("fits")) for i, fmt in enumerate(reads)])
    return counts.select(F.inline(each))


def infer_date_format(df: DataFrame, column: str = "Date", formats: Sequence[str] = tuple(DATE_FORMATS)) -> str | None:
    """The one format that reads every row of a text column; None to read rows one by one.

    Text that is written year first needs no pattern, so it is tried first. A format counts only if it
    fits all rows that are not blank. If several do and would read the same rows as different days,
    the column is ambiguous, which raises an error that names them. Runs one job; ten or so counts reach the driver.
    """
    if not isinstance(df.schema[column].dataType, T.StringType):
        return None
    report = date_format_report(df, column, formats).collect()
    fitting = [row["format"] for row in report if row["rows"] and row["fits"] == row["rows"]]
    if not fitting or fitting[0] == ISO:
        return None
    if len(fitting) > 1:
        days = [F.try_to_date("text", fmt) for fmt in fitting]
        differ = reduce(or_, [~day.eqNullSafe(days[0]) for day in days[1:]])
        if not _distinct_texts(df, column).filter(differ).limit(1).isEmpty():
            raise ValueError(f"{column} can be read in several ways: {fitting}. Name one of them.")
    return fitting[0]


def normalize_ticker(c: Column, upper: bool = True) -> Column:
    """Trim all white space, use dashes for dots and, by default, upper case."""
    text = F.trim(c.cast("string"), F.lit(WHITESPACE))
    return F.replace(F.upper(text) if upper else text, F.lit("."), F.lit("-"))


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """``df`` whose columns ``names`` are computed once for each row, although rows are later filtered by them.

    They come out of a generator. Spark moves filters on other columns to where rows are read, and computes the column
    there and again above; it moves none below a generator.
    """
    held = F.inline(F.array(F.struct(*[F.col(quoted(name)) for name in names])))
    others = [quoted(name) for name in df.columns if name not in names]
    return df.select(held, *others).select(*[quoted(name) for name in df.columns])


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def to_double(c: Column, dtype: T.DataType) -> Column:
    """A double, possibly not finite; NULL when the value is not a number."""
    if isinstance(dtype, T.StringType):
        return F.when(~c.rlike(_NUMBER_SUFFIX), c).try_cast("double")
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    raise ValueError(f"Cannot read numbers from a column of type {dtype.simpleString()}")


def to_finite_double(c: Column, dtype: T.DataType) -> Column:
    """A finite double, or NULL when the value is not a number."""
    return finite(to_double(c, dtype))


def any_null(names: Sequence[str]) -> Column:
    return reduce(or_, [F.col(quoted(name)).isNull() for name in names])


def all_present(names: Sequence[str]) -> Column:
    return reduce(and_, [F.col(quoted(name)).isNotNull() for name in names])


def holds(condition: Column) -> Column:
    """A comparison that is false, not NULL, when an operand is missing."""
    return F.coalesce(condition, F.lit(False))


def session_return(c: Column, sessions: int, by_ticker: WindowSpec) -> Column:
    """Relative change over ``sessions`` rows; only the two end points must exist."""
    return session_change(c, F.lag(c, sessions).over(by_ticker))


def session_change(c: Column, before: Column) -> Column:
    """Relative change of ``c`` since ``before``; missing if either is."""
    return finite(F.try_divide(c, before) - F.lit(1.0))
