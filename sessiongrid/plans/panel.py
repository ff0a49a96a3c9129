"""Raw quotes to the panel: clean, densify, check, join details, features, label."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from sessiongrid.operators.clean import check_quotes, clean_quotes
from sessiongrid.operators.details import join_details
from sessiongrid.operators.features import (
    add_bar_features,
    add_momentum,
    add_next_session_label,
    add_rolling_features,
    add_signal_eligible,
)
from sessiongrid.operators.grid import densify
from sessiongrid.operators.quality import REASONS, add_quote_reasons, audit, audit_metrics, audit_of, mask_invalid_quotes
from sessiongrid.schema import PANEL_COLUMNS, quoted
from sessiongrid.sources.storage import write_table

_FIRST_COLUMNS = PANEL_COLUMNS[: PANEL_COLUMNS.index("QuoteValid") + 1]
_LATER_COLUMNS = PANEL_COLUMNS[len(_FIRST_COLUMNS) :]
_AUDIT_COLUMNS = [*REASONS, "Copies"]


class PanelResult(NamedTuple):
    panel: DataFrame
    audit: DataFrame


def checked_panel(quotes: DataFrame, details: DataFrame | None = None, *, validate: bool = True) -> DataFrame:
    """The panel of cleaned quotes, still with the reason flags and copy counts.

    The details are joined last, so they do not travel through the windows.
    """
    panel = mask_invalid_quotes(add_quote_reasons(densify(quotes)))
    panel = add_rolling_features(add_momentum(add_next_session_label(panel)))
    panel = add_signal_eligible(add_bar_features(panel))
    extras = []
    if details is not None:
        extras = [name for name in details.columns if name != "Ticker"]
        panel = join_details(panel, details, validate=validate)
    order = [*_FIRST_COLUMNS, *extras, *_LATER_COLUMNS, *_AUDIT_COLUMNS]
    return panel.select(*[quoted(name) for name in order])


def public_panel(checked: DataFrame) -> DataFrame:
    return checked.drop(*_AUDIT_COLUMNS)


def prepare_price_panel(
    raw: DataFrame,
    metadata: DataFrame | None = None,
    *,
    date_format: str | None = None,
    validate: bool = True,
    scratch: str | None = None,
) -> PanelResult:
    """Clean daily quotes into one row per ticker and session; returns ``(panel, audit)``.

    With ``scratch``, a new path in shared storage that the caller removes when done, the panel is
    written there once; the writing tasks count the audit as its rows pass them, so the gaps are
    filled and the windows run a single time for both results.

    Without it both results are lazy, and each evaluates the panel for itself. With ``validate``
    the input is checked at once, in one job over the quotes and one over the details, and a
    ``ValueError`` tells what is wrong. Without it the same conflicts fail the query that meets
    them, and no extra pass is made.
    """
    quotes = clean_quotes(raw, date_format=date_format)
    if validate:
        check_quotes(quotes)
    checked = checked_panel(quotes, metadata, validate=validate)
    if scratch is None:
        return PanelResult(public_panel(checked), audit(raw, checked))
    counts = write_table(checked, scratch, metrics=audit_metrics())
    spark = raw.sparkSession
    return PanelResult(public_panel(spark.read.parquet(scratch)), audit_of(spark, raw.count(), counts))
