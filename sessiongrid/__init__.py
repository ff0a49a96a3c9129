"""Daily-quote panels on Spark: cleaning, features, labels, splits and evaluation."""

from sessiongrid.operators.dataset import add_date_splits, make_model_dataset, split_rows, split_summary
from sessiongrid.operators.quality import audit_dict, audit_long
from sessiongrid.plans.backtest import backtest
from sessiongrid.plans.panel import PanelResult, prepare_price_panel
from sessiongrid.plans.shared_table import Settings, build_shared_table
from sessiongrid.schema import FEATURES, PRICE_COLUMNS, QUOTE_COLUMNS, model_inputs

__all__ = [
    "FEATURES",
    "PRICE_COLUMNS",
    "PanelResult",
    "QUOTE_COLUMNS",
    "Settings",
    "add_date_splits",
    "audit_dict",
    "audit_long",
    "backtest",
    "build_shared_table",
    "make_model_dataset",
    "model_inputs",
    "prepare_price_panel",
    "split_rows",
    "split_summary",
]
