"""Rolling means and deviations from blocks: a few lags per row, whatever the values are.

A frame aggregate reads the whole frame again for each row. Here a window of n rows is put together
from blocks of about sqrt(n) rows: lags lay the values of one block side by side, and further lags
fetch the moments of the blocks before. So a row costs about 2 * sqrt(n) lags in two passes over
the window instead of n updates of each aggregate.

Nothing is ever subtracted from a running total, so an early huge value leaves no error behind. For
deviations every mean is counted from the value of the window's last row, so only differences of
neighbouring values are added, and small moves of large numbers keep their digits. Windows that
hold a missing value, or too few rows, are missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from sessiongrid.schema import quoted

# The value of a series so many rows before a row.
Series = Callable[[int], Column]


def series(column: str, window: WindowSpec) -> Series:
    value = F.col(quoted(column))
    return lambda rows: F.lag(value, rows).over(window) if rows else value


def _total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def _moments(parts: list[tuple[int, Column, Column]]) -> tuple[Column, Column]:
    """Mean and sum of squared deviations of parts (rows, mean, squares) together."""
    rows = sum(n for n, _, _ in parts)
    mean = _total([m * F.lit(float(n)) for n, m, _ in parts]) / F.lit(float(rows))
    return mean, _total([q for _, _, q in parts] + [(m - mean) * (m - mean) * F.lit(float(n)) for n, m, _ in parts])


def add_rolling(
    df: DataFrame,
    window: WindowSpec,
    given: dict[str, Series],
    *,
    means: dict[str, tuple[str, int]] | None = None,
    deviations: dict[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """Add means and sample deviations, each named and given as (name in ``given``, number of rows)."""
    means, deviations = means or {}, deviations or {}
    kept = [*df.columns, *means, *deviations]
    wanted = [*means.values(), *deviations.values()]
    block = max(1, math.ceil(math.sqrt(max(rows for _, rows in wanted))))
    col = lambda label: F.col(quoted(label))
    at = lambda name, k: f"_{name}_{k}"
    label = lambda kind, name, n: f"_{kind}_{name}_{n}"

    # First pass: the values of a block side by side, then sums and moments of a block and of what is left over.
    widths = {name: min(block, max(rows for own, rows in wanted if own == name)) for name in {own for own, _ in wanted}}
    df = df.withColumns({at(name, k): given[name](k) for name, width in widths.items() for k in range(width)})
    sizes = lambda chosen: {(name, n) for name, rows in chosen for n in (min(rows, block), rows % block) if n}
    sums, spreads = sizes(means.values()), sizes(deviations.values())
    gap = lambda name, k: col(at(name, k)) - col(at(name, 0))
    df = df.withColumns(
        {label("sum", name, n): _total([col(at(name, k)) for k in range(n)]) for name, n in sums}
        | {label("mean", name, n): _total([gap(name, k) for k in range(n)]) / F.lit(float(n)) for name, n in spreads}
    )
    deviation = lambda name, n, k: gap(name, k) - col(label("mean", name, n))
    df = df.withColumns(
        {label("square", name, n): _total([deviation(name, n, k) * deviation(name, n, k) for k in range(n)]) for name, n in spreads}
    )

    # Second pass: the blocks that make up each window.
    def back(column: str, rows: int) -> Column:
        return F.lag(col(column), rows).over(window) if rows else col(column)

    def blocks(rows: int) -> list[tuple[int, int]]:
        """(rows, how far back it ends) of each block of a window."""
        if rows <= block:
            return [(rows, 0)]
        whole = [(block, k) for k in range(0, rows - rows % block, block)]
        return whole + ([(rows % block, rows - rows % block)] if rows % block else [])

    fetched: dict[str, Column] = {}
    for name, rows in means.values():
        fetched |= {f"{label('sum', name, n)}_{by}": back(label("sum", name, n), by) for n, by in blocks(rows)}
    for name, rows in deviations.values():
        for n, by in blocks(rows):
            fetched[f"{label('mean', name, n)}_{by}"] = back(at(name, 0), by) - col(at(name, 0)) + back(label("mean", name, n), by)
            fetched[f"{label('square', name, n)}_{by}"] = back(label("square", name, n), by)
    df = df.withColumns(fetched)
    made = {out: _total([col(f"{label('sum', name, n)}_{by}") for n, by in blocks(rows)]) / F.lit(float(rows)) for out, (name, rows) in means.items()}
    for out, (name, rows) in deviations.items():
        parts = [(n, col(f"{label('mean', name, n)}_{by}"), col(f"{label('square', name, n)}_{by}")) for n, by in blocks(rows)]
        made[out] = F.sqrt(_moments(parts)[1] / F.lit(float(rows - 1)))
    return df.withColumns(made).select(*[quoted(name) for name in kept])
