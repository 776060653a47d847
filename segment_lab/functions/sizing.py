"""Driver results that must be small."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checked_collect(df: DataFrame, max_cells: int, what: str, width: int = 1) -> list:
    """Collect a result of at most ``max_cells`` values (``width`` a row), or fail clearly.

    The bound is on values, and at most one row beyond it is fetched.
    """
    most = max(1, max_cells // max(1, width))
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {max_cells} values; refusing to collect")
    return rows
