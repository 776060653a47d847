"""Helpers the test modules share."""


def rows(df, *cols):
    """Collect selected columns as sorted tuples (small test results only)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
