"""Small helpers for pandas frames that go back to Spark."""

from __future__ import annotations

import pandas as pd


def plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """``pdf`` with text columns as plain objects: filtered frames of Arrow-backed text can't be sent back when they are empty."""
    return pdf.astype({c: object for c in pdf.columns if isinstance(pdf[c].dtype, pd.StringDtype)})
