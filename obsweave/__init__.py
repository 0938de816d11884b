"""Quality flags and sampling-bias measures for large tables of observations."""

from obsweave.columns import Columns

__all__ = ["Columns"]
