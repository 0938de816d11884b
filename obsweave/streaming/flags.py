"""The row-local flags on a stream: they need no state, so they run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from obsweave.columns import Columns
from obsweave.operators.flags import FlagRules, add_local_flags
from obsweave.sources.reference import References


def flag_stream(
    stream: DataFrame, cols: Columns = Columns(), refs: References | None = None,
    rules: FlagRules = FlagRules(),
) -> DataFrame:
    """Flags of each arriving record; duplicates and outliers need the whole table."""
    return add_local_flags(stream, cols, refs or References(), rules)
