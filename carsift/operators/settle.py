"""Computing expensive columns exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: list[str]) -> DataFrame:
    """Same rows and columns, but the optimizer cannot substitute the expressions of `columns` into later predicates.

    A filter on a derived column is otherwise pushed through the projections by repeating the whole expression behind
    it, which evaluates it twice and, over several stages, multiplies the plan. The columns pass through a one-element
    generator, which stays inside whole-stage code generation; all other columns are still pruned and pushed as usual.
    """
    rest = [n for n in df.columns if n not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))
