"""Building blocks for plans: a bounded count, columns computed once, joins without broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


BROADCAST_ROWS = 10_000


def at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns as the one-row output of a generator.

    A filter on a projected column is rewritten onto the column's inputs, which
    would run, say, a JSON parse again for every filter above it. A generated
    column is computed once and filters on it stay above.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(row)))


def hinted(dimension: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A dimension with a broadcast hint if it is counted to have few rows.

    Beyond the bound it is joined as it is: Spark shuffles both sides and splits hot
    keys (skew join). The join and its rows are the same either way.
    """
    return F.broadcast(dimension) if at_most(dimension, rows) else dimension


def shuffled(side: DataFrame) -> DataFrame:
    """A side of an equi-join that is never broadcast: both sides are shuffled and sorted.

    For rows generated from few bytes, such as grids: Spark sizes them by the table they
    come from, plans a broadcast, and keeps it however many rows there turn out to be.
    """
    return side.hint("merge")
