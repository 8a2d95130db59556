"""Joins of rows with one fact per key where few keys may hold any share of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows on, and from this part of all rows on: there are at most HOT_KEYS hot keys.
HOT_ROWS = 4096
HOT_KEYS = 1 << 17


def hot_rows(total: int) -> int:
    """The least number of rows of a hot key in a table of ``total`` rows."""
    return max(HOT_ROWS, -(-total // HOT_KEYS))


def join_by_key(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row per key and the number of its ``rows`` in ``size``.

    Rows of hot keys stay where they are: the facts of at most ``HOT_KEYS`` keys are broadcast. All other rows are
    shuffled by their keys, none of which fills a task. Both tables are read more than once and should be stored.
    """
    least = hot_rows(total)
    hot = F.broadcast(facts.where(F.col(size) >= least).drop(size))
    cold = facts.where(F.col(size) < least).drop(size)
    others = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(others.join(cold, keys))
