"""Joins and orderings that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Column,
    how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Join ``big`` with ``small`` so that the rows of one key are spread over ``salts`` tasks.

    ``small`` has few rows for each key and is repeated once for each salt; ``spread_by`` is a column of ``big`` that tells
    its rows apart (an id). ``how`` may be inner, left or left_semi or left_anti (sides that keep rows of ``big`` only).
    Rows of ``big`` with null keys match nothing, as in any join.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """The rows of a table that is fixed in size, for the driver; more than ``limit`` rows raise an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows and may not be sent to every task")
    return rows
