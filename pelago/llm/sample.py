"""Bounded samples of labelled rows, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, by: int) -> Column:
    """crc32 of the id's decimal text, modulo ``by``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % by


def bounded_sample(rows: DataFrame, key: list[str], at_most: int, seed: int = 0) -> DataFrame:
    """About ``at_most`` of the different rows, the same ones each time: those whose ``key`` hashes low enough.

    Rows with equal keys are one, so neither an id with many texts nor a row with many copies takes all or none.
    """
    n = rows.agg(F.approx_count_distinct(F.xxhash64(*key), 0.02)).first()[0]
    low = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) < (int(at_most / n * (1 << 30)) if n > at_most else 1 << 30)
    return rows.where(low).dropDuplicates(key)
