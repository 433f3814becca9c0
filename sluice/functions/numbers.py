"""Rounding, percentages, ratings and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def completion_pct(watched: Column, aired: Column) -> Column:
    """0 for none, 100 for all, else the floor of the percentage but 1 at least."""
    return F.when((watched <= 0) | (aired <= 0), F.lit(0)).when(watched >= aired, F.lit(100)).otherwise(F.greatest(F.lit(1), F.floor(watched * 100 / aired))).cast("int")


def half_star(stars: Column) -> Column:
    """Whether a rating is one of 0.5, 1 ... 5."""
    return stars.isin(*[k / 2 for k in range(1, 11)])


def exact_decimal(x: Column, precision: int = 5, scale: int = 3) -> Column:
    """A double by way of its shortest decimal text, so that 8.9 stays 8.9."""
    return x.cast("string").cast(f"decimal({precision},{scale})")


def corrected_date(raw: Column, season_offset: Column, default_offset: Column) -> Column:
    """The raw date moved by the season's offset, else the show's default, else not."""
    return F.date_add(raw, F.coalesce(season_offset, default_offset, F.lit(0)))


def sweep_due(key: Column, as_of: Column, days: int = 7) -> Column:
    """Whether it is the key's turn in a sweep over so many days."""
    return F.pmod(key, F.lit(days)) == F.pmod(F.unix_date(as_of), F.lit(days))


def estimate_tokens(text: Column) -> Column:
    return F.bround(F.octet_length(text) / 2.64).cast("long")
