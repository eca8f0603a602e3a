"""Column expressions: dates, seasons, bins, encodings, scaling. All run in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The season of each month, and the bins of a rate of change in per cent, with what they exceed.
SEASONS = {"Bullish": (1, 2, 3, 4), "Bearish": (6, 7, 9, 10), "Normal": (5, 8, 11, 12)}
RATE_BINS = (("Very High Positive", 10.0), ("High Positive", 5.0), ("Low Positive", 1.0), ("Neutral", -1.0), ("Low Negative", -5.0))
LOWEST_BIN, NO_BIN = "High Negative", "Unknown"


def date_parts(time: Column) -> dict[str, Column]:
    return {"day": F.dayofmonth(time), "month": F.month(time), "year": F.year(time)}


def cyclic_weekday(time: Column) -> dict[str, Column]:
    """The day of the week (Monday 0) as a point on a circle."""
    angle = F.weekday(time) * F.lit(2 * math.pi / 7)
    return {"sin_date": F.sin(angle), "cos_date": F.cos(angle)}


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")


def year_month(year: Column, month: Column) -> Column:
    """'2021-3': without a leading zero."""
    return F.concat_ws("-", year.cast("string"), month.cast("string"))


def season(month: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        found = F.when(month.isin(*months), name).otherwise(found)
    return found


def one_hot(column: Column, categories: list[str], prefix: str) -> dict[str, Column]:
    """A 0/1 column for each category; 0 in all where the value is null."""
    return {f"{prefix}_{c}": F.coalesce((column == c).cast("double"), F.lit(0.0)) for c in categories}


def rate_bin(rate: Column) -> Column:
    found = F.lit(LOWEST_BIN)
    for name, over in reversed(RATE_BINS):
        found = F.when(rate > over, name).otherwise(found)
    return F.when(rate.isNull() | F.isnan(rate), NO_BIN).otherwise(found)


def binary_digits(code: Column, digits: int, prefix: str) -> dict[str, Column]:
    """The base-2 digits of an integer, highest first."""
    return {f"{prefix}_{i}": F.getbit(code.cast("int"), F.lit(digits - 1 - i)).cast("int") for i in range(digits)}


def ratio(a: Column, b: Column) -> Column:
    """a / b by the rules of floating point: signed infinity and NaN over zero."""
    over_zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).when(a == 0, F.lit(math.nan))
    return F.when(b == 0, over_zero).otherwise(a / F.when(b != 0, b))


def min_max(column: Column, low: Column, high: Column) -> Column:
    return (column - low) / F.nullif(high - low, F.lit(0.0))


def z_score(column: Column, mean: Column, std: Column) -> Column:
    """Null where std is zero."""
    return (column - mean) / F.nullif(std, F.lit(0.0))


def epoch_micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")).cast("double")
