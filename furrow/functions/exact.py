"""Order-free means.

Readings are added as decimals with all the digits they are written with: the sum is the same in
any order, in a batch, a stream, or after a task is run again, nothing is rounded before a mean is
compared with a threshold, and a mean that equals one does not fall on either side of it by noise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits after the point; a double between 0.1 and 1 has no more.
EXACT = "decimal(38,18)"


def units(reading: Column) -> Column:
    """A reading as a decimal; null for null and NaN. One that does not fit (1e20 or more, infinite)
    stops the query."""
    x = reading.cast("double")
    fits = F.when(~F.isnan(x), x)
    return F.when(F.abs(fits) >= 1e20, F.raise_error(F.lit("reading out of range")).cast(EXACT)) \
        .otherwise(fits.try_cast(EXACT))


def mean_of(total: Column, count: Column) -> Column:
    """Mean of a sum of units, null when nothing was counted."""
    return F.when(count > 0, total.cast("double") / count.cast("double"))


def mean(reading: Column) -> Column:
    """Aggregate: mean of a reading, by way of an exact sum."""
    u = units(reading)
    return mean_of(F.sum(u), F.count(u))


def value_of(total: Column) -> Column:
    """A sum of units as a reading again."""
    return total.cast("double")
