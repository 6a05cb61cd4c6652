"""Half-even rounding of doubles, done on the scaled binary value as array libraries do it.

A mean differs in its last bits with the order of summation; rounding to nine digits first keeps
such noise from deciding ties, so a report does not depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column | str, digits: int = 2) -> Column:
    scale = float(10**digits)
    return F.rint(F.round(x, 9) * scale) / scale


def fixed_text(x: Column | str, digits: int) -> Column:
    """A number as text with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", round_half_even(x, digits))
