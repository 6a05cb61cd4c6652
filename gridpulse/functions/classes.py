"""Class ladders: ordered category names cut at percentiles, with their map colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category -> colour, in ladder order.
COUNT_CLASSES = {
    "No Anomalies": "#2E8B57",
    "Low Activity": "#90EE90",
    "Moderate Activity": "#FFD700",
    "High Activity": "#FF8C00",
    "Very High Activity": "#FF4500",
    "Extreme Activity": "#8B0000",
}
QUINTILE_CLASSES = {
    "Very Low": "#2E8B57",
    "Low": "#90EE90",
    "Moderate": "#FFD700",
    "High": "#FF8C00",
    "Very High": "#8B0000",
}
EXTREME_CLASSES = {
    "Low Extreme": "#FFA500",
    "Moderate Extreme": "#FF6347",
    "High Extreme": "#DC143C",
    "Critical Extreme": "#8B0000",
}
UNKNOWN_COLOUR = "#CCCCCC"
BACKGROUND_COLOUR = "#E8E8E8"

# The percentiles each ladder is cut at.
COUNT_CUTS = (0.25, 0.50, 0.75, 0.90)
QUINTILE_CUTS = (0.20, 0.40, 0.60, 0.80)
EXTREME_CUTS = (0.25, 0.50, 0.75)


def ladder(x: Column | str, cuts: Sequence[float | None], names: Sequence[str]) -> Column:
    """The first name whose cut is >= x, the last name above all cuts."""
    x = F.col(x) if isinstance(x, str) else x
    steps = F.when(x <= F.lit(cuts[0]), names[0])
    for cut, name in zip(cuts[1:], names[1:]):
        steps = steps.when(x <= F.lit(cut), name)
    return steps.otherwise(names[len(cuts)])


def count_class(x: Column | str, cuts: Sequence[float | None]) -> Column:
    """Six steps: zero is its own class, the cuts come from the non-zero cells."""
    x = F.col(x) if isinstance(x, str) else x
    names = list(COUNT_CLASSES)
    return F.when(x == 0, names[0]).otherwise(ladder(x, cuts, names[1:]))


def quintile_class(x: Column | str, cuts: Sequence[float | None]) -> Column:
    return ladder(x, cuts, list(QUINTILE_CLASSES))


def extreme_class(x: Column | str, cuts: Sequence[float | None]) -> Column:
    return ladder(x, cuts, list(EXTREME_CLASSES))


def colour_of(category: Column | str, colours: dict[str, str], default: str = UNKNOWN_COLOUR) -> Column:
    category = F.col(category) if isinstance(category, str) else category
    table = F.create_map(*[F.lit(v) for pair in colours.items() for v in pair])
    return F.coalesce(F.try_element_at(table, category), F.lit(default))
