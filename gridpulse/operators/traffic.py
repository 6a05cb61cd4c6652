"""From ingested records to one clean row per cell and time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.schemas import KEY, MEASURES, TIME

# Which directional measures add up to which total.
MERGES: dict[str, tuple[str, ...]] = {"sms_total": ("sms_in", "sms_out"), "calls_total": ("call_in", "call_out")}


def sum_measures(
    ingested: DataFrame, measures: Sequence[str] = MEASURES, keys: Sequence[str] = (KEY, TIME)
) -> DataFrame:
    """Sum every measure per key, folding countries; a sum over NULLs only is 0."""
    return ingested.groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in measures])


def merge_directions(sums: DataFrame, merges: Mapping[str, Sequence[str]] = MERGES) -> DataFrame:
    """Replace the directional columns by their totals."""
    used = {m for parts in merges.values() for m in parts}
    kept = [c for c in sums.columns if c not in used]
    totals = []
    for name, (head, *tail) in merges.items():
        total = F.col(head)
        for part in tail:
            total = total + F.col(part)
        totals.append(total.alias(name))
    plain = [c for c in kept if c not in (KEY, TIME)]
    return sums.select(*[c for c in (KEY, TIME) if c in kept], *totals, *plain)


def build_traffic(ingested: DataFrame) -> DataFrame:
    """The clean panel ``(cell_id, timestamp, sms_total, calls_total, internet_traffic)``."""
    return merge_directions(sum_measures(ingested))
