"""Bounded samples of labelled rows for fitting, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30
#: A classifier may have so many labels.
MOST_LABELS = 10_000


def per_class(ids: DataFrame, label: str, most: int) -> DataFrame:
    """About ``most`` rows of (doc_id, label) for each label value, all where there are fewer, and in no
    case more than twice as many in all.  The labels' counts come from one aggregation; a row is taken
    if a hash of its id lies below its label's rate, so no label's rows meet in one task."""
    counts = {r[0]: r[1] for r in ids.groupBy(label).count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} values of {label}")
    if not counts:
        return ids.limit(0)
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(_STEPS))
    below = F.lit(False)
    for value, n in counts.items():
        below = below | ((F.col(label) == F.lit(value)) & (place < min(_STEPS, int(_STEPS * most / n))))
    return ids.where(below).orderBy(place, "doc_id").limit(2 * most * len(counts))
