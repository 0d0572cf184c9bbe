"""Fits over rows that keep coming in.

Least squares of each group needs the moments only, and these are sums: Structured Streaming keeps them as state, one row
for each group, and the coefficients of the groups that a batch touched are solved when it ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gramian.operators.design import Design
from gramian.operators.fit import grouped_moments, solve_spd


def fit_stream(rows: DataFrame, keys: Sequence[str], y: str, design: Design, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that works off what is there and appends (batch, keys, coefficients) of the touched groups to ``path``.

    A batch that is run again after a failure replaces its own rows.
    """

    def solve(moments: DataFrame, batch: int) -> None:
        solve_spd(moments, keys, design.names).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream = grouped_moments(rows, keys, y, design).writeStream.outputMode("update").foreachBatch(solve)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
