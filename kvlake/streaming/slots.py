"""Streams: slots for sequences that grow while they are read, and reports by window of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kvlake.operators.paging import BLOCK


def slot_stream(appends: DataFrame, block: int = BLOCK) -> DataFrame:
    """seq_id, order, n, start, first_block, new_blocks of every append of a stream (seq_id, order, n), as
    `paging.block_table` gives them for a table. The state of a sequence is its length alone. Appends of one micro-batch
    are taken in their order; one that comes later than a greater order is placed where it arrives."""
    kind = dict(appends.dtypes)["seq_id"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length = state.get[0] if state.exists else 0
        rows = []
        for r in pd.concat(list(parts)).sort_values("order").itertuples():
            n = max(0, int(r.n)) if r.n == r.n and r.n is not None else 0
            rows.append([key[0], int(r.order), n, length, length // block, -(-(length + n) // block) - -(-length // block)])
            length += n
        state.update((length,))
        yield pd.DataFrame(rows, columns=["seq_id", "order", "n", "start", "first_block", "new_blocks"])

    return appends.groupBy("seq_id").applyInPandasWithState(
        run, f"seq_id {kind}, order long, n long, start long, first_block long, new_blocks long", "length long", "append", GroupStateTimeout.NoTimeout
    )


def windowed_latency(events: DataFrame, late: str, width: str, at: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Per window of event time and group: n, avg and the largest value; events later than `late` are left out."""
    held = events.withWatermark(at, late).groupBy(F.window(at, width), by)
    return held.agg(F.count(value).alias("n"), F.avg(value).alias("avg"), F.max(value).alias("most")).select(F.col("window.start").alias("start"), by, "n", "avg", "most")
