"""Late rows, counted and kept: rows whose window the watermark has closed go on with a flag, so that on-time and late rows together are all rows.

Spark's own counter, numRowsDroppedByWatermark, counts what a stateful operator drops after rows have been combined by window and task, and drops by the watermark of the micro-batch before; `dropped` reads it for monitoring. Here every row is judged by the watermark that its micro-batch begins with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import WindowConfig
from .windows import timed

#: Keys that rows are dealt out to: the state is one pair of counts for each.
SLOTS = 64


class LateProcessor(StatefulProcessor):
    """Per slot: how many rows were on time and late so far."""

    def __init__(self, columns: list[str], width_us: int):
        self.columns, self.width_us = columns, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "on_time long, late long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        on_time, late = self.counts.get() if self.counts.exists() else (0, 0)
        for b in rows:
            b = b[self.columns].assign(late=(b["t_us"] // self.width_us + 1) * self.width_us <= now_us, watermark_us=now_us)
            late, on_time = late + int(b["late"].sum()), on_time + int((~b["late"]).sum())
            yield b
        self.counts.update((on_time, late))

    def close(self) -> None:
        pass


def marked(events: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """The rows of a stream with late (has the watermark passed the end of the row's window?) and watermark_us, as they come. Columns of nullable whole numbers should be filled, as pandas has none."""
    width_us = int(cfg.width_s * 1_000_000)
    # A plain copy of the time: Spark drops late rows itself where a stateful operator sees the watermark's own column.
    e = timed(events, cfg).withColumn("ts", F.timestamp_micros("t_us")).withColumn("_slot", F.pmod(F.xxhash64("t_us", "event_seq"), F.lit(SLOTS)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    return e.groupBy("_slot").transformWithStateInPandas(LateProcessor(events.columns, width_us), f"{kinds}, late boolean, watermark_us long", "append", "eventTime")


def dropped(query) -> int:
    """Rows, combined by window and task, that the query's stateful operators have dropped for being late."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
