"""How long a stream takes: a row's time from its receipt to its micro-batch as a mergeable sketch, and each micro-batch's duration, kept as a table.

Rows are never gathered for this: every task adds to a KLL sketch, the tasks' sketches are merged as the micro-batch's observed metric, and a row per micro-batch reaches the driver. With k = 200 the rank of a quantile is off by 1.33 % at most, with 99 % confidence, and merging micro-batches keeps that."""

from __future__ import annotations

import threading
import uuid

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

C = F.col
K = 200
METRIC = "latency"
TABLE = pa.schema([("query", pa.string()), ("batch", pa.int64()), ("rows", pa.int64()), ("trigger_ms", pa.int64()), ("add_batch_ms", pa.int64()), ("observed", pa.int64()), ("sketch", pa.binary())])


def observed(df: DataFrame, received_us: str = "received_us") -> DataFrame:
    """df, whose micro-batches report the sketch of microseconds from a row's receipt to the micro-batch's time. Rows without a receipt are not counted."""
    waited = F.unix_micros(F.current_timestamp()) - C(received_us)
    return df.observe(METRIC, F.count(waited).alias("n"), F.kll_sketch_agg_bigint(waited, F.lit(K)).alias("sketch"))


class LatencyListener(StreamingQueryListener):
    """Writes a row of TABLE per micro-batch as Parquet into a folder, `every` rows at a time and at a query's end. Add it by spark.streams.addListener."""

    def __init__(self, path: str, every: int = 100):
        self.path, self.every, self.rows, self.lock = path, every, [], threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = p.observedMetrics.get(METRIC)
        sketch = bytes(own["sketch"]) if own is not None and own["n"] else None
        self.keep((p.name or str(p.id), p.batchId, p.numInputRows, p.durationMs.get("triggerExecution"), p.durationMs.get("addBatch"), own["n"] if own is not None else None, sketch))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def keep(self, row: tuple) -> None:
        with self.lock:
            self.rows.append(row)
        if len(self.rows) >= self.every:
            self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            store, base = fs.FileSystem.from_uri(self.path)
            store.create_dir(base, recursive=True)
            parquet.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), TABLE)], schema=TABLE), f"{base}/{uuid.uuid4().hex}.parquet", filesystem=store)


def percentiles(table: DataFrame, ranks: list[float]) -> DataFrame:
    """query, batches, rows, and wait_us at each rank, by name p50 and so on, with batch_ms, the same of whole micro-batches (these are few and exact)."""
    name = lambda r: f"p{r * 100:g}".replace(".", "_")
    g = table.where(C("rows") > 0).groupBy("query").agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), F.kll_merge_agg_bigint("sketch").alias("_s"), F.percentile("trigger_ms", ranks).alias("_b"))
    return g.select("query", "batches", "rows", *[F.kll_sketch_get_quantile_bigint("_s", F.lit(r)).alias(f"wait_us_{name(r)}") for r in ranks], *[C("_b")[k].alias(f"batch_ms_{name(r)}") for k, r in enumerate(ranks)])
