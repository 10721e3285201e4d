"""Streaming forms of the windowed operators: watermark, tumbling windows in append mode, session summaries, and the push of incidents in small batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import WindowConfig

C = F.col


def timed(events: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """events with ts, a timestamp with a time zone made from t_us, and its watermark: the latest event less the delay. Spark moves it once a micro-batch."""
    return events.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", f"{int(cfg.delay_s * 1000)} milliseconds")


def timed_by_all(events: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """The same with a watermark that follows all events, also those that are filtered out behind it. Spark moves a filter below the watermark unless it looks at its time, and a detector that sees few events would wait for the next of its own to close the last."""
    e = timed(events, cfg)
    return e.select(*[F.when(C("ts").isNotNull(), C(c)).alias(c) for c in events.columns], "ts")


def measures() -> list[tuple]:
    """What a window measures: its name, the aggregate, and how the aggregate's state becomes its value."""
    return [
        ("event_count", F.count(F.lit(1)), C), ("packets", F.sum(F.coalesce(C("packets"), F.lit(1))), C), ("bytes", F.sum(F.coalesce(C("bytes"), F.lit(0))), C), ("udp", F.sum((C("protocol") == "UDP").cast("long")), C),
        ("syn", F.sum((C("tcp_flags").bitwiseAND(F.lit(2)) > 0).cast("long")), C), ("approx_sources", F.hll_sketch_agg("src_ip"), F.hll_sketch_estimate),
    ]


def tumbling(events: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Closed windows: start_us, event_count, packets, bytes, udp events, SYN events, approximate distinct sources. In append mode a window leaves when the watermark passes its end; later events are dropped, and Spark counts them in the query's progress."""
    w = F.window("ts", f"{int(cfg.width_s * 1_000_000)} microseconds").alias("w")
    g = timed(events, cfg).groupBy(w).agg(*[agg.alias(name) for name, agg, _ in measures()])
    return g.select(F.unix_micros("w.start").alias("start_us"), *[value(name).alias(name) for name, _, value in measures()])


def still_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows that a stopped or finished query of tumbling() had not closed yet, in the form of the closed ones, out of its state store as of the last batch."""
    state = spark.read.format("statestore").load(checkpoint)
    # The state names several fields alike: its struct gets names by place.
    kinds = [f.dataType.simpleString() for f in state.schema["value"].dataType.fields]
    own = C("value").cast("struct<" + ", ".join(f"{name}: {kind}" for (name, *_), kind in zip(measures(), kinds)) + ">")
    return state.select(F.unix_micros("key.window.start").alias("start_us"), own.alias("v")).select("start_us", *[value(f"v.{name}").alias(name) for name, _, value in measures()])


def flushed(spark: SparkSession, closed: DataFrame, checkpoint: str) -> DataFrame:
    """All windows of a stream that has ended: those that its query put out, and those still open. The state is only read; a query that goes on from the checkpoint closes its open windows itself."""
    return closed.unionByName(still_open(spark, checkpoint))


def sliding(events: DataFrame, width_s: int = 5, step_s: int = 1, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Answer rates of amplifier ports by victim over sliding windows, for monitoring."""
    w = F.window("ts", f"{width_s} seconds", f"{step_s} seconds").alias("w")
    g = timed(events, cfg).groupBy(w, "dst_ip", "src_port").agg(F.sum(F.coalesce(C("packets"), F.lit(1))).alias("packets"), F.approx_count_distinct("src_ip").alias("approx_fan_in"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "dst_ip", "src_port", "packets", "approx_fan_in")


def session_summaries(events: DataFrame, keys: list[str], gap_s: float, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """keys, start_us, last_us, n, bytes of gap sessions; an event exactly the gap later still joins."""
    s = F.session_window("ts", f"{int(gap_s * 1_000_000)} microseconds").alias("s")
    g = timed(events, cfg).groupBy(s, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(C("bytes"), F.lit(0))).alias("bytes"), F.max("t_us").alias("last_us"))
    return g.select(*keys, F.unix_micros("s.start").alias("start_us"), "last_us", "n", "bytes")


def pushed(df: DataFrame, send: Callable[[list[dict], int], None], checkpoint: str, most: int = 500, every: str = "250 milliseconds"):
    """Start a query that hands each micro-batch's newest rows, `most` at the most, to send(rows, batch id). The batch id lets a sink pass over a batch that it has had."""

    def batch(rows: DataFrame, k: int) -> None:
        order = [C(c).desc() for c in ("last_us", "start_us", "t_us") if c in rows.columns][:1]
        send([r.asDict() for r in rows.orderBy(*order).limit(most).collect()], k)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def appended(df: DataFrame, path: str, checkpoint: str):
    """Start a query that appends rows to a Parquet ledger, each batch once, and ends when all input that is there has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def drained(df: DataFrame, path: str, checkpoint: str) -> None:
    """The same for sources that know no such end: run until all input that is there has been read and the watermark's last batch is done, then stop."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
