"""Rows in order of event time within each key: stateful operators that hold rows until the watermark has passed them. What is built on them sees each key's rows once, sorted by time and then by number, as the batch operators do. InOrder asks the state server several times a key, which suits few keys with many rows; InShards has one state for many keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession):
    """The RocksDB state store, which keyed state needs, for the queries started within; then the session's own again."""
    own = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, own)


class InOrder(StatefulProcessor):
    """Subclasses name the `fields` of their input rows, the first two of which are t_us and event_seq, and what they put out, and turn rows that are due into output in `step`. The rows that wait are those of the watermark's delay and of one micro-batch; one timer a key wakes it at the first of them."""

    fields: str
    out: list[str]
    unit_us: int = 0
    #: Does the output have ts, made of its t_us, for a stateful operator behind this one?
    stamped: bool = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.columns = [f.split()[0] for f in self.fields.split(", ")]
        self.waiting = handle.getListState("waiting", self.fields)
        self.states(handle)

    def states(self, handle: StatefulProcessorHandle) -> None:
        """The subclass's own state."""

    def step(self, key: tuple, rows: list[tuple], now_us: int) -> list[tuple]:
        """Output for rows that are due, in order."""
        raise NotImplementedError

    def idle(self, now_us: int) -> int | None:
        """When to be woken though nothing waits, to drop state; None for never."""
        return None

    def due_ms(self, t_us: int) -> int:
        """When a row is due: when the watermark passes it, or the end of its unit of time if there is one."""
        at = (t_us // self.unit_us + 1) * self.unit_us if self.unit_us else t_us
        return -(-at // 1000)

    def sleep(self, ms: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ms is not None:
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for b in rows for r in b[self.columns].itertuples(index=False, name=None)]
        self.waiting.appendList(new)
        first = self.due_ms(min(r[0] for r in new))
        timers = list(self.handle.listTimers())
        if not timers or first < min(timers):
            self.sleep(first)
        yield self.told([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        cut = next((k for k, r in enumerate(rows) if self.due_ms(r[0]) > now_ms), len(rows))
        told = self.step(key, rows[:cut], now_ms * 1000)
        if cut < len(rows):
            self.waiting.put(rows[cut:])
            self.sleep(self.due_ms(rows[cut][0]))
        else:
            self.waiting.clear()
            at = self.idle(now_ms * 1000)
            self.sleep(max(at, now_ms + 1) if at is not None else None)
        yield self.told(told)

    def told(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.out)
        return out.assign(ts=pd.to_datetime(out["t_us"].astype("int64"), unit="us", utc=True)) if self.stamped else out

    def close(self) -> None:
        pass


#: Shards that a stream's keys are dealt over. Fixed when a query starts, as its state is kept by shard.
SHARDS = 256
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def shard_of(*keys: str, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")


def arrow_schema(fields: str) -> pa.Schema:
    return pa.schema([(f.split()[0], KINDS[f.split()[1]]) for f in fields.split(", ")])


def to_bytes(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def from_bytes(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(rows)).read_all()


class Waiting(StatefulProcessor):
    """Holds rows (fields, t_us among them) until the watermark has passed them, as chunks of Arrow's bytes: a chunk for each batch that the worker is handed, so neither a key's rows of a micro-batch nor those that wait are ever in its memory together. One timer wakes a key at the first row that is due. Subclasses say in `woken` what they do with the chunks' rows that are."""

    fields: str
    out: list[str]
    unit_us: int = 0
    #: Does the output have ts, made of its t_us, for a stateful operator behind this one?
    stamped: bool = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.schema = handle, arrow_schema(self.fields)
        self.chunks = handle.getMapState("chunks", "chunk long", "rows binary")
        self.index = handle.getValueState("index", "wake_ms long, chunk array<long>, due_ms array<long>")
        self.states(handle)

    def states(self, handle: StatefulProcessorHandle) -> None:
        """The subclass's own state."""

    def taken(self, rows: pa.Table) -> tuple[pa.Table, int | None]:
        """The rows of a batch that wait, and when to be woken for others that the subclass has kept."""
        return rows, None

    def woken(self, key: tuple, due: Iterator[pa.Table], now_us: int) -> Iterator[pd.DataFrame]:
        """Output for the rows that are due, which come by chunks."""
        raise NotImplementedError

    def idle(self) -> int | None:
        """When to be woken though nothing waits, to drop state; None for never."""
        return None

    def due_ms(self, t_us: int) -> int:
        """When a row is due: when the watermark passes it, or the end of its unit of time if there is one."""
        at = (t_us // self.unit_us + 1) * self.unit_us if self.unit_us else t_us
        return -(-at // 1000)

    def due_before(self, now_ms: int) -> int:
        """The times that are due by then are those before this one."""
        now_us = now_ms * 1000
        return now_us // self.unit_us * self.unit_us if self.unit_us else now_us + 1

    def indexed(self) -> tuple[int | None, dict[int, int]]:
        wake, chunks, due = self.index.get() if self.index.exists() else (None, [], [])
        return wake, dict(zip(chunks, due))

    def sleep(self, old: int | None, chunks: dict[int, int], at: int | None) -> None:
        """Keep the index, and one timer, at `at`."""
        if old is not None and old != at:
            self.handle.deleteTimer(old)
        if at is not None and at != old:
            self.handle.registerTimer(at)
        if at is None and not chunks:
            self.index.clear()
        else:
            self.index.update((at, list(chunks), list(chunks.values())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wake, chunks = self.indexed()
        number, at = max(chunks, default=-1) + 1, [wake]
        for b in rows:
            new, other = self.taken(pa.Table.from_pandas(b[self.schema.names], self.schema, preserve_index=False))
            at.append(other)
            if new.num_rows:
                self.chunks.updateValue((number,), (to_bytes(new),))
                chunks[number] = self.due_ms(pc.min(new["t_us"]).as_py())
                at.append(chunks[number])
                number += 1
        self.sleep(wake, chunks, min((k for k in at if k is not None), default=None))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        _, chunks = self.indexed()
        cut = pa.scalar(self.due_before(now_ms), pa.int64())

        def due() -> Iterator[pa.Table]:
            for number in [n for n, at in chunks.items() if at <= now_ms]:
                rows = from_bytes(self.chunks.getValue((number,))[0])
                late = rows.filter(pc.greater_equal(rows["t_us"], cut))
                if late.num_rows:
                    self.chunks.updateValue((number,), (to_bytes(late.combine_chunks()),))
                    chunks[number] = self.due_ms(pc.min(late["t_us"]).as_py())
                else:
                    self.chunks.removeKey((number,))
                    del chunks[number]
                yield rows.filter(pc.less(rows["t_us"], cut))

        yield from self.woken(key, due(), now_ms * 1000)
        at = min(chunks.values()) if chunks else self.idle()
        # The timer that has gone off is deleted by Spark behind this call.
        self.sleep(None, chunks, max(at, now_ms + 1) if at is not None else None)

    def told(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.out)
        return out.assign(ts=pd.to_datetime(out["t_us"].astype("int64"), unit="us", utc=True)) if self.stamped else out

    def close(self) -> None:
        pass


class InShards(Waiting):
    """Many keys a state: the stream is grouped by shard_of its keys, which are the first `width` of the fields, with t_us and event_seq behind them. What the keys keep is one table of Arrow's bytes a shard, read and written once a micro-batch that has rows for it. A key's state is dropped when the shard is next woken after the key's time is over; the last of them wakes it."""

    width: int
    kept: pa.Schema

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("own", "over_ms long, keys binary")

    def step(self, key: tuple, state: tuple | None, rows: list[tuple], now_us: int) -> tuple[list[tuple], tuple | None]:
        """Output for a key's rows that are due, in order, and its new state."""
        raise NotImplementedError

    def over_us(self, state: tuple) -> int:
        """From when a key's state matters no more to a row."""
        raise NotImplementedError

    def woken(self, key: tuple, due: Iterator[pa.Table], now_us: int) -> Iterator[pd.DataFrame]:
        n, told, rows = self.width, [], {}
        for t in due:
            for r in zip(*[c.to_pylist() for c in t.columns]):
                rows.setdefault(r[:n], []).append(r[n:])
        states = {}
        if self.own.exists():
            states = {r[:n]: r[n:] for r in zip(*[c.to_pylist() for c in from_bytes(self.own.get()[1]).columns])}
        for k, own in rows.items():
            own.sort(key=lambda r: r[:2])
            new, states[k] = self.step(k, states.get(k), own, now_us)
            told += new
        # Rows that still wait can be older than the watermark, back to the beginning of its unit of time.
        done_us = self.due_before(now_us // 1000)
        states = {k: s for k, s in states.items() if s is not None and self.over_us(s) >= done_us}
        if states:
            columns = list(zip(*[k + s for k, s in states.items()]))
            self.over = self.due_ms(max(map(self.over_us, states.values())))
            self.own.update((self.over, to_bytes(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.kept)], schema=self.kept))))
        else:
            self.over = None
            self.own.clear()
        if told:
            yield self.told(told)

    def idle(self) -> int | None:
        return self.over
