"""Detectors as streams that give what their batch forms give, up to the watermark: beacons, reflection and novel fingerprints. Each is a chain of two stateful operators; the first spreads what a popular service or a victim receives over finer keys."""

from __future__ import annotations

import math
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ..config import AddressPlan, C2Config, ReflectionConfig, TlsConfig, WindowConfig
from ..operators import filters
from .inorder import InOrder, InShards, arrow_schema, shard_of
from .windows import timed_by_all

C = F.col


class FleetProcessor(InOrder):
    """Per service: its first `most` hosts, and whether a row comes when it has that many. The state is `most` names; the rows of a shared service are dropped, as no alert comes of them."""

    fields = "t_us long, event_seq long, src_ip string"
    stamped = True

    def __init__(self, keys: list[str], most: int):
        self.most, self.out = most, [*keys, "t_us", "event_seq", "src_ip"]

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.hosts = handle.getValueState("hosts", "names array<string>")

    def step(self, key: tuple, rows: list[tuple], now_us: int) -> list[tuple]:
        names = list(self.hosts.get()[0]) if self.hosts.exists() else []
        told = []
        for t, seq, src in rows:
            if src not in names and len(names) < self.most:
                names.append(src)
            if len(names) < self.most:
                told.append((*key, t, seq, src))
        self.hosts.update((names,))
        return told


class BeaconProcessor(InOrder):
    """Per conversation: the session's last `history` stamps, its beginning, and whether it has alerted. State goes when the watermark is a gap past the last stamp."""

    fields = "t_us long, event_seq long"

    def __init__(self, keys: list[str], cfg: C2Config):
        self.cfg, self.gap_us = cfg, int(cfg.gap_s * 1_000_000)
        self.out = [*keys, "t_us", "event_seq", "first_us", "event_count", "iat_mean", "iat_std", "iat_cv", "score", "severity"]

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.stamps = handle.getListState("stamps", "t_us long")
        self.span = handle.getValueState("span", "first_us long, last_us long, fired boolean")

    def step(self, key: tuple, rows: list[tuple], now_us: int) -> list[tuple]:
        cfg, told = self.cfg, []
        stamps = [r[0] for r in self.stamps.get()] if self.stamps.exists() else []
        first, last, fired = self.span.get() if self.span.exists() else (None, None, False)
        for t, seq in rows:
            if last is None or t - last > self.gap_us:
                stamps, first, fired = [], t, False
            last = t
            stamps = [*stamps[-(cfg.history - 1) :], t]
            if not fired and len(stamps) >= cfg.min_events:
                gaps = [g for a, b in zip(stamps, stamps[1:]) if (g := (b - a) / 1e6) > cfg.min_iat_s]
                mean = sum(gaps) / len(gaps) if gaps else 0.0
                if len(gaps) >= cfg.min_valid and mean >= cfg.min_mean_s:
                    std = math.sqrt(sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1)) if len(gaps) > 1 else 0.0
                    cv = std / mean
                    if fired := cv <= cfg.max_cv:
                        told.append((*key, t, seq, first, len(stamps), mean, std, cv, min(max(1 - 0.5 * cv / cfg.max_cv, 0.0), 1.0), "CRITICAL" if cv < 0.08 else "HIGH"))
        if last is None or now_us - last > self.gap_us:
            self.stamps.clear()
            self.span.clear()
        else:
            self.stamps.put([(t,) for t in stamps])
            self.span.update((first, last, fired))
        return told

    def idle(self, now_us: int) -> int | None:
        return (self.span.get()[1] + self.gap_us) // 1000 + 1 if self.span.exists() else None


def c2_alerts(events: DataFrame, cfg: C2Config = C2Config(), window: WindowConfig = WindowConfig()) -> DataFrame:
    """Beacon alerts of a stream: the batch detector's rows whose event the watermark has passed."""
    keys = list(cfg.key)
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    e = filters.c2_input(timed_by_all(events, window), cfg).select(*keys, "t_us", "event_seq", "ts")
    if cfg.fleet_hosts:
        service = [k for k in keys if k != "src_ip"]
        named = ", ".join(f"{k} {kind[k]}" for k in service)
        # Rows leave when the watermark passes them, so their own time is never late for the next operator.
        e = e.groupBy(*service).transformWithStateInPandas(FleetProcessor(service, cfg.fleet_hosts), f"{named}, t_us long, event_seq long, src_ip string, ts timestamp", "append", "eventTime", eventTimeColumnName="ts")
    out = ", ".join(f"{k} {kind[k]}" for k in keys) + ", t_us long, event_seq long, first_us long, event_count int, iat_mean double, iat_std double, iat_cv double, score double, severity string"
    return e.groupBy(*keys).transformWithStateInPandas(BeaconProcessor(keys, cfg), out, "append", "eventTime")


class AskedProcessor(InShards):
    """Per host, port and amplifier: answers of each closed second, and whether the first of them was asked for within the memory. The state is the last request's time, which goes when the memory is over."""

    fields = "victim string, port int, amp string, t_us long, event_seq long, asks boolean, packets long, bytes long"
    width = 3
    kept = arrow_schema("victim string, port int, amp string, asked_us long")
    stamped = True
    out = ["victim", "port", "amp", "t_us", "event_seq", "packets", "bytes", "solicited"]

    def __init__(self, cfg: ReflectionConfig, second_us: int):
        self.memory_us, self.unit_us = int(cfg.memory_s * 1_000_000), second_us

    def step(self, key: tuple, state: tuple | None, rows: list[tuple], now_us: int) -> tuple[list[tuple], tuple | None]:
        last = state[0] if state else None
        seconds: dict[int, list] = {}
        for t, _, asks, packets, size in rows:
            if asks:
                last = t
                continue
            own = seconds.setdefault(t // self.unit_us, [0, 0, last is not None and t - last <= self.memory_us])
            own[0], own[1] = own[0] + packets, own[1] + size
        return [(*key, (s + 1) * self.unit_us, s, *own) for s, own in seconds.items()], (last,) if last is not None else None

    def over_us(self, state: tuple) -> int:
        return state[0] + self.memory_us + 1


class VictimProcessor(InShards):
    """Per victim and port: a ring of the last window_s seconds' amplifiers, and the second that last fired. Seconds come closed; each is judged over the ring, with the cooldown. State goes when ring and cooldown are over."""

    fields = "victim string, port int, t_us long, event_seq long, amp string, packets long, bytes long, solicited boolean"
    width = 2
    ring = pa.list_(pa.struct([("second", pa.int64()), ("amp", pa.string()), ("packets", pa.int64()), ("bytes", pa.int64()), ("solicited", pa.bool_())]))
    kept = pa.schema([("victim", pa.string()), ("port", pa.int32()), ("ring", ring), ("last", pa.int64()), ("fired", pa.int64())])
    out = ["dst_ip", "amplifier_port", "second", "first_second", "fan_in", "unsolicited_share", "pps", "bps", "packets", "bytes", "score", "severity"]

    def __init__(self, cfg: ReflectionConfig, second_us: int):
        self.cfg, self.second_us = cfg, second_us

    def step(self, key: tuple, state: tuple | None, rows: list[tuple], now_us: int) -> tuple[list[tuple], tuple | None]:
        cfg, told = self.cfg, []
        ring, last, fired = state or ([], None, None)
        ring = [tuple(r.values()) for r in ring]
        for second, own in groupby(rows, key=lambda r: r[1]):
            ring = [r for r in ring if r[0] > second - cfg.window_s] + [r[1:] for r in own]
            last, first = second, min(r[0] for r in ring)
            packets, size, span = sum(r[2] for r in ring), sum(r[3] for r in ring), second - first + 1
            amps: dict[str, bool] = {}
            for r in ring:
                amps[r[1]] = amps.get(r[1], False) or r[4]
            share, pps, bps = sum(not v for v in amps.values()) / len(amps), packets / span, size * 8 / span
            hot = len(amps) >= cfg.min_fan_in and share >= cfg.min_unsolicited and (pps >= cfg.min_pps or bps >= cfg.min_bps)
            if hot and (fired is None or second - fired >= cfg.cooldown_s):
                fired, ratio = second, max(pps / cfg.min_pps, bps / cfg.min_bps)
                score = 0.5 + 0.5 * min(max((ratio - 1) / 4, 0.0), 1.0)
                told.append((*key, second, first, len(amps), share, pps, bps, packets, size, score, "CRITICAL" if pps >= 5 * cfg.min_pps or bps >= 5 * cfg.min_bps else "HIGH"))
        return told, ([dict(zip(("second", "amp", "packets", "bytes", "solicited"), r)) for r in ring], last, fired)

    def over_us(self, state: tuple) -> int:
        """When neither the ring nor the cooldown matters to a later second."""
        _, last, fired = state
        return max(last + self.cfg.window_s, fired + math.ceil(self.cfg.cooldown_s) if fired is not None else 0) * self.second_us


def reflection_alerts(events: DataFrame, cfg: ReflectionConfig = ReflectionConfig(), plan: AddressPlan = AddressPlan(), window: WindowConfig = WindowConfig(), second_us: int = 1_000_000) -> DataFrame:
    """Reflection alerts of a stream: the batch detector's rows of all seconds that the watermark has closed. A flood to one victim is combined by second and amplifier before it meets in the victim's state."""
    e = timed_by_all(events, window)
    amount = [F.coalesce("packets", F.lit(1)).cast("long").alias("packets"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "t_us", "event_seq", "ts"]
    answers = filters.reflection_responses(e, plan).select(C("dst_ip").alias("victim"), C("src_port").cast("int").alias("port"), C("src_ip").alias("amp"), F.lit(False).alias("asks"), *amount)
    asks = filters.reflection_requests(e, plan).select(C("src_ip").alias("victim"), C("dst_port").cast("int").alias("port"), C("dst_ip").alias("amp"), F.lit(True).alias("asks"), *amount)
    closed = answers.unionByName(asks).withColumn("shard", shard_of("victim", "port", "amp")).groupBy("shard").transformWithStateInPandas(AskedProcessor(cfg, second_us), "victim string, port int, amp string, t_us long, event_seq long, packets long, bytes long, solicited boolean, ts timestamp", "append", "eventTime", eventTimeColumnName="ts")
    out = "dst_ip string, amplifier_port int, second long, first_second long, fan_in int, unsolicited_share double, pps double, bps double, packets long, bytes long, score double, severity string"
    return closed.withColumn("shard", shard_of("victim", "port")).groupBy("shard").transformWithStateInPandas(VictimProcessor(cfg, second_us), out, "append", "eventTime")


class NoveltyProcessor(InOrder):
    """Per kind and fingerprint: when it was last shown, from the baseline at first. State goes when the watermark is novelty_s past it, as the next sighting is novel with it or without."""

    fields = "t_us long, event_seq long, last_us long"
    out = ["kind", "fingerprint", "t_us", "event_seq"]

    def __init__(self, novelty_us: int):
        self.novelty_us = novelty_us

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t_us long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update((int(initialState["last_us"].max()),))
        self.sleep((int(initialState["last_us"].max()) + self.novelty_us) // 1000 + 1)

    def step(self, key: tuple, rows: list[tuple], now_us: int) -> list[tuple]:
        told, last = [], self.last.get()[0] if self.last.exists() else None
        for first, seq, end in rows:
            if last is None or first - last > self.novelty_us:
                told.append((*key, first, seq))
            last = end if last is None else max(last, end)
        if last is None or now_us - last > self.novelty_us:
            self.last.clear()
        else:
            self.last.update((last,))
        return told

    def idle(self, now_us: int) -> int | None:
        return (self.last.get()[0] + self.novelty_us) // 1000 + 1 if self.last.exists() else None


def novel_fingerprints(events: DataFrame, cfg: TlsConfig = TlsConfig(), baseline: DataFrame | None = None, window: WindowConfig = WindowConfig(), slice_s: float = 60.0) -> DataFrame:
    """kind, fingerprint, t_us, event_seq of a stream's events that show a JA3 or JA4 for the first time in novelty_s, as soon as the watermark has closed their slice of time. baseline (kind, fingerprint, last_us) is the state to begin with.

    Slices are no longer than novelty_s, so only a slice's first event can be novel. A popular fingerprint is combined by slice within each task before its rows meet, so its state gets a row a slice."""
    slice_us = max(min(int(slice_s * 1_000_000), int(cfg.novelty_s * 1_000_000)), 1)
    shown = timed_by_all(events, window).select("ts", "t_us", "event_seq", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.nullif(F.lower(k), F.lit("")).alias("fingerprint")) for k in ("ja3", "ja4")])).alias("f")).where("f.fingerprint is not null")
    slices = shown.groupBy(F.window("ts", f"{slice_us} microseconds").alias("w"), C("f.kind").alias("kind"), C("f.fingerprint").alias("fingerprint")).agg(F.min(F.struct("t_us", "event_seq")).alias("at"), F.max("t_us").alias("last_us"))
    rows = slices.select("kind", "fingerprint", "at.*", "last_us", F.window_time("w").alias("ts"))
    known = baseline.select("kind", F.lower("fingerprint").alias("fingerprint"), "last_us").groupBy("kind", "fingerprint") if baseline is not None else None
    return rows.groupBy("kind", "fingerprint").transformWithStateInPandas(NoveltyProcessor(int(cfg.novelty_s * 1_000_000)), "kind string, fingerprint string, t_us long, event_seq long", "append", "eventTime", initialState=known)
