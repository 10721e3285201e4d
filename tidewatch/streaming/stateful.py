"""Detectors with state across micro-batches: alerts at the first crossing, latched until a key has been idle for its gap, and a reflection alert's cooldown. State lives in the state store by key and is dropped by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import ScanConfig, WindowConfig
from ..operators.filters import scan_input
from .windows import timed

SCAN_OUT = "src_ip string, t_us long, unique_dst_count int, unique_port_count int, threat_class string, score double"


class ScanProcessor(StatefulProcessor):
    """Per source: hosts and ports of the session as map states, first and last time and the latch as a value. Late and out-of-order events of a batch are put in order first."""

    def __init__(self, cfg: ScanConfig = ScanConfig()):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "last_us long, hosts int, ports int, fired boolean")
        self.hosts = handle.getMapState("hosts", "host string", "seen boolean")
        self.ports = handle.getMapState("ports", "port int", "seen boolean")

    def clear(self) -> None:
        self.span.clear()
        self.hosts.clear()
        self.ports.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cfg, gap = self.cfg, int(self.cfg.gap_s * 1_000_000)
        last, n_hosts, n_ports, fired = self.span.get() if self.span.exists() else (None, 0, 0, False)
        out = []
        for r in pd.concat(list(rows)).sort_values(["t_us", "event_seq"]).itertuples():
            if last is not None and r.t_us - last > gap:
                self.clear()
                n_hosts, n_ports, fired = 0, 0, False
            last = r.t_us
            if not fired and r.dst_ip and not self.hosts.containsKey((r.dst_ip,)):
                self.hosts.updateValue((r.dst_ip,), (True,))
                n_hosts += 1
            if not fired and pd.notna(r.dst_port) and not self.ports.containsKey((int(r.dst_port),)):
                self.ports.updateValue((int(r.dst_port),), (True,))
                n_ports += 1
            if not fired and (n_hosts >= cfg.min_hosts or n_ports >= cfg.min_ports):
                fired = True
                kind = "network_scan" if n_hosts >= cfg.min_hosts and n_ports >= cfg.min_ports else "port_scan" if n_ports >= cfg.min_ports else "host_sweep"
                out.append((key[0], int(r.t_us), n_hosts, n_ports, kind, max(n_hosts / cfg.min_hosts, n_ports / cfg.min_ports)))
        self.span.update((int(last), n_hosts, n_ports, fired))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(last // 1000 + gap // 1000 + 1))
        yield pd.DataFrame(out, columns=["src_ip", "t_us", "unique_dst_count", "unique_port_count", "threat_class", "score"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        yield pd.DataFrame([], columns=["src_ip", "t_us", "unique_dst_count", "unique_port_count", "threat_class", "score"])

    def close(self) -> None:
        pass


def scan_alerts(events: DataFrame, cfg: ScanConfig = ScanConfig(), window: WindowConfig = WindowConfig()) -> DataFrame:
    """Scan alerts of a stream. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    e = timed(scan_input(events), window).select("src_ip", "t_us", "event_seq", "dst_ip", "dst_port", "ts")
    return e.groupBy("src_ip").transformWithStateInPandas(ScanProcessor(cfg), SCAN_OUT, "append", "eventTime")
