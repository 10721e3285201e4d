"""Registered queries against their SQL in DuckDB: a chosen few, or all of them with ALL_QUERIES=1."""

import os
from pathlib import Path

import pytest

from tidewatch.plans.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
FEW = ["window_summary", "flow_id_5tuple", "scan_detect", "c2_detect", "dga_detect", "dns_tunnel_detect", "exfil_detect", "tls_quic_detect", "reflection_windows", "slowloris_detect", "dedup_lifecycle", "hash_chain_append", "alert_attribution", "packet_headers", "flow_records", "stream_windows", "stream_windows_flushed", "template_asof", "capture_ranges", "reflection_detect", "fingerprint_asof", "flatten_evidence", "window_samples", "threshold_sweep", "jitter_sweep", "evidence_contract"]
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("key", sorted(ORACLES) if os.environ.get("ALL_QUERIES") else FEW)
def test_query_equals_its_sql(spark, duck, key):
    df = QUERIES[key](spark, str(DATA))
    r = duck.execute(ORACLES[key])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(plain(x) for x in row)) for row in r.fetchall())
    got = sorted(repr(tuple(plain(x) for x in row)) for row in df.select(*names).collect())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
