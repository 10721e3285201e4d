"""The derived views where users count on past what an octet holds (user 64,000 and up), against the SQL."""

import json

import pytest
from pyspark.sql import functions as F
from test_queries import plain

from tidewatch.plans import views
from tidewatch.plans.catalog import ORACLES, QUERIES

USERS = [5, 62_500, 63_999, 64_000, 89_999, 1_000_000, 15_744_000]
KEYS = [
    "cidr_direction", "address_membership", "directional_bytes", "entropy_weighted", "filter_c2_events", "filter_exfil_events", "filter_reflection_requests", "filter_reflection_responses", "c2_detect", "exfil_detect", "evidence_contract", "jitter_sweep",
    "flow_records", "capture_ranges", "packet_headers",
]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("views")
    kinds = ["view", "click", "purchase", "signup", "error"]
    rows = [(n, 1_704_067_200 + n * 3600 + n % 5, USERS[n % 7], kinds[n * 3 % 5], (n * 37 % 2000) / 4, json.dumps({"k": n % 100})) for n in range(1400)]
    # Two beacons, of which the first is inbound throughout and passed over.
    for u, first in ((3, 20_001), (4, 40_001)):
        rows = [(first + 3 * r[0], *r[1:3], "view", r[4], '{"k": 7}') if r[0] % 7 == u and r[0] < 1400 else r for r in rows]
    e = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    e.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("key", KEYS)
def test_users_past_an_octet(spark, large, key):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{large}/events.parquet/*.parquet')")
    r = duck.execute(ORACLES[key])
    names = [c[0] for c in r.description]
    want = sorted(repr(tuple(plain(x) for x in row)) for row in r.fetchall())
    got = sorted(repr(tuple(plain(x) for x in row)) for row in QUERIES[key](spark, large).select(*names).collect())
    assert want and got == want


def test_addresses_survive_the_wire(spark):
    ips = ["10.10.0.1", "10.10.255.250", "10.10.256.1", "10.10.359.250", "10.10.62976.7", "198.51.100.10"]
    number = F.conv(views.wire(F.col("ip")), 16, 10).cast("long")
    dotted = F.concat_ws(".", *[F.floor(number / (1 << s)) % 256 for s in (24, 16, 8, 0)])
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", views.from_wire(dotted).alias("back")).collect()
    assert all(r.back == r.ip for r in rows)


@pytest.mark.parametrize("key", ["evidence_contract", "exfil_detect"])
def test_ratios_that_are_a_half_in_decimals_alone(spark, tmp_path, key):
    """27559 / 200 is 137.795, which as a double is below the half that its shortest text names."""
    import duckdb

    rows = [(n, 1_704_067_200 + n, 7, "view", value, '{"k": 6}') for n, value in ((0, 2.0), (1, 75.59), (2, 200.0))]
    e = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    e.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    r = duck.execute(ORACLES[key])
    names = [c[0] for c in r.description]
    want = [tuple(plain(x) for x in row) for row in r.fetchall()]
    got = [tuple(plain(x) for x in row) for row in QUERIES[key](spark, str(tmp_path)).select(*names).collect()]
    assert len(want) == 1 and got == want
