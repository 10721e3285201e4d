"""From alerts to incidents: keys, running state, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import ALERT_SCHEMA_VERSION, PS_CLASS, LifecycleConfig
from ..functions import alerts as fn
from ..functions import scalars
from ..schema import ALERT

C = F.col
KEY_COLUMNS = ("src_ip", "dst_ip", "dst_port", "amplifier_port", "registered_domain", "ja3")


def keyed(df: DataFrame) -> DataFrame:
    """ps_class, dedup_key, incident_id of alerts that lack them, from the detector and whatever key columns there are."""
    classes = F.create_map(*[F.lit(x) for kv in PS_CLASS.items() for x in kv])
    ps = F.coalesce(C("ps_class"), F.try_element_at(classes, C("detector"))) if "ps_class" in df.columns else F.try_element_at(classes, C("detector"))
    parts = {n: C(n) for n in KEY_COLUMNS if n in df.columns}
    d = df.withColumn("ps_class", ps)
    key = fn.dedup_key(C("detector"), C("ps_class"), parts)
    d = d.withColumn("dedup_key", F.coalesce(C("dedup_key"), key) if "dedup_key" in df.columns else key)
    own = scalars.identifier(C("dedup_key"))
    return d.withColumn("incident_id", F.coalesce(C("incident_id"), own) if "incident_id" in df.columns else own)


def contract(df: DataFrame) -> DataFrame:
    """Keyed and scored alerts as rows of schema.ALERT, with their flow reference. What an alert lacks is null; a status or count that is missing is NEW and 1, first and last sight are the alert's time."""
    parts = {n: C(n) for n in KEY_COLUMNS if n in df.columns}
    d = df.withColumns(fn.flow_reference(C("detector"), C("dedup_key"), parts)).withColumn("schema_version", F.lit(ALERT_SCHEMA_VERSION))
    if "evidence_json" in df.columns:
        d = d.withColumn("evidence", C("evidence_json"))
    fallback = {"status": F.lit("NEW"), "event_count": F.lit(1), "first_us": C("t_us"), "last_us": C("t_us")}
    out = []
    for column in StructType.fromDDL(ALERT):
        value = C(column.name) if column.name in d.columns else F.lit(None)
        out.append((F.coalesce(value, fallback[column.name]) if column.name in fallback else value).cast(column.dataType).alias(column.name))
    return d.select(*out)


def updates(df: DataFrame, cfg: LifecycleConfig = LifecycleConfig()) -> DataFrame:
    """One row per alert in its incident's order (t_us, event_seq): ordinal, status, running event_count, score, severity, confidence with its source, first and last seen, and the duration. Columns flows (array) and evidence (map), if there are any, are merged.

    The first alert is NEW, the second ACTIVE, later ones UPDATED. Score and severity keep their peak, confidence the newest of equal peaks; the last sighting only moves forward, and a newer value replaces an older one in the evidence.
    """
    by = Window.partitionBy("incident_id").orderBy("t_us", "event_seq", *[c for c in ("detector", "threat_class", "score") if c in df.columns])
    w = by.rowsBetween(Window.unboundedPreceding, 0)
    status = F.when(C("ordinal") == 1, "NEW").when(C("ordinal") == 2, "ACTIVE").otherwise("UPDATED")
    rank = fn.severity_rank(C("severity"))
    count = F.greatest(F.coalesce(F.nullif("event_count", F.lit(0)), F.lit(1)), F.lit(1)) if "event_count" in df.columns else F.lit(1)
    seen = C("last_us") if "last_us" in df.columns else C("t_us")
    first = C("first_us") if "first_us" in df.columns else C("t_us")
    d = df.withColumns({"ordinal": F.row_number().over(by), "_count": count, "_first": F.coalesce(first, C("t_us")), "_last": F.coalesce(seen, C("t_us"))})
    out = {
        "status": status, "event_count": F.sum("_count").over(w), "score": F.max("score").over(w), "severity": fn.severity_name(F.max(rank).over(w)), "first_observed_us": F.first("_first").over(w), "last_observed_us": F.max("_last").over(w),
    }
    if "confidence" in df.columns:
        peak = F.max(F.when(C("confidence").isNotNull(), F.struct("confidence", "ordinal", "calibrated_on"))).over(w)
        out |= {"confidence": peak["confidence"], "calibrated_on": peak["calibrated_on"]}
    d = d.withColumns(out)
    # What is merged over alerts is not gathered anew for each: first sights and missing keys are looked up.
    types = dict(df.dtypes)
    if "flows" in df.columns:
        seen_so_far = F.transform(F.filter("_sights", lambda x: x["at"]["ordinal"] <= C("ordinal")), lambda x: x["v"])
        d = looked_up(d, first_sights(d, "flows", cfg.max_flows), ["incident_id"]).withColumn("flows", F.coalesce(seen_so_far, F.array().cast(types["flows"]))).drop("_sights")
    if "evidence" in df.columns:
        none = F.create_map().cast(types["evidence"])
        older = F.coalesce("_older", none)
        own = F.map_filter(F.coalesce("evidence", none), lambda k, _: ~F.map_contains_key(older, k))
        d = looked_up(d, older_values(d), ["incident_id", "ordinal"]).withColumn("evidence", F.map_concat(own, older)).drop("_older")
    return d.withColumn("duration_s", F.greatest((C("last_observed_us") - C("first_observed_us")) / 1e6, F.lit(0.001))).drop("_count", "_first", "_last")


def looked_up(d: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Left join by keys that may be null. A plain one would also test the keys for null at the source, where their long expressions would be worked out once more."""
    renamed = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    return d.join(renamed, [C(k).eqNullSafe(C(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def first_sights(d: DataFrame, column: str, most: int) -> DataFrame:
    """incident_id and _sights, the first `most` distinct values of an array column in order of their first sight, as structs (at, v)."""
    v = d.select("incident_id", "ordinal", F.posexplode(column).alias("pos", "v"))
    sights = v.groupBy("incident_id", "v").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    n = F.row_number().over(Window.partitionBy("incident_id").orderBy("at"))
    return sights.withColumn("n", n).where(C("n") <= most).groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("_sights"))


def older_values(d: DataFrame) -> DataFrame:
    """incident_id, ordinal and _older, a map of the newest values so far of those evidence keys that some of the incident's alerts lack. Keys that all alerts have need no look back."""
    keys = F.coalesce(F.sort_array(F.map_keys("evidence")), F.array().cast("array<string>"))
    shapes = F.collect_set(keys).over(Window.partitionBy("incident_id"))  # a few for each detector
    lacking = F.filter(F.array_distinct(F.flatten("_shapes")), lambda k: F.exists("_shapes", lambda s: ~F.array_contains(s, k)))
    rows = d.select("incident_id", "ordinal", "evidence", shapes.alias("_shapes")).select("incident_id", "ordinal", "evidence", F.explode(lacking).alias("k"))
    held = F.when(F.map_contains_key("evidence", C("k")), F.struct(F.try_element_at("evidence", C("k")).alias("v")))
    upto = Window.partitionBy("incident_id", "k").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.select("incident_id", "ordinal", "k", F.last(held, ignorenulls=True).over(upto).alias("x")).where("x is not null")
    return last.groupBy("incident_id", "ordinal").agg(F.map_from_entries(F.collect_list(F.struct("k", C("x.v").alias("v")))).alias("_older"))


def incidents(updated: DataFrame) -> DataFrame:
    """The latest row of each incident."""
    n = F.row_number().over(Window.partitionBy("incident_id").orderBy(C("ordinal").desc()))
    return updated.withColumn("_n", n).where("_n = 1").drop("_n")


def resolved(df: DataFrame, as_of_us: int, cfg: LifecycleConfig = LifecycleConfig()) -> DataFrame:
    """Incidents with status RESOLVED where nothing was seen for resolve_s."""
    quiet = (C("status") != "RESOLVED") & (F.lit(as_of_us) - C("last_observed_us") >= int(cfg.resolve_s * 1_000_000))
    return df.withColumn("status", F.when(quiet, "RESOLVED").otherwise(C("status")))


def most_recent(df: DataFrame, keep: int) -> DataFrame:
    """The `keep` incidents that a bounded store holds: unresolved before resolved ones, then the last seen. A top-k, so no task holds them all."""
    return df.orderBy((C("status") == "RESOLVED").cast("int"), C("last_observed_us").desc(), "incident_id").limit(keep)
