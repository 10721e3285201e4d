"""The lookups as joins: semi, anti, as-of, best match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALLOWLIST, BAD_JA3, CLASS_LETTER, AddressPlan
from ..functions import alerts, domains

C = F.col


def known_bad_ja3(sessions: DataFrame) -> DataFrame:
    """Left semi join of a JA3 on a fixed list, which is small enough to stand in the plan."""
    return sessions.where(F.lower("ja3").isin(*BAD_JA3))


def known_bad(sessions: DataFrame, listed: DataFrame) -> DataFrame:
    """The same with a list (ja3) of any size; Spark broadcasts it if it is small."""
    return sessions.join(listed.select(F.lower("ja3").alias("_bad")).distinct(), F.lower("ja3") == C("_bad"), "left_semi")


def not_allowlisted(dns: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Left anti join of the name and its registered domain on the allowlist, fixed or given (domain)."""
    if allowed is None:
        return dns.where(~domains.is_allowlisted(C("qname")))
    a = allowed.select(F.lower("domain").alias("_d")).distinct()
    return dns.join(a, domains.cleaned(C("qname")) == C("_d"), "left_anti").join(a, domains.two_labels(C("qname")) == C("_d"), "left_anti")


def from_or_to_resolver(events: DataFrame, plan: AddressPlan = AddressPlan()) -> DataFrame:
    return events.where(C("src_ip").isin(*plan.resolvers) | C("dst_ip").isin(*plan.resolvers))


def previous_sighting(events: DataFrame, baseline: DataFrame | None = None, slice_s: float = 60.0) -> DataFrame:
    """events (fingerprint, t_us, event_seq) with last_us, the latest earlier sighting in the stream or the baseline (fingerprint, last_us). A fingerprint is looked at by slices of time, so a popular one is as many groups as it has slices; a slice's first event meets the last one of the slice before."""
    sliced = events.withColumn("_slice", F.floor(C("t_us") / int(slice_s * 1_000_000)))
    own = Window.partitionBy("fingerprint", "_slice").orderBy("t_us", "event_seq")
    ends = sliced.groupBy("fingerprint", "_slice").agg(F.max("t_us").alias("_end")).withColumn("_before", F.lag("_end").over(Window.partitionBy("fingerprint").orderBy("_slice"))).drop("_end")
    seen = sliced.withColumn("_lag", F.lag("t_us").over(own)).join(ends, ["fingerprint", "_slice"], "left")
    seen = seen.withColumn("last_us", F.coalesce("_lag", "_before"))
    if baseline is not None:
        seen = seen.join(baseline.select("fingerprint", C("last_us").alias("_b")), "fingerprint", "left").withColumn("last_us", F.greatest("last_us", "_b"))
    return seen.select(*events.columns, "last_us")


def latest_template(data: DataFrame, templates: DataFrame, idle_s: float = 1800.0) -> DataFrame:
    """data sets (exporter, domain, template_id, t_us, event_seq) with the version of the latest template registered at or before them, at most idle_s old; null where there is none. One sorted pass over both sides."""
    key = ["exporter", "domain", "template_id"]
    t = templates.select(*key, "t_us", "event_seq", F.struct("version", C("t_us").alias("at")).alias("_t"))
    both = data.withColumn("_t", F.lit(None).cast(t.schema["_t"].dataType)).unionByName(t, allowMissingColumns=True)
    last = F.last("_t", ignorenulls=True).over(Window.partitionBy(*key).orderBy("t_us", "event_seq").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_l", last).where(C("_t").isNull())
    fresh = C("t_us") - C("_l.at") <= int(idle_s * 1_000_000)
    return found.withColumn("version", F.when(fresh, C("_l.version"))).select(*data.columns, "version")


def with_letter(df: DataFrame) -> DataFrame:
    """The class's letter, inner: rows of unknown classes go."""
    pairs = F.create_map(*[F.lit(x) for kv in CLASS_LETTER.items() for x in kv])
    return df.withColumn("letter", F.try_element_at(pairs, C("ps_class"))).where(C("letter").isNotNull())


def with_confidence(df: DataFrame, table: DataFrame, z_reference: float) -> DataFrame:
    """Left join of each detector's calibration (detector, a, b), then confidence and its source."""
    j = df.join(table.select("detector", "a", "b"), "detector", "left")
    c = alerts.confidence_of(C("score"), C("score_type"), F.lit(z_reference), C("a"), C("b"))
    return j.withColumn("_c", c).withColumns({"confidence": C("_c.confidence"), "calibrated_on": C("_c.calibrated_on")}).drop("_c", "a", "b")


def updates_of(updates: DataFrame, incidents: DataFrame) -> DataFrame:
    """Updates whose incident exists."""
    return updates.join(incidents.select("incident_id").distinct(), "incident_id", "left_semi")


def history_or_nothing(updates: DataFrame, incidents: DataFrame, incident_id: str) -> DataFrame:
    """An incident's updates in order; no rows if it doesn't exist."""
    return updates_of(updates.where(C("incident_id") == incident_id), incidents.where(C("incident_id") == incident_id)).orderBy("seq")


def attributed(alerts_df: DataFrame, labels: DataFrame, early_s: float = 5.0, late_s: float = 120.0) -> DataFrame:
    """Alerts (alert_id, letter, ips, first_us, last_us) with the label (attack_id, letter, key_ips, t_start, t_end) they belong to: an address in common and overlapping in time, with some slack. Of several the last of the same class, else the first; nulls where none fits.

    The addresses are exploded to an equi-join, so that it is no nested loop over all pairs.
    """
    a = alerts_df.select("alert_id", C("letter").alias("a_letter"), "first_us", "last_us", F.explode("ips").alias("ip"))
    b = labels.select("attack_id", "letter", "t_start", "t_end", F.explode("key_ips").alias("ip"))
    fit = a.join(b, "ip").where((C("first_us") <= C("t_end") + int(late_s * 1e6)) & (C("last_us") >= C("t_start") - int(early_s * 1e6))).select("alert_id", "attack_id", "letter", "t_start", (C("letter") == C("a_letter")).alias("same")).distinct()
    same = F.max_by(F.struct("attack_id", C("letter").alias("attack_letter")), F.when(C("same"), F.struct("t_start", "attack_id")))
    first = F.min_by(F.struct("attack_id", C("letter").alias("attack_letter")), F.struct("t_start", "attack_id"))
    best = fit.groupBy("alert_id").agg(F.coalesce(same, first).alias("m")).select("alert_id", "m.attack_id", "m.attack_letter")
    return alerts_df.join(best, "alert_id", "left")
