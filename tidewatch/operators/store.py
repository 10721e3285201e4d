"""The incident store as tables: an append-only ledger, its snapshot, key-value metadata, queries and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

C = F.col


def snapshot(ledger: DataFrame) -> DataFrame:
    """The upserted state: each incident's latest row by seq, with created_at, first_observed, dedup_key and classes of its first."""
    w = Window.partitionBy("incident_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = [c for c in ("created_at", "first_observed", "dedup_key", "ps_class", "threat_class", "detector") if c in ledger.columns]
    firsts = ledger.withColumns({c: F.first(c).over(w) for c in kept})
    n = F.row_number().over(Window.partitionBy("incident_id").orderBy(C("seq").desc()))
    return firsts.withColumn("_n", n).where("_n = 1").drop("_n")


def append(ledger: DataFrame, path: str) -> None:
    """Append updates as Parquet, partitioned by day; a batch of one day touches one folder."""
    ledger.withColumn("day", F.to_date(F.timestamp_micros("last_us"))).write.mode("append").partitionBy("day").parquet(path)


def metadata_latest(writes: DataFrame) -> DataFrame:
    """Last write wins: key, value."""
    return writes.groupBy("key").agg(F.max_by("value", F.struct("updated_at", "seq")).alias("value"))


def incidents_page(snap: DataFrame, status: str | None = None, ps_class: str | None = None, severity: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of incidents, newest first. The limit is clamped to 1..1000 and the offset to 0 or more; the sort is a top-k."""
    for name, want in (("status", status), ("ps_class", ps_class), ("severity", severity)):
        if want:
            snap = snap.where(C(name) == want)
    return snap.orderBy(C("last_observed").desc(), C("seq").desc()).offset(max(0, offset)).limit(max(1, min(1000, limit)))


def history(ledger: DataFrame, incident_id: str) -> DataFrame:
    return ledger.where(C("incident_id") == incident_id).orderBy("seq")


def export_json(ledger: DataFrame) -> DataFrame:
    """The whole chain as JSON lines in order of seq."""
    return ledger.select("seq", F.to_json(F.struct("*")).alias("json")).orderBy("seq")


def opened(entries: Column) -> Column:
    """Entries (key, value, object) with every object replaced by its own entries, one level down, under dotted keys. An empty object has none."""
    return F.flatten(F.transform(entries, lambda e: F.when(e["object"], entries_of(e["value"], F.concat(e["key"], F.lit(".")))).otherwise(F.array(e))))


def entries_of(text: Column, prefix: Column) -> Column:
    """The entries of a JSON object: prefixed key, value as text (lists as compact JSON), and whether it is an object and not a text that looks like one."""
    kinds = F.parse_json(text).cast("map<string,variant>")
    return F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(F.concat(prefix, e["key"]).alias("key"), e["value"].alias("value"), F.coalesce(F.schema_of_variant(F.element_at(kinds, e["key"])).startswith("OBJECT"), F.lit(False)).alias("object")))


def flattened(df: DataFrame, column: str = "evidence", levels: int = 6) -> DataFrame:
    """df with flat, a map of dotted keys to texts, from a JSON column of any depth; of equal keys the last stands. So many levels are opened at once, and more as long as a row has one."""
    out = df.withColumn("_e", entries_of(C(column), F.lit("")))
    while True:
        e = C("_e")
        for _ in range(levels - 1):
            e = opened(e)
        out = out.withColumn("_e", e)
        if out.where(F.exists("_e", lambda x: x["object"])).isEmpty():
            latest = F.aggregate("_e", F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["key"]), F.create_map(x["key"], x["value"])))
            return out.withColumn("flat", latest).drop("_e")


def export_table(snap: DataFrame, columns: list[str], column: str = "evidence", most: int = 1000) -> DataFrame:
    """One row per incident with its columns and the sorted union of evidence keys; a missing value is an empty text. The keys are few, as detectors have fixed fields; more than `most` are refused, as a table can't have them as columns."""
    flat = flattened(snap, column)
    keys = sorted(r.k for r in flat.select(F.explode(F.map_keys("flat")).alias("k")).distinct().limit(most + 1).collect())
    if len(keys) > most:
        raise ValueError(f"{column} has over {most} keys")
    value = lambda k: F.coalesce(F.try_element_at("flat", F.lit(k)), F.lit(""))
    return flat.select(*columns, *[value(k).alias(f"{column}.{k}") for k in keys])


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(path)


def merged_ring(held: DataFrame, incoming: DataFrame, keep: int = 500) -> DataFrame:
    """The list view's buffer: incoming rows win by id, newest first, the top `keep`."""
    both = held.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("incident_id").orderBy(C("_in").desc(), C("seq").desc()))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_in").orderBy(C("last_observed").desc(), C("seq").desc()).limit(keep)


def health(snap: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: incidents and updates."""
    return snap.agg(F.count(F.lit(1)).alias("incidents")).join(ledger.agg(F.count(F.lit(1)).alias("updates")), how="cross")


def severity_counts(snap: DataFrame) -> DataFrame:
    """severity, n for every severity, zeros too."""
    from ..config import SEVERITIES

    counts = snap.agg(*[F.coalesce(F.sum((C("severity") == s).cast("int")), F.lit(0)).cast("long").alias(s) for s in SEVERITIES])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), C(s).alias("n")) for s in SEVERITIES])).alias("x")).select("x.severity", "x.n")


def class_breakdown(snap: DataFrame) -> DataFrame:
    return snap.groupBy("ps_class").agg(F.count(F.lit(1)).alias("n"))


def placed(df: DataFrame, *by: str) -> DataFrame:
    """Every row of df with its place (from 1) in the order of `by`, which has to be total: sorted by ranges, with the counts of the ranges before as offsets. The ranges come from a sample, so they are written once, and counted and numbered as written."""
    ranged = df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    at = scratch.path(df.sparkSession, "placed")
    ranged.write.parquet(at)
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(at)
    before, starts = 0, []
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():
        starts.append((r[0], before))
        before += r[1]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return ranged.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")
