"""Alerts against labelled ground truth, and reports on scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AddressPlan, C2Config, ScanConfig
from . import filters
from .detectors import c2_measures
from .ordered import quantile_bucket, sums_before
from .sessions import ORDER, running_distinct, sessions

C = F.col


def ratio(a: Column, b: Column, digits: int = 3) -> Column:
    """Rounded; null for an empty denominator."""
    return F.when(b > 0, F.round(a / b, digits))


def per_class(attributed: DataFrame, labels: DataFrame, hours: float) -> DataFrame:
    """letter, attacks, detected, recall, alerts, true, overlap and false alerts, precision, false incidents (and an hour), from attributed alerts (letter, attack_id, attack_letter, incident_id)."""
    n = labels.groupBy("letter").agg(F.count_distinct("attack_id").alias("attacks"))
    found = attributed.where(C("attack_letter") == C("letter")).groupBy("letter").agg(F.count_distinct("attack_id").alias("detected"))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    a = attributed.groupBy("letter").agg(
        F.count(F.lit(1)).alias("alerts"), count(C("attack_letter") == C("letter")).alias("true_alerts"), count(C("attack_letter") != C("letter")).alias("overlap_alerts"), count(C("attack_id").isNull()).alias("false_alerts"),
        F.count_distinct(F.when(C("attack_id").isNull(), C("incident_id"))).alias("false_incidents"),
    )
    j = n.join(found, "letter", "left").join(a, "letter", "full").fillna(0)
    return j.withColumns({"recall": ratio(C("detected"), C("attacks")), "precision": ratio(C("true_alerts"), C("true_alerts") + C("false_alerts")), "false_incidents_h": F.round(C("false_incidents") / F.lit(hours), 3)})


def per_attack(attributed: DataFrame) -> DataFrame:
    """attack_id, detector, alerts."""
    return attributed.where(C("attack_id").isNotNull()).groupBy("attack_id", "detector").agg(F.count(F.lit(1)).alias("alerts"))


def overlap_matrix(attributed: DataFrame) -> DataFrame:
    """Alert class by attack class, counts in columns a to f."""
    return attributed.where(C("attack_letter").isNotNull()).groupBy("letter").pivot("attack_letter", list("abcdef")).count().fillna(0)


def false_alerts(attributed: DataFrame, hours: float) -> DataFrame:
    """letter, detector, n, per_hour of alerts that no label explains, with totals by letter (detector null) and of all (both null)."""
    f = attributed.where(C("attack_id").isNull())
    return f.rollup("letter", "detector").agg(F.count(F.lit(1)).alias("n")).withColumn("per_hour", F.round(C("n") / F.lit(hours), 3))


def class_report(pairs: DataFrame) -> DataFrame:
    """From rows (truth, predicted): class, tp, fp, fn, precision, recall, f1, support; 0 on empty denominators."""
    both = F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("class")
    e = pairs.groupBy("truth", "predicted").count().select("*", both)
    s = lambda c: F.sum(F.when(c, C("count")).otherwise(0))
    t, p = C("truth") == C("class"), C("predicted") == C("class")
    r = e.groupBy("class").agg(s(t & p).alias("tp"), s(~t & p).alias("fp"), s(t & ~p).alias("fn"), s(t).alias("support"))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    r = r.withColumns({"precision": zero(C("tp"), C("tp") + C("fp")), "recall": zero(C("tp"), C("tp") + C("fn"))})
    f1 = zero(2 * C("precision") * C("recall"), C("precision") + C("recall"))
    return r.select("class", "tp", "fp", "fn", "support", *[F.round(c, 4).alias(n) for n, c in (("precision", C("precision")), ("recall", C("recall")), ("f1", f1))])


def reliability(pairs: DataFrame, bins: int = 5) -> DataFrame:
    """From rows (p, y): bin, n, mean_p, observed."""
    b = F.least(F.floor(C("p") * bins), F.lit(bins - 1)).cast("int")
    return pairs.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 4).alias("mean_p"), F.round(F.avg("y"), 4).alias("observed"))


def brier(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((C("p") - C("y")) * (C("p") - C("y"))).alias("brier"))


def roc_auc(pairs: DataFrame) -> DataFrame:
    """The area from counts of each distinct score: equal scores share their rank. Distinct scores are summed in order by buckets of quantiles."""
    by = pairs.groupBy("p").agg(F.sum(C("y").cast("long")).alias("pos"), F.sum(1 - C("y")).cast("long").alias("neg"))
    by = sums_before(quantile_bucket(by, "p"), "p", C("_bucket"), ["neg"])
    t = by.agg(F.sum(C("pos") * (C("neg_before") + C("neg") / 2)).alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return t.select(F.when((C("pos") > 0) & (C("neg") > 0), C("wins") / (C("pos") * C("neg"))).alias("auc"))


def brier_by_detector(df: DataFrame) -> DataFrame:
    """From rows (detector, confidence, truth 0 or 1, calibrated_on): n, positives, brier, mean confidence, sources."""
    off = C("confidence") - C("truth")
    return df.groupBy("detector").agg(F.count(F.lit(1)).alias("n"), F.sum("truth").alias("positives"), F.round(F.avg(off * off), 4).alias("brier"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.array_join(F.sort_array(F.collect_set("calibrated_on")), ",").alias("sources"))


def latency_percentiles(df: DataFrame, value: str) -> DataFrame:
    """p50, p95, p99 (the round(q n)-th smallest) and max: distinct values are counted first and summed in order by buckets of quantiles, so no task sorts all rows or values."""
    rows = df.where(C(value).isNotNull())
    by = rows.groupBy(C(value).alias("v")).agg(F.count(F.lit(1)).alias("count"))
    total = rows.agg(F.count(F.lit(1)).alias("n"))  # one row
    c = sums_before(quantile_bucket(by, "v"), "v", C("_bucket"), ["count"]).join(F.broadcast(total), how="cross")
    at = lambda q: F.min(F.when(C("count_before") + C("count") >= F.greatest(F.round(F.lit(q) * C("n")), F.lit(1)), C("v")))
    return c.agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("v").alias("max"))


def fold_of(df: DataFrame, holdout_family: str, holdout_entity: str, cutoff_us: int) -> DataFrame:
    """df (family, entity, t_us) with fold: family before entity before time, else train."""
    return df.withColumn("fold", F.when(C("family") == holdout_family, "family_holdout").when(C("entity") == holdout_entity, "entity_holdout").when(C("t_us") >= cutoff_us, "time_holdout").otherwise("train"))


def grouped_split(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """df with bucket: all rows of a key are on the same side."""
    from ..functions.scalars import hash_bucket

    return df.withColumn("bucket", hash_bucket(C(key), folds))


def leave_one_out(df: DataFrame, column: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """By value of a column with few values: (the rest, its rows)."""
    values = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]
    return {v: (df.where(C(column) != v), df.where(C(column) == v)) for v in values}


def earliest_by_domain(df: DataFrame) -> DataFrame:
    """The earliest (t_us, qname) of every canonical domain."""
    n = F.row_number().over(Window.partitionBy("domain").orderBy("t_us", "qname"))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def newly(settings: Column, now: Callable[[Column], Column], before: Callable[[Column], Column]) -> Column:
    """The settings that a session's measures meet here and did not meet a row before. Along a session the measures only go one way, so each setting comes up once: at its first crossing."""
    return F.explode(F.filter(settings, lambda x: now(x) & ~F.coalesce(before(x), F.lit(False))))


def scan_sweep(events: DataFrame, grid: list[tuple[int, int]], cfg: ScanConfig = ScanConfig(), plan: AddressPlan = AddressPlan()) -> DataFrame:
    """hosts, ports, src_ip, t_us, event_seq, score: the scan detector's alerts under every pair of thresholds (min_hosts, min_ports), from one pass over the events."""
    s = running_distinct(sessions(filters.scan_input(events, plan), ["src_ip"], cfg.gap_s), ["src_ip"], ["dst_ip", "dst_port"])
    by = Window.partitionBy("src_ip", "session").orderBy(*ORDER)
    s = s.withColumns({"_h": F.lag("n_dst_ip").over(by), "_p": F.lag("n_dst_port").over(by)})
    settings = F.array(*[F.struct(F.lit(h).alias("hosts"), F.lit(p).alias("ports")) for h, p in grid])
    met = lambda h, p: lambda x: (C(h) >= x["hosts"]) | (C(p) >= x["ports"])
    hit = s.select("src_ip", *ORDER, "n_dst_ip", "n_dst_port", newly(settings, met("n_dst_ip", "n_dst_port"), met("_h", "_p")).alias("x"))
    return hit.select("x.*", "src_ip", *ORDER, F.greatest(C("n_dst_ip") / C("x.hosts"), C("n_dst_port") / C("x.ports")).alias("score"))


def c2_sweep(events: DataFrame, max_cvs: list[float], cfg: C2Config = C2Config()) -> DataFrame:
    """max_cv, the conversation's keys, t_us, event_seq, iat_cv: the beacon detector's alerts under every limit of variation, from one pass over the events. The least variation so far only falls."""
    keys = list(cfg.key)
    _, candidates = c2_measures(events, cfg)
    by = Window.partitionBy(*keys, "session").orderBy(*ORDER)
    least = F.min("iat_cv").over(by.rowsBetween(Window.unboundedPreceding, 0))
    s = candidates.withColumn("iat_cv", C("iat_std") / C("iat_mean")).withColumn("_least", least).withColumn("_before", F.lag("_least").over(by))
    met = lambda c: lambda x: C(c) <= x
    return s.select(newly(F.array(*[F.lit(float(c)) for c in max_cvs]), met("_least"), met("_before")).alias("max_cv"), *keys, *ORDER, "iat_cv")
