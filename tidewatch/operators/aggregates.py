"""Windows, counters and distributions. Every grouped count is made in two levels, by value and then by group, so that a hot window or host is combined before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AddressPlan
from ..functions import features

C = F.col


def dense(df: DataFrame, keys: list[str], values: dict[str, list], fill: str) -> DataFrame:
    """df with a row for each group of keys and each listed value of one column; `fill` is 0 in the new ones. Groups are those that df has."""
    (name, wanted), = values.items()
    need = df.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, wanted))).alias(name))
    return df.join(need, [*keys, name], "full").fillna(0, [fill])


def qtype_shares(dns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, qtype, n, share: of upper-cased types, with TXT, NULL and CNAME always there."""
    typed = dns.select(*keys, F.upper("qtype").alias("qtype")).where("qtype is not null and qtype <> ''")
    n = dense(typed.groupBy(*keys, "qtype").agg(F.count(F.lit(1)).alias("n")), keys, {"qtype": ["TXT", "NULL", "CNAME"]}, "n")
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return n.select(*keys, "qtype", "n", (C("n") / total).alias("share"))


def dns_window(dns: DataFrame, keys: list[str]) -> DataFrame:
    """query_count, unique_qname_count, shares of TXT, NULL and CNAME, and the entropy of the types."""
    by_type = dns.groupBy(*keys, F.upper("qtype").alias("qtype")).agg(F.count(F.lit(1)).alias("n"))
    share = lambda t: F.coalesce(F.sum(F.when(C("qtype") == t, C("n"))) / F.sum(F.when(F.coalesce(C("qtype"), F.lit("")) != "", C("n"))), F.lit(0.0))
    known = F.when(F.coalesce(C("qtype"), F.lit("")) != "", C("n")).otherwise(0)
    counts = by_type.groupBy(*keys).agg(F.sum("n").alias("query_count"), share("TXT").alias("txt"), share("NULL").alias("null"), share("CNAME").alias("cname"), features.entropy_from_counts(known).alias("qtype_entropy"))
    names = dns.where("qname is not null and qname <> ''").select(*keys, "qname").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_qname_count"))
    return counts.join(names, keys, "left").fillna(0, ["unique_qname_count"])


def interarrival(df: DataFrame, keys: list[str]) -> DataFrame:
    """iat_median, iat_p95, iat_cv of the gaps, in seconds, between a key's events in order of time."""
    gap = (C("t_us") - F.lag("t_us").over(Window.partitionBy(*keys).orderBy("t_us", "event_seq"))) / 1e6
    g = df.select(*keys, gap.alias("gap"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.groupBy(*keys).agg(zero(F.percentile("gap", F.lit(0.5))).alias("iat_median"), zero(F.percentile("gap", F.lit(0.95))).alias("iat_p95"), features.cv_population(C("gap")).alias("iat_cv"))


def letters_counted(letter: str) -> Column:
    """Events whose flags have a letter; an event of that letter alone counts twice, as the contract's counters do."""
    flags = F.coalesce(C("tcp_flags_str"), F.lit(""))
    return F.sum(flags.contains(letter).cast("int") + (flags == letter).cast("int"))


def windows(df: DataFrame, width_s: float, plan: AddressPlan = AddressPlan()) -> DataFrame:
    """One row per tumbling window that has events: w_us, event_count, packets, bytes, protocol and direction counts, SYN and ACK counts, distinct and entropy of packet-weighted sources and targets, the top flow's share, balanced resolver packets, the top target and the pps and bps.

    Null packets count as one and null bytes as none. A window's values are first summed by the four dimensions, then in one pass for each: a flood in one window is spread over its rows' partial sums.
    """
    width = int(width_s * 1_000_000)
    rows = df.withColumns({"w_us": F.floor(C("t_us") / width) * width, "p": F.coalesce(C("packets"), F.lit(1)), "b": F.coalesce(C("bytes"), F.lit(0))})
    q = C("src_ip").isin(*plan.resolvers) & (C("dst_port") == 53)
    a = C("dst_ip").isin(*plan.resolvers) & (C("src_port") == 53) & ~F.coalesce(q, F.lit(False))
    s = lambda c: F.sum(F.when(c, C("p")).otherwise(0))
    one = rows.groupBy("w_us").agg(
        F.count(F.lit(1)).alias("event_count"), F.sum("p").alias("packets"), F.sum("b").alias("bytes"), *[F.sum((C("protocol") == n).cast("int")).alias(n.lower()) for n in ("TCP", "UDP", "ICMP")],
        *[F.sum((C("direction") == n).cast("int")).alias(n) for n in ("inbound", "outbound", "internal", "external")], letters_counted("S").alias("syn"), letters_counted("A").alias("ack"), (F.least(s(q), s(a)) * 2).alias("resolver_packets"),
    )

    def by(value: list[str], aggregates: list[Column]) -> DataFrame:
        named = rows.where(reduce(lambda x, y: x & y, [C(v).isNotNull() for v in value])) if len(value) == 1 else rows
        return named.groupBy("w_us", *value).agg(F.sum("p").alias("n"), F.min("event_seq").alias("first")).groupBy("w_us").agg(*aggregates)

    top = lambda v: F.max_by(v, F.struct("n", (-C("first")).alias("f")))
    parts = [
        by(["src_ip"], [features.entropy_from_counts(C("n")).alias("src_entropy"), F.count(F.lit(1)).alias("unique_src")]),
        by(["dst_ip"], [features.entropy_from_counts(C("n")).alias("dst_entropy"), F.count(F.lit(1)).alias("unique_dst"), top("dst_ip").alias("top_dst_ip")]),
        by(["dst_port"], [F.count(F.lit(1)).alias("unique_dst_ports"), top("dst_port").alias("top_dst_port")]),
        by(["src_ip", "dst_ip", "src_port", "dst_port", "protocol"], [(F.max("n") / F.sum("n")).alias("top_flow_share")]),
    ]
    out = reduce(lambda x, y: x.join(y, "w_us", "left"), parts, one)
    return out.withColumns({"pps": C("packets") / F.lit(float(width_s)), "bps": C("bytes") * 8 / F.lit(float(width_s)), "syn_ack_ratio": F.when(C("ack") > 0, C("syn") / C("ack")).otherwise(C("syn").cast("double"))})


def window_samples(df: DataFrame, width_s: float, columns: list[str], most: int = 8) -> DataFrame:
    """w_us, n and samples: `most` events of each window, by the least hashes of their numbers, so that any merge of parts has the same ones. A task sends so many rows of a window at the most, as the limit on the rank is applied before the shuffle too."""
    width = int(width_s * 1_000_000)
    rows = df.select((F.floor(C("t_us") / width) * width).alias("w_us"), F.md5(C("event_seq").cast("string")).alias("_h"), F.struct("event_seq", *columns).alias("event"))
    rank = F.row_number().over(Window.partitionBy("w_us").orderBy("_h", "event"))
    few = rows.withColumn("_n", rank).where(C("_n") <= most)
    return few.groupBy("w_us").agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("_h", "event"))), lambda x: x["event"]).alias("samples"))


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and a sorted map of value to events, made from one row for each value."""
    n = df.where(C(value).isNotNull()).groupBy(*keys, value).count()
    return n.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "count")))).alias("histogram"))


def packet_counter(df: DataFrame) -> DataFrame:
    """One row of totals: packets, bytes, span, rates, SYN without ACK, SYN with ACK, FIN, RST."""
    bit = lambda k: C("tcp_flags").bitwiseAND(F.lit(k)) > 0
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    span = (F.max("t_us") - F.min("t_us")) / 1e6
    one = df.agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"), span.alias("duration_s"), count(bit(2) & ~bit(16)).alias("syn"), count(bit(2) & bit(16)).alias("syn_ack"), count(bit(1)).alias("fin"), count(bit(4)).alias("rst"))
    rate = lambda c: F.when(C("duration_s") > 0, c / C("duration_s")).otherwise(0.0)
    return one.withColumns({"pps": rate(C("packets")), "bps": rate(C("bytes") * 8)})


def counted_by(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n for several columns in one pass; nulls are not counted."""
    sets = df.groupingSets([[C(d)] for d in dimensions], *dimensions).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*dimensions).alias("g"))
    last = len(dimensions) - 1
    name = F.coalesce(*[F.when(C("g") == ((1 << len(dimensions)) - 1 - (1 << (last - k))), d) for k, d in enumerate(dimensions)])
    return sets.select(name.alias("dimension"), F.coalesce(*[C(d).cast("string") for d in dimensions]).alias("value"), "n").where("value is not null")


def capture_loss(df: DataFrame) -> DataFrame:
    """From rows (read, parsed, truncated, malformed, kernel_drops, ring_drops): observed loss and truncation in percent; without sensor counters the loss is a lower bound."""
    pct = lambda c, of: F.when(of > 0, c * 100.0 / of).otherwise(0.0)
    t = df.agg(*[F.sum(c).alias(c) for c in ("read", "parsed", "truncated", "malformed", "kernel_drops", "ring_drops")])
    drops = F.coalesce(C("kernel_drops"), F.lit(0)) + F.coalesce(C("ring_drops"), F.lit(0))
    known = C("kernel_drops").isNotNull() | C("ring_drops").isNotNull()
    return t.select("*", pct(C("read") - C("parsed"), C("read")).alias("parse_loss_pct"), pct(C("truncated"), C("read")).alias("truncated_pct"), F.when(known, pct(drops, C("read") + drops)).alias("sensor_drop_pct"), pct(C("read") - C("parsed") + drops, C("read") + drops).alias("observed_loss_pct"), (~known).alias("is_lower_bound"))


def flow_table(df: DataFrame, idle_s: float = 300.0, lifetime_s: float = 3600.0, keys: tuple[str, ...] = ("flow_id",)) -> DataFrame:
    """Two-way flows, split by idle gaps over idle_s and then by lifetime_s since the part's first packet: packets and bytes of the initiator's and the other side, flags, state.

    The first packet's sender is the initiator. A reset wins over an end within a packet, and the last flagged packet decides; a second packet makes a flow active.
    """
    from .sessions import sessions

    s = sessions(df, list(keys), idle_s)
    first = F.min("t_us").over(Window.partitionBy(*keys, "session"))
    s = s.withColumn("slice", F.floor((C("t_us") - first) / int(lifetime_s * 1_000_000)))
    own = [*keys, "session", "slice"]
    w = Window.partitionBy(*own).orderBy("t_us", "event_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("initiator", F.first(F.struct("src_ip", "src_port")).over(w))
    fwd = F.struct("src_ip", "src_port").eqNullSafe(C("initiator"))
    flags = F.coalesce(C("tcp_flags"), F.lit(0))
    end = F.when(flags.bitwiseAND(F.lit(4)) > 0, "RESET").when(flags.bitwiseAND(F.lit(1)) > 0, "CLOSING")
    p, b = F.coalesce(C("packets"), F.lit(1)), F.coalesce(C("bytes"), F.lit(0))
    g = s.groupBy(*own).agg(
        F.first("initiator").alias("initiator"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count(F.lit(1)).alias("events"), *[F.sum(F.when(side, v).otherwise(0)).alias(n) for side, v, n in ((fwd, p, "fwd_packets"), (~fwd, p, "rev_packets"), (fwd, b, "fwd_bytes"), (~fwd, b, "rev_bytes"))],
        F.bit_or(flags).alias("flags"), F.max_by(end, F.when(end.isNotNull(), F.struct("t_us", "event_seq"))).alias("ended"),
    )
    return g.withColumns({"state": F.coalesce("ended", F.when(C("events") > 1, "ACTIVE").otherwise("NEW")), "duration_s": (C("last_us") - C("first_us")) / 1e6}).drop("ended")


def running_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every event with its flow's running packets and bytes."""
    w = Window.partitionBy(*keys).orderBy("t_us", "event_seq").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"run_packets": F.sum(F.coalesce(C("packets"), F.lit(1))).over(w), "run_bytes": F.sum(F.coalesce(C("bytes"), F.lit(0))).over(w)})


def median_and_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median and mad of a column, 0 where there is none."""
    m = df.groupBy(*keys).agg(F.median(value).alias("median"))
    far = df.join(m, keys).groupBy(*keys).agg(F.first("median").alias("median"), F.median(F.abs(C(value) - C("median"))).alias("mad"))
    return far.fillna(0.0, ["median", "mad"])


def learned_fingerprints(df: DataFrame) -> DataFrame:
    """kind, fingerprint (lower case), last seen."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(k).alias("fingerprint")) for k in ("ja3", "ja4")])
    e = df.select("t_us", F.explode(kinds).alias("s")).select("t_us", "s.kind", "s.fingerprint").where("fingerprint is not null and fingerprint <> ''")
    return e.groupBy("kind", "fingerprint").agg(F.max("t_us").alias("last_us"))


def top_target(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the value with the most packets; of equal ones the first seen."""
    n = df.groupBy(*keys, value).agg(F.sum(F.coalesce(C("packets"), F.lit(1))).alias("n"), F.min("event_seq").alias("first"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", (-C("first")).alias("f"))).alias("top"), F.max("n").alias("n"))
