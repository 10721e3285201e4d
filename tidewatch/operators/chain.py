"""The hash chain. Payload hashes and verification are parallel; the links of new entries are a fold in order, over one short row for each entry."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import scalars

C = F.col
GENESIS = "0" * 64
CHAIN_FIELDS = {"seq", "prev_hash", "payload_hash", "entry_hash"}


@F.pandas_udf(StringType())
def payload_hash(payload: pd.Series) -> pd.Series:
    """SHA-256 of the payload's canonical JSON, keys sorted at all levels, without the chain's own fields. Expressions can't sort the keys of open structures."""

    def one(text: str) -> str:
        d = {k: v for k, v in json.loads(text).items() if k not in CHAIN_FIELDS}
        return hashlib.sha256(json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    return payload.map(one, na_action="ignore")


def struct_hash(columns: list[str]) -> Column:
    """The same for flat columns, without Python: a struct in order of name, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def sealed(entries: DataFrame, start: int = 0, prev: str = GENESIS) -> DataFrame:
    """From rows (order, incident_id, last_observed, payload_hash): seq, prev_hash, entry_hash, chained after (start, prev).

    Each link needs the one before, so the rows pass through one task in order; what passes is four short texts an entry. Chains of several stores are sealed apart, by calling it for each.
    """
    ordered = entries.select("order", "incident_id", "last_observed", "payload_hash").repartition(1).sortWithinPartitions("order", "incident_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, last = start, prev
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                seq += 1
                entry = hashlib.sha256(f"{last}{seq}{r.incident_id}{r.last_observed}{r.payload_hash}".encode()).hexdigest()
                out.append((seq, r.incident_id, r.last_observed, r.payload_hash, last, entry))
                last = entry
            yield pd.DataFrame(out, columns=["seq", "incident_id", "last_observed", "payload_hash", "prev_hash", "entry_hash"])

    return ordered.mapInPandas(run, "seq long, incident_id string, last_observed string, payload_hash string, prev_hash string, entry_hash string")


def checked(chain: DataFrame, recomputed: Column | None = None) -> DataFrame:
    """chain with fault, the first check that an entry fails, or null: missing field, sequence, previous hash, payload, entry. `index` is the entry's place. recomputed: the payload's hash, where the payload is at hand.

    A window over the whole chain would be one task; an entry's predecessor is found by a join on its place instead.
    """
    placed = chain.withColumn("index", C("seq") - chain_start(chain)) if "index" not in chain.columns else chain
    before = placed.select((C("index") + 1).alias("index"), C("entry_hash").alias("_prev"), C("seq").alias("_seq"))
    j = placed.join(before, "index", "left")
    fields = ["seq", "incident_id", "last_observed", "payload_hash", "prev_hash", "entry_hash"]
    missing = F.coalesce(*[F.when(C(f).isNull(), F.lit(True)) for f in fields], F.lit(False))
    want = F.coalesce("_prev", F.lit(GENESIS))
    entry = scalars.entry_hash(C("prev_hash"), C("seq"), C("incident_id"), C("last_observed"), C("payload_hash"))
    fault = F.when(missing, "missing_field").when((C("seq") < 0) | (C("seq") <= C("_seq")), "sequence").when(C("prev_hash") != want, "prev_hash")
    if recomputed is not None:
        fault = fault.when(recomputed != C("payload_hash"), "payload")
    return j.withColumn("fault", fault.when(entry != C("entry_hash"), "entry_hash")).drop("_prev", "_seq")


def chain_start(chain: DataFrame) -> Column:
    """The smallest sequence number, as a literal: one small aggregate."""
    low = chain.agg(F.min("seq")).first()[0]
    return F.lit(low if low is not None else 0)


def verified(chain: DataFrame, recomputed: Column | None = None) -> DataFrame:
    """One row: valid, entries, and the first faulty entry's index and fault."""
    c = checked(chain, recomputed)
    return c.agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(C("fault").isNotNull(), F.struct("index", "fault"))).alias("f")).select(C("f").isNull().alias("valid"), "entries", C("f.index").alias("index"), C("f.fault").alias("fault"))


def latest(chain: DataFrame) -> DataFrame:
    """The last (seq, entry_hash), to resume from."""
    return chain.agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"))
