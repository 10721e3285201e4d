"""Names, times, canonical forms and identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NOT_OBSERVABLE

# Protocol numbers with names, and TCP flag letters by bit.
PROTOCOLS = {"1": "ICMP", "6": "TCP", "17": "UDP", "58": "ICMPv6"}
FLAG_LETTERS = "FSRPAUEC"


def any_of(values) -> Column:
    """An array literal."""
    return F.array(*map(F.lit, values))


def rounded(x: Column, digits: int) -> Column:
    """A double to so many places as SQL's round has it: a half is looked for in the scaled number (137.795 * 100 is below one), where F.round looks in the shortest decimal text."""
    scale = F.lit(10.0**digits)
    return F.round(x * scale) / scale


def protocol_name(p: Column) -> Column:
    """A number's short name (or its digits), or a name in capitals; null for an empty one."""
    text = F.upper(F.nullif(F.trim(p.cast("string")), F.lit("")))
    return F.coalesce(*[F.when(text == k, F.lit(v)) for k, v in PROTOCOLS.items()], text)


def tcp_flag_letters(flags: Column) -> Column:
    """Letters of the set bits, - for none, null for null."""
    letters = F.concat(*[F.when(F.expr(f"{1 << k}").bitwiseAND(flags) > 0, c).otherwise("") for k, c in enumerate(FLAG_LETTERS)])
    return F.when(flags.isNotNull(), F.when(letters == "", "-").otherwise(letters))


def iso8601(t_us: Column) -> Column:
    """Microseconds as 2026-03-12T01:46:45.000000+00:00."""
    return F.concat(F.date_format(F.timestamp_micros(t_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def parse_ts(text: Column) -> Column:
    """ISO 8601 (with Z, an offset, or neither: UTC) or epoch seconds, as microseconds; null for anything else."""
    number = text.try_cast("double")
    moment = F.unix_micros(F.replace(text, F.lit("Z"), F.lit("+00:00")).try_cast("timestamp"))
    return F.when(number.isNotNull(), F.round(number * 1_000_000).cast("long")).otherwise(moment)


def display_us(t_us: Column, origin_us: int, start_us: int, speed: float) -> Column:
    """The replay clock: the capture's time rebased to when the replay started, at a speed above 0."""
    if speed <= 0:
        raise ValueError("speed must be above 0")
    return (F.lit(start_us) + (t_us - origin_us) / F.lit(float(speed))).cast("long")


def part(c: Column) -> Column:
    """A key part: the sentinel for null or empty."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(NOT_OBSERVABLE))


def json_text(c: Column) -> Column:
    """A JSON string, non-ASCII kept."""
    whole = F.to_json(F.struct(c.cast("string").alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def canonical(strings_and_numbers: list[tuple[Column, bool]]) -> Column:
    """A JSON list without spaces, of (column, is it a number) parts; a missing part is the quoted sentinel."""
    missing = F.lit(f'"{NOT_OBSERVABLE}"')
    parts = [F.coalesce(F.nullif(c.cast("string"), F.lit("")), missing) if number else json_text(part(c)) for c, number in strings_and_numbers]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def identifier(text: Column) -> Column:
    """16 hex digits. A plain string is hashed as it is; lists go through canonical() first."""
    return F.substring(F.sha2(text, 256), 1, 16)


def flow_id(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column, protocol: Column) -> Column:
    """The identifier of a conversation, the same in both directions. Ends are put in order of their text, ports too."""
    a, b = F.struct(part(src_ip).alias("ip"), part(src_port).alias("port")), F.struct(part(dst_ip).alias("ip"), part(dst_port).alias("port"))
    first, second = F.least(a, b), F.greatest(a, b)
    pieces = []
    for end in (first, second):
        pieces += [json_text(end["ip"]), F.when(end["port"] == NOT_OBSERVABLE, json_text(end["port"])).otherwise(end["port"])]
    return identifier(F.concat(F.lit("["), F.concat_ws(",", *pieces, json_text(part(protocol_name(protocol)))), F.lit("]")))


def hash_bucket(key: Column, buckets: int) -> Column:
    """The first 32 bits of the key's SHA-256, modulo."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % buckets


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(q / (1 - q))


def entry_hash(prev: Column, seq: Column, incident_id: Column, last_observed: Column, payload_hash: Column) -> Column:
    return F.sha2(F.concat(prev, seq.cast("string"), incident_id, last_observed, payload_hash), 256)
