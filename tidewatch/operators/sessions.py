"""The idiom of the keyed detectors: split a key's events by gaps, run aggregates along each session, and keep the first row at which a condition holds. That row is the alert; the next can only come in a new session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

C = F.col
ORDER = ["t_us", "event_seq"]


def sessions(df: DataFrame, keys: list[str], gap_s: float | None) -> DataFrame:
    """df with `session`, counted from 0: an event more than the gap after its predecessor begins the next. Without a gap there is one session."""
    if gap_s is None:
        return df.withColumn("session", F.lit(0).cast("long"))
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    new = (C("t_us") - F.lag("t_us").over(w) > F.lit(int(gap_s * 1_000_000))).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def along(keys: list[str], first: int | None = None) -> WindowSpec:
    """Rows of the session up to now, or only so many before it."""
    return Window.partitionBy(*keys, "session").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding if first is None else -first, 0)


def running_distinct(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with n_<column>, the distinct values so far in the session: the first sight of each is flagged, and the flags are summed."""
    flagged = df
    for c in columns:
        sight = F.row_number().over(Window.partitionBy(*keys, "session", c).orderBy(*ORDER))
        flagged = flagged.withColumn(f"_{c}", (C(c).isNotNull() & (sight == 1)).cast("int"))
    return flagged.withColumns({f"n_{c}": F.sum(f"_{c}").over(along(keys)) for c in columns}).drop(*[f"_{c}" for c in columns])


def first_crossing(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """The first row of each session that meets the condition."""
    n = F.row_number().over(Window.partitionBy(*keys, "session").orderBy(*ORDER))
    return df.where(condition).withColumn("_n", n).where("_n = 1").drop("_n")
