"""Exact dedup: group by a 128-bit content hash, keep the row with the longest original text (then the smallest id), and compare the bytes inside the groups.

DataFrame functions only. Three passes, none of which shuffles the text of a document that has no copy:

1. every row's hash, sizes and digest are written as a narrow table;
2. a count per hash finds the groups with more than one row;
3. the normalised texts of these groups' members alone meet the text of their group's first row and are compared. Members of one hash with other bytes (a collision) form groups by the text itself.

A hot group is dealt over as many salts as its size asks for, in pass 3; everywhere else counts are combined before they are shuffled, and the joins onto one row per group are split by the adaptive skew join.

Defined results: a null text counts as empty, and all empty or all-white texts form one group. Rows that share an id and a text all carry kept = true if the id is kept. Ids can be of any type that can be ordered. A null id is a row like any other, and is kept only where its group has no row with an id and as long a text. An empty table gives an empty result. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, SPACES, checked_broadcast, numbered, settle, whole

#: Rows of one group that a task compares at a time.
ROWS_PER_SALT = 512
#: Up to so many groups with copies (16 bytes of hash and two numbers each) are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 500_000


def squeezed(text: Column) -> Column:
    """The text without ASCII white space."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def content_hash(normal: Column) -> Column:
    return F.unhex(F.md5(normal))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=content_hash) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. hash_fn gives the group hash of a normalised text (tests put in a weak one)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("t")).select("doc_id", F.length("t").alias("n"), squeezed(F.col("t")).alias("normal"))
    keys = settle(rows.select("doc_id", "n", hash_fn(F.col("normal")).alias("h"), F.sha2("normal", 256).alias("text_sha256")))
    groups = settle(keys.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first_id")).where("size > 1"))
    groups_b = checked_broadcast(groups, BROADCAST_GROUPS)

    members = rows.withColumn("h", hash_fn(F.col("normal"))).join(groups_b, "h").select("doc_id", "h", "normal", "size", "first_id", F.ceil(F.col("size") / ROWS_PER_SALT).cast("int").alias("salts"))
    # Every salt of a group gets the first row's text. Of several rows with that id one is taken.
    first = (
        members.where("doc_id <=> first_id").groupBy("h").agg(F.first("normal").alias("first_normal"), F.max("salts").alias("salts"))
        .select("h", "first_normal", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    )
    odd = settle(
        members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), "salts").cast("int")).join(first, ["h", "salt"])
        .where("normal <> first_normal").select("doc_id", "h", "normal").distinct()
    )
    odd_b = checked_broadcast(odd.select(F.col("doc_id").alias("odd_id"), F.col("h").alias("odd_h"), F.col("normal").alias("odd_normal")), 1000)

    told = keys.join(F.broadcast(groups.select("h")) if groups_b is not groups else groups.select("h"), "h", "left_semi")
    told = told.join(odd_b, (F.col("h") == F.col("odd_h")) & F.col("doc_id").eqNullSafe(F.col("odd_id")), "left").select("h", F.coalesce("odd_normal", F.lit("")).alias("other"), "doc_id", "n")
    best = settle(told.groupBy("h", "other").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("top")).select("h", "other", "size", F.col("top.doc_id").alias("best_id")))
    best_b = checked_broadcast(best, BROADCAST_GROUPS)

    out = keys.join(odd_b, (F.col("h") == F.col("odd_h")) & F.col("doc_id").eqNullSafe(F.col("odd_id")), "left").withColumn("other", F.coalesce("odd_normal", F.lit(""))).drop("odd_id", "odd_h", "odd_normal")
    out = out.join(best_b, ["h", "other"], "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of every group of equal texts: the one that exact_groups() keeps, the first of several with its id. Rows, not ids, are dropped, so a text that shares its id with a copy of another one stays."""
    rows, row_id, text = numbered(docs, id_col, text_col)
    keys = rows.select(F.struct(row_id.isNull().alias("none"), row_id.alias("id"), "row").alias("key"), F.col(text).alias("t"))
    gone = settle(exact_groups(keys, "key", "t").where("not kept").select("doc_id.row"))
    return rows.join(checked_broadcast(gone, BROADCAST_IDS), "row", "left_anti").drop("row").toDF(*docs.columns)
