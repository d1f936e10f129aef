"""Exact dedup with DataFrame functions only.

Rows group by the 128-bit MD5 of their text, lower-cased in A-Z only.  The
group table (hash, count, id to keep) is pre-aggregated map-side, so a group
that holds a third of all rows arrives as one small row per task.  Bytes of the
members of groups of two or more are then compared with those of the row that
stays; a row whose bytes differ is a hash collision, and the groups concerned
are formed anew by their bytes.

Null, empty and repeated rows: a null text counts as empty; all empty texts are
equal.  Null ids never win over others; in a group with null ids only, keep_id is
null and every row is kept.  Rows that repeat both id and text count in
group_size and get the same decision.  An empty table gives an empty result.
Columns besides the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, read_table, text_of


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    hash_of: Callable[[Column], Column] = md5_bytes,
) -> DataFrame:
    """One row per input row: <id>, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max" id of each group stays.  hash_of is a parameter so that
    tests can force collisions.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(text_of(text_col)).alias("_text")).withColumn("_hash", hash_of(F.col("_text")))
    sha = F.unhex(F.sha2(F.col("_text").cast("binary"), 256))
    # what is said of every row without its text: texts are read again for the comparison of bytes alone
    sums = cut(rows.select("_id", "_hash", sha.alias("_sha")), "exact-sums")

    # Joins below take groups from a written table: with a plain exchange on both
    # sides, adaptive execution can split the partition of a hot hash.
    groups = cut(sums.groupBy("_hash").agg(F.count(F.lit(1)).alias("group_size"), best("_id").alias("keep_id")), "exact-groups")
    many = groups.filter("group_size > 1").select("_hash", "keep_id")
    members = cut(rows.join(many, "_hash"), "exact-members")
    stays = cut(members.filter("_id <=> keep_id").groupBy("_hash").agg(F.max("_text").alias("_kept_text")), "exact-stays")
    # distinct only after the cut: an aggregate on the join's own key would keep a hot key's rows together
    differ = cut(members.join(stays, "_hash").filter("_text <> _kept_text").select("_hash"), "exact-collisions").distinct()

    def decided(r: DataFrame) -> DataFrame:
        kept = F.col("_id").eqNullSafe(F.col("keep_id")) | F.col("keep_id").isNull()
        return r.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))

    if differ.isEmpty():
        return decided(sums.join(groups, "_hash"))
    clean = sums.join(differ, "_hash", "left_anti").join(groups, "_hash")
    collided = members.drop("keep_id").join(differ, "_hash", "left_semi")
    regrouped = collided.groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("group_size"), best("_id").alias("keep_id"))
    return decided(clean).unionByName(decided(collided.join(regrouped, ["_hash", "_text"]).withColumn("_sha", sha)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLE_SQL = {
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g ON d.norm = g.norm
"""
}
