"""Maintenance as relational jobs: purge, restore, merge, verify, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sableleaf.functions import refs
from sableleaf.sources import log


def trash_entries(lines: DataFrame) -> DataFrame:
    """(pos, _id, deleted, raw) of a trash log; deleted is NULL unless a whole number of 0 or more."""
    v = F.col("v")
    t = log.parsed(lines).where("v is not null")
    at = F.try_variant_get(v, "$._deleted", "variant")
    number = F.when(F.schema_of_variant(at) == "BIGINT", F.try_variant_get(v, "$._deleted", "bigint"))
    id_ = F.when(F.schema_of_variant(F.try_variant_get(v, "$._id", "variant")) == "STRING", F.try_variant_get(v, "$._id", "string"))
    return t.select("pos", id_.alias("_id"), F.when(number >= 0, number).alias("deleted"), F.col("value").alias("raw"))


def keep_after(trash: DataFrame, cutoff: int) -> DataFrame:
    """Trash entries that a purge keeps: deleted after the cutoff, or at no known time."""
    return trash.where(F.col("deleted").isNull() | (F.col("deleted") > cutoff))


def latest(trash: DataFrame) -> DataFrame:
    """The newest trash entry of each id: what a restore brings back."""
    return trash.where("_id is not null").groupBy("_id").agg(F.max_by(F.struct("deleted", "raw"), "pos").alias("t")).select("_id", "t.deleted", "t.raw")


def merge(base: DataFrame, other: DataFrame, modified: str = "_modified", id_col: str = "_id") -> DataFrame:
    """Union by id; on a collision the larger `modified` wins (missing: 0), on a tie the other side.

    One aggregate on the id: both sides meet in one shuffle, without a join.
    """
    cols = base.columns
    both = base.withColumn("__side", F.lit(0)).unionByName(other.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    best = both.groupBy(id_col).agg(F.max_by(F.struct(*(c for c in both.columns if c != "__side")), F.struct(F.coalesce(F.col(modified), F.lit(0)).alias("m"), "__side")).alias("x"))
    return best.select("x.*").select(*cols, *(c for c in other.columns if c not in cols))


def merge_raw(base: DataFrame, other: DataFrame) -> DataFrame:
    """`merge` of (_id, raw) documents, by their `_modified`."""
    def mod(df: DataFrame) -> DataFrame:
        v = F.try_parse_json("raw")
        at = F.try_variant_get(v, "$._modified", "variant")
        return df.select("_id", "raw", F.when(F.schema_of_variant(at) == "BIGINT", F.greatest(F.try_variant_get(v, "$._modified", "bigint"), F.lit(0))).alias("_modified"))

    return merge(mod(base), mod(other)).select("_id", "raw")


def verify(lines: DataFrame, docs: DataFrame, files: DataFrame) -> dict:
    """Counts of corrupt lines and of references to files that aren't there."""
    return {"corrupt": log.corrupt_count(lines).first()["n_corrupt"], "dangling": refs.dangling(refs.extract(docs), files).count()}


def statistics(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: lines, corrupt lines, bytes of the log, live documents and their bytes."""
    a = log.parsed(lines).agg(F.count("*").alias("n_lines"), F.count_if(F.col("v").isNull()).alias("n_corrupt"), F.sum(F.octet_length("value")).alias("log_bytes"))
    b = docs.agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("raw")).alias("doc_bytes"))
    return a.crossJoin(b)  # one row each
