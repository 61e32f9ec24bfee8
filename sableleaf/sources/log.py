"""The JSON Lines log: scan, validity, classification, and sinks."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sableleaf.errors import SerializationError


def configure(spark: SparkSession) -> SparkSession:
    """Settings that the log's semantics need: of duplicate keys the last counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def parsed(lines: DataFrame) -> DataFrame:
    """Adds to lines (value) their only JSON value (v), NULL for lines that aren't one value of valid UTF-8, or hold a number beyond all doubles.

    The text is parsed once: a generated column isn't written out anew wherever it is used.
    """
    out = lines.withColumn("__v", F.explode(F.array(F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]"))))))
    v, value = F.col("__v"), F.col("value")
    first = F.try_variant_get(v, "$[0]", "variant")
    # only numbers of so many digits, or so large an exponent, can be out of range
    large = value.rlike(r"[eE]\+?0*[1-9][0-9]{2}|[0-9]{300}") & F.to_json(v).rlike(r"(?<=[\[:,])\"?-?Infinity\"?(?=[\]},])")
    good = F.is_valid_utf8(value) & F.try_variant_get(v, "$[1]", "variant").isNull() & ~large
    return out.withColumn("v", F.explode(F.array(F.when(good, first)))).drop("__v")


def scan(spark: SparkSession, paths) -> DataFrame:
    """Lines of log files, with their place: (pos, value).

    pos orders lines within and across files (by file name). Blank lines go, and
    so does a file's very first line if it holds `"_meta"`.
    """
    configure(spark)
    m = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.struct(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"), "value")
    first = lines.groupBy("pos.file").agg(F.min("pos").alias("pos"))
    heads = lines.where("pos.block = 0 and contains(value, '\"_meta\"')").join(first.select("pos"), "pos", "left_semi").select("pos")
    return lines.join(heads, "pos", "left_anti").where("not rlike(value, '^\\\\s*$')")


def classify(lines: DataFrame) -> DataFrame:
    """Entries of a log: (pos, _id, kind, raw), kind being doc, tombstone or patch.

    Lines that aren't valid, aren't objects or have no string `_id` don't show.
    """
    v = F.col("v")
    text = lambda key: F.when(F.schema_of_variant(F.try_variant_get(v, key, "variant")) == "STRING", F.try_variant_get(v, key, "string"))
    e = parsed(lines).where("v is not null").withColumn("_id", F.explode(F.array(text("$._id")))).where("_id is not null")
    kind = F.when(F.try_variant_get(v, "$._deleted", "variant").isNotNull(), "tombstone").when(text("$._op").isNotNull(), "patch").otherwise("doc")
    return e.select("pos", "_id", kind.alias("kind"), F.col("value").alias("raw"))


def valid(lines: DataFrame) -> DataFrame:
    """Lines that hold one JSON value: what recovery keeps, history and tombstones too."""
    return parsed(lines).where("v is not null").drop("v")


def corrupt_count(lines: DataFrame) -> DataFrame:
    """Lines that hold none, as one row (n_corrupt)."""
    return parsed(lines).agg(F.count_if(F.col("v").isNull()).alias("n_corrupt"))


def dumps(value) -> str:
    try:
        return json.dumps(value, ensure_ascii=False, allow_nan=False, separators=(",", ":"))
    except (TypeError, ValueError) as e:
        raise SerializationError(str(e)) from e


def tombstone(id_: str, at: int | None = None) -> str:
    return dumps({"_id": id_, "_deleted": int(time.time()) if at is None else at})


def patch_push(id_: str, name: str, value) -> str:
    return dumps({"_id": id_, "_op": "array_push", "field": name, "value": value})


def patch_set(id_: str, path: str, value) -> str:
    return dumps({"_id": id_, "_op": "set", "path": path, "value": value})


def patch_remove(id_: str, path: str) -> str:
    return dumps({"_id": id_, "_op": "remove", "path": path})
