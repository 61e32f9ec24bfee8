"""File references in documents: `bucket:hash.ext` strings and `_file` objects."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def looks_like_ref(s: str) -> bool:
    """A string with `:` and `.` and eight bytes or more behind the first `:`."""
    return ":" in s and "." in s and len(s.split(":", 1)[1].encode()) >= 8


def refs_in(value, out: set[str] | None = None) -> set[str]:
    """References at any depth, in values but not in keys; an object's `_file` counts as its string form."""
    out = set() if out is None else out
    if isinstance(value, str):
        if looks_like_ref(value):
            out.add(value)
    elif isinstance(value, list):
        for v in value:
            refs_in(v, out)
    elif isinstance(value, dict):
        f = value.get("_file")
        if isinstance(f, dict) and all(isinstance(f.get(k), str) for k in ("bucket", "id", "ext")):
            out.add(compact(f["bucket"], f["id"], f["ext"]))
        for v in value.values():
            refs_in(v, out)
    return out


def compact(bucket: str, id_: str, ext: str) -> str:
    return f"{bucket}:{id_}.{ext}" if ext else f"{bucket}:{id_}"


def _extract(batches):
    for batch in batches:
        found = [sorted(refs_in(json.loads(r))) if r else [] for r in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.list_(pa.string()))], ["_id", "refs"])


def extract(docs: DataFrame) -> DataFrame:
    """(_id, refs) of documents (_id, raw): the distinct references of each."""
    return docs.select("_id", "raw").mapInArrow(_extract, "_id string, refs array<string>")


def counts(refs: DataFrame) -> DataFrame:
    """Documents that hold each reference: (ref, n_docs)."""
    return refs.select("_id", F.explode(F.array_distinct("refs")).alias("ref")).groupBy("ref").agg(F.count("*").alias("n_docs"))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """References that a document gained or lost: (_id, added, dropped)."""
    none = F.array().cast("array<string>")
    both = old.select("_id", F.col("refs").alias("a")).join(new.select("_id", F.col("refs").alias("b")), "_id", "full")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    return both.select("_id", F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("dropped")).where("size(added) > 0 or size(dropped) > 0")


def parse(ref: Column) -> list[Column]:
    """bucket, id and ext of a reference: split at the first `:` and the last `.`."""
    rest = F.regexp_extract(ref, r"(?s)^[^:]*:(.*)$", 1)
    return [F.regexp_extract(ref, r"(?s)^([^:]*):", 1).alias("bucket"), F.regexp_extract(rest, r"(?s)^(.*)\.[^.]*$", 1).alias("id"), F.regexp_extract(rest, r"(?s)\.([^.]*)$", 1).alias("ext")]


def orphans(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Files (column ref) that no document refers to."""
    return files.join(refs.select(F.explode("refs").alias("ref")).distinct(), "ref", "left_anti")


def dangling(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(_id, ref) of references to files that aren't there."""
    return refs.select("_id", F.explode("refs").alias("ref")).join(files.select("ref"), "ref", "left_anti")
