"""Replay of a log to its documents: a fold by id, without a driver-side map."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sableleaf.functions.paths import fold
from sableleaf.sources.log import classify


def bases(entries: DataFrame) -> DataFrame:
    """The last document or tombstone of each id: (_id, kind, raw, base_pos).

    One shuffle on the id, with the last entry kept on the map side.
    """
    return entries.where("kind <> 'patch'").groupBy("_id").agg(F.max("pos").alias("base_pos"), F.max_by(F.struct("kind", "raw"), "pos").alias("b")).select("_id", "b.kind", "b.raw", "base_pos")


def effective_patches(entries: DataFrame, base: DataFrame) -> DataFrame:
    """Patches that change something: after the document they patch, which is live. (_id, pos, raw)"""
    live = base.where("kind = 'doc'").select("_id", "base_pos")
    return entries.where("kind = 'patch'").join(live, "_id").where("pos > base_pos").select("_id", "pos", "raw")


def _fold(batches):
    for batch in batches:
        out = [fold(r, p) for r, p in zip(batch.column("raw").to_pylist(), batch.column("patches").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.string())], ["_id", "raw"])


def replay_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live documents as (_id, raw), deleted ids as (_id)) of classified entries.

    Documents without patches keep their text. Patches are gathered by id, in
    order, and folded over their document in one Arrow pass; ids without patches
    never leave the JVM. One document's patches are sequential by nature, and
    compaction bounds them.
    """
    base = bases(entries)
    patches = effective_patches(entries, base).groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]).alias("patches"))
    live = base.where("kind = 'doc'").join(patches, "_id", "left").select("_id", "raw", "patches")
    folded = live.where("patches is not null").mapInArrow(_fold, "_id string, raw string")
    return live.where("patches is null").select("_id", "raw").unionByName(folded), base.where("kind = 'tombstone'").select("_id")


def replay(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`replay_entries` of (pos, value) lines."""
    return replay_entries(classify(lines))
