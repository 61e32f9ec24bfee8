"""Following a growing log with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableleaf.sources.log import classify, configure


def entries(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Classified entries of new files in a folder: (pos, _id, kind, raw).

    pos orders entries by the file's time, its name, and the line. A file is read
    as a whole, so a log that is followed is best written in batches.
    """
    configure(spark)
    reader = spark.readStream.option("wholetext", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    m = F.col("_metadata")
    files = reader.text(path).select(m["file_modification_time"].alias("time"), m["file_path"].alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return classify(files.select(F.struct("time", "file", "line").alias("pos"), "value"))


def latest(stream: DataFrame) -> DataFrame:
    """The last full document or tombstone of each id, kept up to date (update or complete mode).

    Patches are left to a replay; state is one entry for each id.
    """
    return stream.where("kind <> 'patch'").groupBy("_id").agg(F.max_by(F.struct("kind", "raw"), "pos").alias("b")).select("_id", "b.kind", "b.raw")
