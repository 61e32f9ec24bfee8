"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space of the word rule `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"

_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Remainders by which keys are filtered before wide rows move: at most so many are broadcast.
RESIDUES = 1 << 20
#: Bytes of rows that an Arrow batch holds, about (one row at least).
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names in spark.checkpoint.dir.

    Where that is unset a temporary folder is made for it, on a single machine
    only: on a cluster every executor would write to its own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sableleaf-")
        spark.conf.set("spark.checkpoint.dir", at)
        _drop_at_exit(spark, at)
    return at.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    def last() -> None:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            pass

    atexit.register(last)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


def _written(df: DataFrame, path: str) -> DataFrame:
    bound_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: lost executors cost nothing but the running tasks,
    and the reader knows the table's size, so Spark's own size check decides
    whether it is broadcast.
    """
    return _written(df, new_path(df.sparkSession, name))


class Scratch:
    """Staged tables that are deleted when the block ends, or before by `drop`.

    What leaves the block must be staged by `staged`, outside of it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, new_path(spark, "scratch")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        drop(self.spark, self.root)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        out = _written(df, path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this block that nothing reads any more."""
        for x in tables:
            if path := getattr(x, "_scratch", None):
                drop(self.spark, path)


def narrowed(df: DataFrame, key: str, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of df that may have a (whole-number) key of `wanted`, by their remainders, which are bounded and broadcast.

    A filter before a join that moves wide rows; it leaves out fewer of them where
    many keys are wanted, and none of those wanted. With `how` "left_anti": the
    other rows, of which none has such a key.
    """
    rest = F.broadcast(wanted.select(F.pmod(F.xxhash64(key), F.lit(RESIDUES)).alias("__r")).distinct())
    return df.join(rest, F.pmod(F.xxhash64(key), F.lit(RESIDUES)) == F.col("__r"), how)


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the bytes of the session's Arrow batches, rows being of any length; a lower bound stays.

    Frames that an operator returns are run after the call, so the bound can't
    hold for a block only. It changes no result.
    """
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_ARROW_BYTES))
    if now > size:
        spark.conf.set(_ARROW_BYTES, str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
