"""Content-addressed file buckets on any file system that Spark can open."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableleaf.errors import NotFound
from sableleaf.functions.refs import compact

ID_CHARS = 8


def extension(name: str) -> str:
    """What follows the last dot of a name, or nothing."""
    return name.rsplit(".", 1)[1] if "." in name else ""


def describe(files: DataFrame) -> DataFrame:
    """Metadata of (bucket, name, content, type): adds id (8 hex digits of SHA-256), the whole digest, ext and size."""
    digest = F.sha2(F.col("content").cast("binary"), 256)
    ext = F.when(F.col("name").contains("."), F.regexp_extract("name", r"(?s)\.([^.]*)$", 1)).otherwise("")
    return files.withColumns({"sha256": digest, "id": F.substring(digest, 1, ID_CHARS), "ext": ext, "size": F.octet_length("content").cast("long")})


def deduplicate(files: DataFrame) -> DataFrame:
    """One file for each bucket, digest and extension; of equal ones the smallest name."""
    d = describe(files)
    return d.groupBy("bucket", "sha256", "ext").agg(F.min_by(F.struct("name", "id", "size", "type", "content"), F.struct("name", "type")).alias("f")).select("bucket", "sha256", "ext", "f.*")


class Buckets:
    """Files under `<root>/files/<bucket>/<id>.<ext>`, and trashed ones under `<root>/trash/files/<bucket>`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.hadoop)

    @staticmethod
    def _file(id_: str, ext: str) -> str:
        return f"{id_}.{ext}" if ext else id_

    def store(self, bucket: str, name: str, content: bytes, mime: str) -> dict:
        """Write a file unless it is there, and return its metadata."""
        digest = hashlib.sha256(content).hexdigest()
        id_, ext = digest[:ID_CHARS], extension(name)
        at, fs = self._path("files", bucket, self._file(id_, ext)), self._fs()
        if not fs.exists(at):
            temp = self._path("files", bucket, f".{self._file(id_, ext)}.tmp")
            out = fs.create(temp, True)
            out.write(bytearray(content))
            out.close()
            fs.rename(temp, at)
        return {"_file": {"bucket": bucket, "id": id_, "ext": ext}, "name": name, "size": len(content), "type": mime, "created": int(time.time()), "sha256": digest}

    def get(self, bucket: str, id_: str, ext: str) -> bytes:
        if not self.exists(bucket, id_, ext):
            raise NotFound(compact(bucket, id_, ext))
        row = self.spark.read.format("binaryFile").load(self._path("files", bucket, self._file(id_, ext)).toString()).select("content").first()
        return bytes(row["content"])

    def exists(self, bucket: str, id_: str, ext: str) -> bool:
        return self._fs().exists(self._path("files", bucket, self._file(id_, ext)))

    def buckets(self) -> list[str]:
        return self._names(self._path("files"), True)

    def list(self, bucket: str) -> list[str]:
        return self._names(self._path("files", bucket), False)

    def trashed(self, bucket: str) -> list[str]:
        return self._names(self._path("trash", "files", bucket), False)

    def _names(self, at, folders: bool) -> list[str]:
        fs = self._fs()
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() == folders and not s.getPath().getName().endswith((".tmp", ".crc")))

    def refs(self) -> DataFrame:
        """All stored files as (ref); names only, one for each file."""
        rows = [(f"{b}:{n}",) for b in self.buckets() for n in self.list(b)]
        return self.spark.createDataFrame(rows, "ref string")

    def _move(self, bucket: str, file: str, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        fs, a = self._fs(), self._path(*source, bucket, file)
        if not fs.exists(a):
            raise NotFound(f"{bucket}:{file}")
        fs.mkdirs(self._path(*target, bucket))
        b = self._path(*target, bucket, file)
        if fs.exists(b):
            fs.delete(b, False)
        fs.rename(a, b)

    def delete(self, bucket: str, id_: str, ext: str) -> None:
        """Move a file to the trash."""
        self._move(bucket, self._file(id_, ext), ("files",), ("trash", "files"))

    def restore(self, bucket: str, id_: str, ext: str) -> None:
        self._move(bucket, self._file(id_, ext), ("trash", "files"), ("files",))

    def purge(self, older_than_s: float, now: float | None = None) -> int:
        """Delete trashed files last written more than that many seconds ago; 0: all of them."""
        fs, n, top = self._fs(), 0, self._path("trash", "files")
        if not fs.exists(top):
            return 0
        cut = (time.time() if now is None else now) * 1000 - older_than_s * 1000
        for folder in fs.listStatus(top):
            for s in fs.listStatus(folder.getPath()):
                if older_than_s == 0 or s.getModificationTime() < cut:
                    n += fs.delete(s.getPath(), False)
        return n
