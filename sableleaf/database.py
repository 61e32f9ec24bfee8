"""A document database: a folder with a log in batches, its trash and its files."""

from __future__ import annotations

import json
import secrets
import string
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableleaf.errors import Conflict, InvalidArgument, Locked, NotFound
from sableleaf.functions import refs
from sableleaf.functions.paths import array_push, remove_path, set_path
from sableleaf.operators import maintenance
from sableleaf.operators.collection import Collection
from sableleaf.operators.replay import replay
from sableleaf.sources import log
from sableleaf.sources.buckets import Buckets

_ALPHABET = string.digits + string.ascii_uppercase + string.ascii_lowercase
ID_CHARS = 16
#: Times that an append is tried while others commit.
RETRIES = 20
#: Seconds after which a claim on a manifest's number that came to nothing is void.
CLAIM_S = 60


def new_id(prefix: str | None = None) -> str:
    """16 characters of base 62, behind `prefix_` if given."""
    own = "".join(secrets.choice(_ALPHABET) for _ in range(ID_CHARS))
    return f"{prefix}_{own}" if prefix else own


def is_valid_id(id_: str) -> bool:
    return bool(id_) and all(c in _ALPHABET or c in "_-" for c in id_)


class Database:
    """Batches of log entries are folders; the manifest names those that count, in order.

    Manifests are numbered files, the highest counts. A write commits by creating
    the next one, which fails if another writer has: that write raises Conflict and
    changes nothing. A manifest is written in full before it gets its name, so
    readers see whole batches and a crash leaves the one before. Reads replay the
    log as Spark jobs and stay lazy.
    """

    def __init__(self, spark: SparkSession, path: str, create: bool = True):
        self.spark, self.path = log.configure(spark), path.rstrip("/")
        self.files = Buckets(spark, self.path)
        self.fs, self._at = self.files._fs(), self.files._path
        if self._version() is None:
            if not create or self._holds_data():
                raise NotFound(f"{path} has no manifest")
            self._save({"version": 1, "created": str(int(time.time())), "buckets": [], "log": [], "trash": []}, 0)

    # the manifest ----------------------------------------------------------
    def _version(self) -> int | None:
        """The number of the manifest that counts."""
        folder = self._at("manifests")
        if not self.fs.exists(folder):
            return None
        found = [int(n[:-5]) for s in self.fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit()]
        return max(found, default=None)

    def _holds_data(self) -> bool:
        """Whether batches or manifests are there that no manifest names: never cover them by an empty database."""
        return any(self.fs.exists(self._at(x)) and len(self.fs.listStatus(self._at(x))) for x in ("log", "trash", "manifests"))

    def _load(self) -> tuple[dict, int]:
        """The manifest and its number."""
        number = self._version()
        if number is None:
            raise NotFound(self.path)
        text = "\n".join(r["value"] for r in self.spark.read.option("wholetext", True).text(self._at("manifests", f"{number:010d}.json").toString()).collect())
        return json.loads(text), number

    def manifest(self) -> dict:
        return self._load()[0]

    def _save(self, m: dict, number: int) -> None:
        """Create the manifest of that number; Conflict if there is one."""
        self.fs.mkdirs(self._at("manifests"))
        target, temp = self._at("manifests", f"{number:010d}.json"), self._at("manifests", f".{uuid.uuid4().hex}.tmp")
        claim = self._at("manifests", f".{number:010d}.claim")
        if self.fs.exists(claim) and time.time() * 1000 - self.fs.getFileStatus(claim).getModificationTime() > CLAIM_S * 1000:
            self.fs.delete(claim, False)  # left by a writer that died
        if self.fs.exists(target) or not self.fs.createNewFile(claim):
            raise Conflict(f"manifest {number}")
        try:
            out = self.fs.create(temp, False)
            out.write(bytearray(log.dumps(m).encode()))
            out.close()
            if not self.fs.rename(temp, target):
                raise Conflict(f"manifest {number}")
        except BaseException:
            self.fs.delete(temp, False)
            self.fs.delete(claim, False)  # nothing was committed: the number is free again
            raise

    def _commit(self, change) -> dict:
        """Read the manifest, change it, and save it as the next one."""
        self._writable()
        m, number = self._load()
        change(m)
        self._save(m, number + 1)
        return m

    def _writable(self) -> None:
        for name in (".lock", ".readonly"):
            if self.fs.exists(self._at(name)):
                raise Locked(name)

    # batches ------------------------------------------------------------------
    def _append(self, lines: list[str] | DataFrame, kind: str = "log") -> None:
        self._writable()
        name = f"{kind}/batch-{uuid.uuid4().hex}"
        if isinstance(lines, DataFrame):
            out = lines.select("value")
        else:
            out = self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
        out.write.text(f"{self.path}/{name}")
        for turn in range(RETRIES):  # an append goes behind whatever came in between
            try:
                self._commit(lambda m: m[kind].append(name))
                return
            except Conflict:
                if turn == RETRIES - 1:
                    self.fs.delete(self._at(name), True)
                    raise
                time.sleep(0.05 * (turn + 1))

    def _replace(self, lines: DataFrame | None, kind: str, read: int) -> None:
        """A new batch instead of all that manifest number `read` names, which it was made from; then those are deleted."""
        self._writable()
        old, new = self._load()[0][kind], []
        if lines is not None:
            new = [f"{kind}/base-{uuid.uuid4().hex}"]
            lines.select("value").write.text(f"{self.path}/{new[0]}")
        m, number = self._load()
        if number != read:
            for x in new:
                self.fs.delete(self._at(x), True)
            raise Conflict(f"manifest {number} is newer than {read}")
        m[kind] = new
        try:
            self._save(m, read + 1)
        except Conflict:
            for x in new:
                self.fs.delete(self._at(x), True)
            raise
        for x in old:
            self.fs.delete(self._at(x), True)

    def _lines(self, kind: str) -> DataFrame:
        batches = self.manifest()[kind]
        if not batches:
            return self.spark.createDataFrame([], "pos struct<batch: int, file: string, block: bigint, row: bigint>, value string")
        lines = log.scan(self.spark, [f"{self.path}/{b}" for b in batches])
        order = F.create_map(*(x for i, b in enumerate(batches) for x in (F.lit(b.rsplit("/", 1)[1]), F.lit(i))))
        batch = F.element_at(order, F.regexp_extract("pos.file", r"/([^/]+)/[^/]+$", 1))
        return lines.select(F.struct(batch.alias("batch"), "pos.file", "pos.block", "pos.row").alias("pos"), "value")

    def lines(self) -> DataFrame:
        return self._lines("log")

    def trash(self) -> DataFrame:
        return maintenance.trash_entries(self._lines("trash"))

    def documents(self) -> DataFrame:
        """Live documents: (_id, raw)."""
        return replay(self.lines())[0]

    def deleted_ids(self) -> DataFrame:
        return replay(self.lines())[1]

    def collection(self) -> Collection:
        return Collection.of_raw(self.documents())

    # reads ---------------------------------------------------------------------
    def get(self, id_: str) -> dict:
        return json.loads(self.collection().get_one(id_)["raw"])

    def query(self, filter_, **options) -> DataFrame:
        return self.collection().query_with(filter_, **options)

    def find(self, name: str, value) -> DataFrame:
        return self.collection().find(name, value)

    def find_range(self, name: str, low, high) -> DataFrame:
        return self.collection().find_range(name, low, high)

    def find_where(self, name: str, predicate) -> DataFrame:
        return self.collection().find_where(name, predicate)

    def contains(self, id_: str) -> bool:
        return self.collection().contains(id_)

    def __len__(self) -> int:
        return self.documents().count()

    def is_empty(self) -> bool:
        return self.documents().isEmpty()

    def ids(self) -> DataFrame:
        return self.documents().select("_id")

    # writes --------------------------------------------------------------------
    @staticmethod
    def _checked(doc) -> dict:
        if not isinstance(doc, dict):
            raise InvalidArgument("a document is an object")
        if "_deleted" in doc or isinstance(doc.get("_op"), str):
            raise InvalidArgument("_deleted and _op are the log's own")
        return doc

    def insert(self, doc: dict, prefix: str | None = None) -> str:
        return self.insert_many([doc], prefix)[0]

    def insert_many(self, docs: list[dict], prefix: str | None = None) -> list[str]:
        ids = [new_id(prefix) for _ in docs]
        self._append([log.dumps(self._checked(d) | {"_id": i}) for d, i in zip(docs, ids, strict=True)])
        return ids

    def insert_frame(self, df: DataFrame) -> None:
        """Append the rows of a frame as documents, as a Spark job; `_id` is taken or made."""
        id_ = F.col("_id").cast("string") if "_id" in df.columns else F.substring(F.sha2(F.concat(F.uuid(), F.monotonically_increasing_id().cast("string")), 256), 1, ID_CHARS)
        self._append(df.withColumn("_id", id_).select(F.to_json(F.struct("*")).alias("value")))

    def update(self, id_: str, doc: dict) -> None:
        self.get(id_)
        self._append([log.dumps(self._checked(doc) | {"_id": id_})])

    def _patch(self, id_: str, line: str, change) -> None:
        doc = self.get(id_)
        before = refs.refs_in(doc)
        change(doc)
        self._append([line])
        self._trash_unused(before - refs.refs_in(doc))

    def array_push(self, id_: str, name: str, value) -> None:
        self._patch(id_, log.patch_push(id_, name, value), lambda d: array_push(d, name, value))

    def set(self, id_: str, path: str, value) -> None:
        if path == "_id":
            raise InvalidArgument("_id can't be set")
        self._patch(id_, log.patch_set(id_, path, value), lambda d: set_path(d, path, value))

    def remove(self, id_: str, path: str) -> None:
        if path == "_id":
            raise InvalidArgument("_id can't be removed")
        self._patch(id_, log.patch_remove(id_, path), lambda d: remove_path(d, path))

    def delete(self, id_: str, keep: bool = True, at: int | None = None) -> None:
        """A tombstone; the document goes to the trash (unless keep is off) with files it alone referred to."""
        doc = self.get(id_)
        at = int(time.time()) if at is None else at
        self._append([log.tombstone(id_, at)])
        gone = self._trash_unused(refs.refs_in(doc))
        if keep:
            self._append([log.dumps(doc | {"_deleted": at} | ({"_trashed_files": gone} if gone else {}))], "trash")

    def restore(self, id_: str) -> dict:
        """Bring back the newest trash entry of a deleted document, with its files."""
        self._writable()
        row = maintenance.latest(self.trash()).where(F.col("_id") == id_).first()
        if row is None:
            raise NotFound(id_)
        if self.contains(id_):
            raise InvalidArgument(f"{id_} is live")
        doc = json.loads(row["raw"])
        for ref in doc.pop("_trashed_files", []):
            self._file_op(ref, self.files.restore)
        doc.pop("_deleted", None)
        self._append([log.dumps(doc)])
        return doc

    def flush(self) -> None:
        """Batches are durable once written; nothing is held back."""

    # files -----------------------------------------------------------------------
    @staticmethod
    def _file_op(ref: str, op) -> bool:
        bucket, _, rest = ref.partition(":")
        id_, _, ext = rest.rpartition(".")
        try:
            op(bucket, id_ or rest, ext if id_ else "")
        except NotFound:
            return False
        return True

    def _trash_unused(self, candidates: set[str]) -> list[str]:
        if not candidates:
            return []
        held = refs.extract(self.documents()).select(F.explode("refs").alias("ref")).where(F.col("ref").isin(*candidates)).distinct().collect()
        return [r for r in sorted(candidates - {h["ref"] for h in held}) if self._file_op(r, self.files.delete)]

    def release_file(self, ref: str) -> bool:
        """Trash a file unless some string of a live document contains its reference."""
        self._writable()
        if ":" not in ref or "." not in ref:
            raise InvalidArgument(ref)
        if not self.documents().where(F.col("raw").contains(ref)).isEmpty():
            return False
        return self._file_op(ref, self.files.delete)

    def gc_buckets(self) -> int:
        """Trash all files that no live document refers to, in either form."""
        self._writable()
        gone = [r["ref"] for r in refs.orphans(self.files.refs(), refs.extract(self.documents())).toLocalIterator()]
        return sum(self._file_op(r, self.files.delete) for r in gone)

    # maintenance ---------------------------------------------------------------------
    def compact(self) -> None:
        """Rewrite the log as its live documents; history, tombstones and patches go."""
        read = self._version()
        self._replace(self.documents().select(F.col("raw").alias("value")), "log", read)

    def purge_trash(self, ttl_s: int, now: int | None = None) -> int:
        """Drop trash entries deleted ttl_s seconds ago or longer; returns how many."""
        now = int(time.time()) if now is None else now
        read, t = self._version(), self.trash()
        before = t.count()
        kept = maintenance.keep_after(t, now - ttl_s)
        left = kept.count()
        if left < before:
            self._replace(kept.select(F.col("raw").alias("value")), "trash", read)
        return before - left

    def purge_all_trash(self) -> int:
        read = self._version()
        n = self.trash().count()
        self._replace(None, "trash", read)
        return n

    def export_snapshot(self, to: str) -> dict:
        """Live documents and all files, in a folder of the same layout, marked as a snapshot."""
        other = Database(self.spark, to)
        other._append(self.documents().select(F.col("raw").alias("value")))
        for bucket in self.files.buckets():
            for name in self.files.list(bucket):
                self.jvm_copy(self._at("files", bucket, name), other._at("files", bucket, name))
        count = len(other)
        return other._commit(lambda m: m.update(type="snapshot", documents=count))

    def jvm_copy(self, a, b) -> None:
        jvm, conf = self.files.jvm, self.files.hadoop
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)

    def import_snapshot(self, source: str) -> None:
        other = Database(self.spark, source, create=False)
        m = other.manifest()
        if m.get("type") != "snapshot" or m.get("version") != 1:
            raise InvalidArgument(f"{source} is no snapshot of version 1")
        self._append(other.documents().select(F.col("raw").alias("value")))
        for bucket in other.files.buckets():
            for name in other.files.list(bucket):
                self.jvm_copy(other._at("files", bucket, name), self._at("files", bucket, name))

    def merge_from(self, source: str) -> None:
        """Union with another database by id; the later `_modified` wins, on a tie the other's."""
        other, read = Database(self.spark, source, create=False), self._version()
        self._replace(maintenance.merge_raw(self.documents(), other.documents()).select(F.col("raw").alias("value")), "log", read)
        more = other.manifest()["buckets"]
        self._commit(lambda m: m.update(buckets=sorted({*m["buckets"], *more})))

    def verify(self) -> dict:
        return maintenance.verify(self.lines(), self.documents(), self.files.refs())

    def recover(self, to: str) -> Database:
        """Copy every valid line, history and tombstones too, to another database."""
        other = Database(self.spark, to)
        good = log.valid(self.lines()).orderBy("pos")
        other._append(good.select("value"))
        return other

    def info(self) -> dict:
        s = maintenance.statistics(self.lines(), self.documents()).first().asDict()
        t = self.trash().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("b")).first()
        size = s["log_bytes"] or 0
        return s | {"trash_entries": t["n"], "fragmentation": t["b"] / (size + t["b"]) if size + t["b"] else 0.0, "buckets": {b: len(self.files.list(b)) for b in self.files.buckets()}}

    # settings -------------------------------------------------------------------------
    def config_get(self, path: str):
        at = self.manifest()
        for key in path.split("."):
            if not isinstance(at, dict) or key not in at:
                raise NotFound(path)
            at = at[key]
        return at

    def config_set(self, path: str, text: str) -> None:
        """The value is a comma list (for `buckets`), else a whole number, else JSON, else text."""
        if path.split(".")[0] in ("log", "trash"):
            raise InvalidArgument(f"{path} is the engine's own")
        if path == "buckets":
            value = [x.strip() for x in text.split(",") if x.strip()]
        else:
            try:
                value = int(text)
            except ValueError:
                try:
                    value = json.loads(text)
                except ValueError:
                    value = text

        def change(at: dict) -> None:
            *steps, last = path.split(".")
            for key in steps:
                if not isinstance(at.get(key), dict):
                    at[key] = {}
                at = at[key]
            at[last] = value

        self._commit(change)

    def destroy(self, force: bool = False) -> None:
        """Delete the whole folder."""
        self._writable()
        if not force:
            raise InvalidArgument("destroy needs force")
        self.fs.delete(self._at(), True)
