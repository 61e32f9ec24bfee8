"""The log: line guards, replay against a sequential fold, paths, and the database folder."""

import json
import random

import pytest

from sableleaf.database import Database, new_id
from sableleaf.errors import Conflict, InvalidArgument, Locked, NotFound
from sableleaf.functions import paths, refs
from sableleaf.operators.replay import replay
from sableleaf.sources import log


def frame(spark, lines):
    log.configure(spark)
    return spark.createDataFrame(list(enumerate(lines)), "pos long, value string")


def sequential(lines):
    docs, deleted = {}, set()
    for x in lines:
        try:
            e = json.loads(x)
        except ValueError:
            continue
        if not isinstance(e, dict) or not isinstance(e.get("_id"), str):
            continue
        i = e["_id"]
        if "_deleted" in e:
            deleted.add(i)
            docs.pop(i, None)
        elif isinstance(e.get("_op"), str):
            if i in docs:
                docs[i] = json.loads(paths.fold(json.dumps(docs[i]), [x]))
        else:
            docs[i] = e
            deleted.discard(i)
    return docs, deleted


def replayed(spark, lines):
    live, gone = replay(frame(spark, lines))
    return {r["_id"]: json.loads(r["raw"]) for r in live.collect()}, {r["_id"] for r in gone.collect()}


def test_line_guards(spark):
    good = ['{"_id":"a"}', ' {"_id":"b"}\r', '{"_id":"c","x":1,"x":2}', "[1]", "null", "3", '{"a":1e300}', '{"a":"1e400, Infinity"}']
    bad = ['{"_id":"a"', '{"_id":"a"} x', '{"a":1}{"b":2}', "1,2", "garbage", '{"a":NaN}', '{"a":1e400}', '[-1E+999]', '{"a":' + "9" * 400 + "}"]
    assert log.corrupt_count(frame(spark, good + bad)).first()["n_corrupt"] == len(bad)
    assert log.valid(frame(spark, good + bad)).count() == len(good)


def test_replay_random(spark):
    r = random.Random(3)
    lines = []
    for _ in range(400):
        i = r.choice("abcdefgh")
        lines.append(r.choice([
            lambda: log.dumps({"_id": i, "l": [1], "o": {"k": [{"x": 1}]}, "n": r.randint(0, 9)}), lambda: log.tombstone(i, 5), lambda: log.patch_push(i, r.choice(["l", "n", "z"]), r.randint(0, 9)),
            lambda: log.patch_set(i, r.choice(["n", "o.k.0.x", "o.k.9", "a.b", "l.0", "0", ""]), r.randint(0, 9)), lambda: log.patch_remove(i, r.choice(["n", "o.k.0", "l.0", "o.q", "o.k.0.x"])),
            lambda: "{broken", lambda: '{"_id":"' + i + '","_op":"odd"}', lambda: '{"_id":"' + i + '","_op":7,"v":1}', lambda: '{"_id":"' + i + '","_deleted":null}',
        ])())
    assert replayed(spark, lines) == sequential(lines)


def test_paths():
    d = {"m": [{"t": "x"}, {"t": "y"}], "o": {"0": 1, "a": {}}, "l": [1, 2, 3]}
    for path, v in (("m.0.t", "z"), ("o.0", 9), ("l.3", 9), ("q.r", 9), ("o.a.new", 1), ("l.+1", 7), ("_id", "no")):
        paths.set_path(d, path, v)
    assert d == {"m": [{"t": "z"}, {"t": "y"}], "o": {"0": 1, "a": {"new": 1}}, "l": [1, 7, 3]}
    for path in ("m.0", "o.0", "l.007", "l.2", "o.a.nope"):
        paths.remove_path(d, path)
    assert d == {"m": [{"t": "y"}], "o": {"0": 1, "a": {"new": 1}}, "l": [1, 7]}
    paths.array_push(d, "l", 1)
    paths.array_push(d, "o", 2)
    assert d["l"] == [1, 7, 1] and d["o"] == [2]


def test_scan_skips_first_meta_line_only(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'{"_id":"lost","n":"\\"_meta\\""}\n\n  \n{"_id":"a","s":"\\"_meta\\""}\n{"_id":"\xff"}\n{"_id":"b"}'.replace(b'\\"_meta\\"', b'"_meta"'.replace(b'"', b"")) .replace(b'"n":"_meta"', b'"_meta":1').replace(b'"s":"_meta"', b'"_meta":2'))
    assert sorted(r["_id"] for r in replay(log.scan(spark, str(tmp_path / "x.jsonl")))[0].collect()) == ["a", "b"]


def test_refs():
    assert refs.refs_in({"a": ["b:12345678.png", "https://example.com", "no:1.x"], "c": {"_file": {"bucket": "b", "id": "12345678", "ext": "gif"}}, "b:12345678.key": 1}) == {"b:12345678.png", "https://example.com", "b:12345678.gif"}


def test_database(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    a, b, c = db.insert_many([{"v": 1}, {"v": 2}, {"v": 3}], prefix="t")
    assert a.startswith("t_") and len(new_id()) == 16 and len(db) == 3
    db.update(a, {"v": 10})
    db.array_push(a, "tags", "x")
    db.set(a, "v", 11)
    db.remove(b, "v")
    assert db.get(a) == {"_id": a, "v": 11, "tags": ["x"]} and db.get(b) == {"_id": b}
    f = db.files.store("pics", "p.png", b"hello", "image/png")["_file"]
    assert f["id"] == "2cf24dba" and db.files.get("pics", "2cf24dba", "png") == b"hello"
    db.set(c, "pic", "pics:2cf24dba.png")
    assert db.verify() == {"corrupt": 0, "dangling": 0} and not db.release_file("pics:2cf24dba.png") and db.gc_buckets() == 0
    db.delete(c, at=100)
    assert not db.contains(c) and db.files.list("pics") == [] and db.files.trashed("pics") == ["2cf24dba.png"]
    with pytest.raises(NotFound):
        db.get(c)
    assert db.restore(c)["pic"] == "pics:2cf24dba.png" and db.files.list("pics") == ["2cf24dba.png"]
    with pytest.raises(InvalidArgument):
        db.restore(c)
    with pytest.raises(InvalidArgument):
        db.insert({"_deleted": 1})
    before = sorted(r["raw"] for r in db.documents().collect())
    db.compact()
    assert sorted(r["raw"] for r in db.documents().collect()) == before and db.info()["n_lines"] == 3
    assert db.purge_trash(50, now=120) == 0 and db.purge_trash(20, now=120) == 1
    snap = f"file://{tmp_path}/snap"
    assert db.export_snapshot(snap)["documents"] == 3
    other = Database(spark, f"file://{tmp_path}/other")
    other.import_snapshot(snap)
    assert len(other) == 3 and other.files.list("pics") == ["2cf24dba.png"]
    other.set(a, "_modified", 5)
    other.set(a, "v", 99)
    db.merge_from(f"file://{tmp_path}/other")
    assert db.get(a)["v"] == 99
    db.config_set("buckets", "x, y")
    db.config_set("limits.size", "12")
    assert db.config_get("buckets") == ["x", "y"] and db.config_get("limits.size") == 12
    assert len(db.recover(f"file://{tmp_path}/rec")) == 3
    for name in (".lock", ".readonly"):
        (tmp_path / "db" / name).write_text("")
        for change in (lambda: db.insert({}), lambda: db.config_set("a", "1"), lambda: db.release_file("b:12345678.x"), db.gc_buckets, lambda: db.restore(c), db.compact):
            with pytest.raises(Locked):
                change()
        (tmp_path / "db" / name).unlink()


def test_commits(spark, tmp_path):
    """Two writers: appends both stay, a rewrite of what another has changed is refused; no empty manifest covers data."""
    path = f"file://{tmp_path}/db"
    one, two = Database(spark, path), Database(spark, path)
    one.insert({"v": 1})
    two.insert({"v": 2})
    assert len(one) == len(two) == 2 and not one.is_empty() and one.ids().count() == 2
    read = one._version()
    two.insert({"v": 3})
    with pytest.raises(Conflict):
        one._replace(one.documents().selectExpr("raw AS value"), "log", read)
    with pytest.raises(Conflict):
        one._save(one.manifest(), read + 1)
    assert len(Database(spark, path, create=False)) == 3
    # a crash before the manifest has its name leaves the one before
    (tmp_path / "db" / "manifests" / ".half.tmp").write_text("{")
    assert len(Database(spark, path)) == 3
    for f in (tmp_path / "db" / "manifests").glob("*.json"):
        f.unlink()
    with pytest.raises(NotFound):
        Database(spark, path)


def test_stream(spark, tmp_path):
    from sableleaf.streaming import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"_id":"a","v":1}\n{"_id":"b"}\n{"_id":"a","v":2}\n')
    q = follow.latest(follow.entries(spark, f"file://{tmp_path}/in")).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.jsonl").write_text('{"_id":"b","_deleted":3}\n')
    q.processAllAvailable()
    q.stop()
    assert {r["_id"]: r["kind"] for r in spark.table("latest").collect()} == {"a": "doc", "b": "tombstone"}
