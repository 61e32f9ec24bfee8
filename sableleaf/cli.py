"""Command line: python -m sableleaf.cli COMMAND PATH ...; exits with 0, 1 (error), 2 (damage found) or 3 (locked)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from sableleaf.database import Database
from sableleaf.errors import Locked, StoreError


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="sableleaf")
    p.add_argument("command", choices=["init", "info", "compact", "export", "import", "merge", "verify", "recover", "dump", "config", "query", "destroy"])
    p.add_argument("path")
    p.add_argument("rest", nargs="*")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("sableleaf").getOrCreate()
    try:
        db = Database(spark, a.path, create=a.command == "init")
        if a.command == "info":
            print(json.dumps(db.info()))
        elif a.command == "compact":
            db.compact()
        elif a.command == "export":
            print(json.dumps(db.export_snapshot(a.rest[0])))
        elif a.command == "import":
            db.import_snapshot(a.rest[0])
        elif a.command == "merge":
            db.merge_from(a.rest[0])
        elif a.command == "verify":
            found = db.verify()
            print(json.dumps(found))
            return 2 if any(found.values()) else 0
        elif a.command == "recover":
            db.recover(a.rest[0])
        elif a.command == "dump":
            for r in db.documents().toLocalIterator():
                print(r["raw"])
        elif a.command == "config":
            if len(a.rest) > 1:
                db.config_set(a.rest[0], a.rest[1])
            else:
                print(json.dumps(db.config_get(a.rest[0])))
        elif a.command == "query":
            for r in db.query(json.loads(a.rest[0])).toLocalIterator():
                print(r["raw"])
        elif a.command == "destroy":
            db.destroy(a.force)
    except Locked as e:
        print(f"locked: {e}", file=sys.stderr)
        return 3
    except (StoreError, IndexError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
