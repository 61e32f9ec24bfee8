"""Patches on JSON values: set, remove and array_push by dotted path."""

from __future__ import annotations

import json
import re

_INDEX = re.compile(r"\+?[0-9]+", re.ASCII)


def _index(key: str) -> int | None:
    """A segment that reads as an unsigned 64-bit number addresses arrays only."""
    if not _INDEX.fullmatch(key):
        return None
    n = int(key)
    return n if n < 1 << 64 else None


def _parent(doc, path: str):
    """The container of a path's last segment and the key in it, or None if a step is missing."""
    *steps, last = path.split(".")
    at = doc
    for key in steps:
        n = _index(key)
        if n is not None:
            if not isinstance(at, list) or n >= len(at):
                return None
            at = at[n]
        elif isinstance(at, dict) and key in at:
            at = at[key]
        else:
            return None
    n = _index(last)
    if n is not None:
        return (at, n) if isinstance(at, list) and n < len(at) else None
    return (at, last) if isinstance(at, dict) else None


def set_path(doc, path: str, value) -> None:
    """Set a key or an existing array place. Steps on the way are never created;
    a number never addresses an object. The id can't be set."""
    if path != "_id" and (spot := _parent(doc, path)):
        spot[0][spot[1]] = value


def remove_path(doc, path: str) -> None:
    """Remove a key, or an array place with those behind it moving up; missing: nothing."""
    if path != "_id" and (spot := _parent(doc, path)):
        at, key = spot
        if isinstance(at, list):
            del at[key]
        else:
            at.pop(key, None)


def array_push(doc, name: str, value) -> None:
    """Append to a top-level array; anything else there is replaced by [value]. The name is no path."""
    if name == "_id":
        return
    if isinstance(doc.get(name), list):
        doc[name].append(value)
    else:
        doc[name] = [value]


def fold(raw: str, patches: list[str]) -> str:
    """Apply patch entries (JSON text, in order) to a document (JSON text)."""
    doc = json.loads(raw)
    for line in patches:
        p = json.loads(line)
        op = p.get("_op")
        if op == "array_push" and isinstance(p.get("field"), str) and "value" in p:
            array_push(doc, p["field"], p["value"])
        elif op == "set" and isinstance(p.get("path"), str) and "value" in p:
            set_path(doc, p["path"], p["value"])
        elif op == "remove" and isinstance(p.get("path"), str):
            remove_path(doc, p["path"])
    return json.dumps(doc, ensure_ascii=False, allow_nan=False, separators=(",", ":"))
