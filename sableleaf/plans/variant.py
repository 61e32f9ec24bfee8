"""Filters over documents held as VARIANT, guarded by JSON kind.

Casts between kinds succeed on variants, so every comparison first asks for the
kind. A missing field is SQL NULL; JSON null is a value.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ast import All, Any_, Const, Field, Test, kind


def accessor(path: tuple[str, ...]) -> str:
    """A variant path of quoted keys: it never reaches into arrays."""
    return "$" + "".join('["' + p.replace("\\", "\\\\").replace('"', '\\"') + '"]' for p in path)


def get(doc: Column, path: tuple[str, ...]) -> Column:
    return F.try_variant_get(doc, accessor(path), "variant")


def kind_of(value: Column) -> Column:
    """null, bool, number, string, array or object; SQL NULL if missing."""
    s = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None)
        .when(s == "VOID", "null")
        .when(s == "BOOLEAN", "bool")
        .when(s == "STRING", "string")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def compile_filter(node, doc: Column) -> Column:
    """A column that is true or false, never NULL."""
    if isinstance(node, Const):
        return F.lit(node.value)
    if isinstance(node, All | Any_):
        every = isinstance(node, All)
        parts = [compile_filter(p, doc) for p in node.parts]
        return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), parts) if parts else F.lit(every)
    return _field(node, doc)


def _field(node: Field, doc: Column) -> Column:
    v = get(doc, node.path)
    tests = [_test(v, t) for t in node.tests]
    empty = F.lit(not node.any_)
    here = reduce((lambda a, b: a | b) if node.any_ else (lambda a, b: a & b), tests) if tests else empty
    return F.when(v.isNull(), F.lit(node.missing)).otherwise(F.coalesce(here, F.lit(False)))


def _as(v: Column, t: str) -> Column:
    return F.try_variant_get(v, "$", t)


def equal(v: Column, operand) -> Column:
    k = kind(operand)
    if k == "null":
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    of = kind_of(v) == k
    if k == "number":
        return F.coalesce(of & (_as(v, "double") == F.lit(float(operand))), F.lit(False))
    if k in ("string", "bool"):
        return F.coalesce(of & (_as(v, "string" if k == "string" else "boolean") == F.lit(operand)), F.lit(False))
    # structures compare by canonical text: keys sorted, 1.0 the same as 1
    return F.coalesce(of & (F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(operand, ensure_ascii=False))))), F.lit(False))


def order(v: Column, operand, op: str) -> Column:
    k, loose = kind(operand), F.lit(op in ("$gte", "$lte"))
    if k not in ("number", "string", "bool"):
        return loose
    a = _as(v, {"number": "double", "string": "string", "bool": "boolean"}[k])
    b = F.lit(float(operand)) if k == "number" else F.lit(operand)
    holds = {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]
    return F.when(kind_of(v) == k, F.coalesce(holds, F.lit(False))).otherwise(loose)


def _test(v: Column, x: Test) -> Column:
    operand, op = x.value, x.op
    if op == "$exists":
        out = F.lit(operand if isinstance(operand, bool) else True)
    elif op in ("$eq", "$ne"):
        out = equal(v, operand)
    elif op in ("$in", "$nin"):
        out = reduce(lambda a, b: a | b, [equal(v, o) for o in operand], F.lit(False)) if isinstance(operand, list) else F.lit(False)
    else:
        out = order(v, operand, op)
    negate = (op in ("$ne", "$nin")) != x.negated
    return ~out if negate else out


def sort_keys(doc: Column, field: str, descending: bool = False) -> list[Column]:
    """Kind rank, then value: missing and null, bool, number, string, other."""
    v = get(doc, (field,))
    k = kind_of(v)
    rank = F.when(k == "bool", 1).when(k == "number", 2).when(k == "string", 3).when(k.isin("array", "object"), 4).otherwise(0)
    keys = [rank, F.when(k == "bool", _as(v, "boolean")), F.when(k == "number", _as(v, "double")), F.when(k == "string", _as(v, "string"))]
    return [x.desc() if descending else x.asc() for x in keys]
