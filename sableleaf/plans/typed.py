"""Filters over typed columns, in forms that reach the parquet scan.

SQL NULL means that the field is missing. Leaves aren't wrapped: in a filter a
NULL counts as false, and a negated leaf spells out `IS NULL OR ..`.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ast import All, Any_, Const, Field, Test, kind

#: From here on not every whole number is a double.
EXACT = 1 << 53
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)
_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def resolve(schema: T.StructType, path: tuple[str, ...]) -> T.DataType | None:
    """Type of a dotted path through structs, or None if there is no such field."""
    at: T.DataType = schema
    for p in path:
        if not isinstance(at, T.StructType) or p not in at.fieldNames():
            return None
        at = at[p].dataType
    return at


def column(df: DataFrame | None, path: tuple[str, ...]) -> Column:
    c = F.col("`" + path[0].replace("`", "``") + "`")
    for p in path[1:]:
        c = c.getField(p)
    return c


def column_kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, _WHOLE + _REAL):
        return "number"
    if isinstance(t, T.StringType | T.VarcharType | T.CharType) or isinstance(t, _TIME):
        return "string"
    return "array" if isinstance(t, T.ArrayType) else "object"


def compile_filter(node, schema: T.StructType) -> Column:
    """A filter-safe column; as a value wrap it once in coalesce(.., false)."""
    if isinstance(node, Const):
        return F.lit(node.value)
    if isinstance(node, All | Any_):
        return _fold([compile_filter(p, schema) for p in node.parts], isinstance(node, All))
    return _field(node, schema)


def _fold(parts: list[Column], every: bool) -> Column:
    if not parts:
        return F.lit(every)
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), parts)


def _field(node: Field, schema: T.StructType) -> Column:
    t = resolve(schema, node.path)
    if t is None:
        return F.lit(node.missing)
    c = column(None, node.path)
    tests = [_test(c, t, x) for x in node.tests]
    if node.any_:
        tests = [x for x in tests if x is not False]
        if any(x is True for x in tests):
            here = True
        else:
            here = _fold(tests, False) if tests else False
    else:
        tests = [x for x in tests if x is not True]
        if any(x is False for x in tests):
            here = False
        else:
            here = _fold(tests, True) if tests else True
    if here is True:
        return F.lit(True) if node.missing else c.isNotNull()
    if here is False:
        return c.isNull() if node.missing else F.lit(False)
    return (c.isNull() | here) if node.missing else here


def _test(c: Column, t: T.DataType, x: Test):
    """Where the field is present: a column, or True or False if that is known. NULL if it is missing."""
    v, op = x.value, x.op
    flip = {True: False, False: True}
    if op == "$exists":
        out = v if isinstance(v, bool) else True
        return flip[out] if x.negated else out
    if op in ("$in", "$nin"):
        if not isinstance(v, list):
            out = op == "$nin"
            return flip[out] if x.negated else out
        out = _one_of(c, t, v)
        negate = (op == "$nin") != x.negated
        return (flip[out] if isinstance(out, bool) else ~out) if negate else out
    if op in ("$eq", "$ne"):
        out = _equal(c, t, v)
        negate = (op == "$ne") != x.negated
        return (flip[out] if isinstance(out, bool) else ~out) if negate else out
    out = _order(c, t, v, op)
    if isinstance(out, bool):
        return flip[out] if x.negated else out
    return ~out if x.negated else out


def _same_kind(t: T.DataType, v) -> bool:
    return kind(v) == column_kind(t)


def _json(v) -> str:
    return json.dumps(v, ensure_ascii=False)


def _literal(t: T.DataType, v) -> Column:
    if isinstance(t, _TIME):
        return F.lit(v).try_cast(t)
    if isinstance(t, T.DoubleType | T.FloatType) or isinstance(v, float):
        return F.lit(float(v))
    return F.lit(v)


def _number(c: Column, t: T.DataType, v):
    """Column and literal to compare as doubles would be; a whole literal keeps the column's type."""
    if isinstance(t, _WHOLE) and abs(v) < EXACT and float(v).is_integer():
        return c, F.lit(int(v))
    if isinstance(t, T.DoubleType):
        return c, F.lit(float(v))
    return c.cast("double"), F.lit(float(v))


def _equal(c: Column, t: T.DataType, v):
    if not _same_kind(t, v):
        return False
    if kind(v) == "number":
        if isinstance(t, _WHOLE) and not float(v).is_integer():
            return False
        a, b = _number(c, t, v)
        return a == b
    if kind(v) in ("array", "object"):
        return F.to_json(F.call_function("to_variant_object", c)) == F.to_json(F.parse_json(F.lit(_json(v))))
    return _timed(c, t, _literal(t, v), lambda x: c == x, False)


def _timed(c: Column, t: T.DataType, x: Column, test, otherwise: bool) -> Column:
    """A test against a literal; one that is no time, where the column is, has a fixed outcome.

    The literal is constant, so the plan keeps one of the two only.
    """
    if not isinstance(t, _TIME):
        return test(x)
    return F.when(x.isNull(), F.when(c.isNotNull(), F.lit(otherwise))).otherwise(test(x))


def _one_of(c: Column, t: T.DataType, values: list):
    own = [v for v in values if _same_kind(t, v)]
    if kind(own[0] if own else None) in ("string", "bool") and not isinstance(t, _TIME):
        return c.isin(*own)
    if own and isinstance(t, _WHOLE) and all(abs(v) < EXACT for v in own):
        whole = [int(v) for v in own if float(v).is_integer()]
        return c.isin(*whole) if whole else False
    if own and isinstance(t, T.DoubleType):
        return c.isin(*map(float, own))
    parts = [x for v in own if (x := _equal(c, t, v)) is not False]
    return _fold(parts, False) if parts else False


def _order(c: Column, t: T.DataType, v, op: str):
    if not _same_kind(t, v) or kind(v) in ("array", "object", "null"):
        return op in ("$gte", "$lte")  # kinds that don't compare count as equal
    if kind(v) == "number" and isinstance(t, _WHOLE) and abs(v) < EXACT and not float(v).is_integer():
        low, high = math.floor(v), math.ceil(v)
        return c >= F.lit(high) if op in ("$gt", "$gte") else c <= F.lit(low)
    a, b = _number(c, t, v) if kind(v) == "number" else (c, _literal(t, v))
    tests = {"$gt": a.__gt__, "$gte": a.__ge__, "$lt": a.__lt__, "$lte": a.__le__}
    return _timed(c, t, b, tests[op], op in ("$gte", "$lte"))
