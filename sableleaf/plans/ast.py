"""JSON filter ASTs: from Python values to a small logical form.

The evaluator is two-valued. A field test holds in its own way where the field
is present, and has a fixed outcome where it is missing, so negation can be
pushed down to the tests (De Morgan).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from sableleaf.errors import InvalidArgument, SerializationError

OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists")


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any_:
    parts: tuple


@dataclass(frozen=True)
class Test:
    """One operator on a present field; `operand` is JSON text, so nodes stay hashable."""

    op: str
    operand: str
    negated: bool = False

    @property
    def value(self):
        return json.loads(self.operand)


@dataclass(frozen=True)
class Field:
    """Present: all tests hold (any, if `any_`). Missing: `missing`."""

    path: tuple[str, ...]
    tests: tuple[Test, ...]
    missing: bool = False
    any_: bool = False


def parse(ast, strict: bool = False):
    """The logical form of a filter. Total: a malformed AST matches nothing or
    everything, as its parts say; `strict` raises for what would be ignored."""
    if isinstance(ast, str) and strict:
        raise InvalidArgument("a filter is an object or an array")
    if isinstance(ast, list):
        return All(tuple(parse(x, strict) for x in ast))
    if not isinstance(ast, dict):
        return Const(False)
    for key, node in (("$and", All), ("$or", Any_)):
        if key in ast:
            if strict and len(ast) > 1:
                raise InvalidArgument(f"{key} hides its siblings")
            return node(tuple(parse(x, strict) for x in ast[key])) if isinstance(ast[key], list) else Const(False)
    if "$not" in ast:
        if strict and len(ast) > 1:
            raise InvalidArgument("$not hides its siblings")
        return negate(parse(ast["$not"], strict))
    return All(tuple(_field(k, v, strict) for k, v in ast.items()))


def _text(value) -> str:
    try:
        return json.dumps(value, ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError) as e:
        raise SerializationError(str(e)) from e


def _field(name: str, condition, strict: bool) -> Field:
    path = tuple(name.split("."))
    if not isinstance(condition, dict):
        return Field(path, (Test("$eq", _text(condition)),))
    if strict and (bad := [k for k in condition if k not in OPERATORS]):
        raise InvalidArgument(f"unknown operators {bad}")
    tests = tuple(Test(k, _text(v)) for k, v in condition.items() if k in OPERATORS)
    exists = condition.get("$exists", True)
    return Field(path, tests, missing="$exists" in condition and exists is False)


def negate(node):
    if isinstance(node, Const):
        return Const(not node.value)
    if isinstance(node, All):
        return Any_(tuple(map(negate, node.parts)))
    if isinstance(node, Any_):
        return All(tuple(map(negate, node.parts)))
    flipped = tuple(Test(t.op, t.operand, not t.negated) for t in node.tests)
    return Field(node.path, flipped, not node.missing, not node.any_)


def kind(value) -> str:
    """The JSON kind of a Python value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int | float):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"
