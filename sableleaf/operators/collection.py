"""A collection of documents and its reads, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sableleaf.errors import IndexError_, NotFound
from sableleaf.plans import ast, typed, variant


@dataclass
class Collection:
    """Documents with a unique id column.

    Typed mode: any DataFrame; NULL is a missing field and filters reach the
    scan. Document mode: columns `_id`, `raw` (JSON text) and `doc` (VARIANT).
    """

    df: DataFrame
    id_col: str = "_id"
    doc_col: str | None = None
    layouts: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of_raw(cls, df: DataFrame, raw_col: str = "raw", id_col: str = "_id") -> Collection:
        """Document mode over JSON text; text that isn't JSON has no fields."""
        return cls(df.withColumn("doc", F.try_parse_json(raw_col)), id_col, "doc")

    # the three ways to ask -------------------------------------------------
    def predicate(self, filter_, strict: bool = False) -> Column:
        node = ast.parse(filter_, strict)
        if self.doc_col:
            return variant.compile_filter(node, F.col(self.doc_col))
        return typed.compile_filter(node, self.df.schema)

    def query(self, filter_, strict: bool = False) -> DataFrame:
        """Whole documents that match a JSON filter, in no order."""
        return self.df.filter(self.predicate(filter_, strict))

    def query_with(self, filter_, sort: str | None = None, descending: bool = False, offset: int = 0, limit: int | None = None, strict: bool = False) -> DataFrame:
        """`query`, sorted by a top-level field, from `offset`, at most `limit`.

        Missing and null come first (last if descending), then by kind and value,
        equal ones by id. Without a sort, offset and limit go by id.
        """
        out = self.query(filter_, strict)
        if sort is not None or offset or limit is not None:
            out = out.orderBy(*self._keys(sort, descending), F.col(self.id_col).asc())
        if offset:
            out = out.offset(offset)
        return out if limit is None else out.limit(limit)

    def _keys(self, sort: str | None, descending: bool) -> list[Column]:
        if sort is None:
            return []
        if self.doc_col:
            return variant.sort_keys(F.col(self.doc_col), sort, descending)
        if sort not in self.df.columns:
            return []
        c = F.col(f"`{sort}`")
        return [c.desc_nulls_last() if descending else c.asc_nulls_first()]

    def find(self, name: str, value) -> DataFrame:
        """Equality on a top-level field; the name is no path."""
        return self._single(name, "$eq", value)

    def find_range(self, name: str, low, high) -> DataFrame:
        """Between low and high, both included; a value of another kind is in every range."""
        return self.df.filter(self._leaf(name, (("$gte", low), ("$lte", high))))

    def find_where(self, name: str, predicate: Callable[[Column], Column]) -> DataFrame:
        """Documents where the field is present and the given column expression of it is true.

        In document mode the expression gets the field as VARIANT.
        """
        c = variant.get(F.col(self.doc_col), (name,)) if self.doc_col else typed.column(None, (name,))
        if not self.doc_col and name not in self.df.columns:
            return self.df.filter(F.lit(False))
        return self.df.filter(c.isNotNull() & predicate(c))

    def _single(self, name: str, op: str, value) -> DataFrame:
        return self.df.filter(self._leaf(name, ((op, value),)))

    def _leaf(self, name: str, tests) -> Column:
        node = ast.Field((name,), tuple(ast.Test(op, ast._text(v)) for op, v in tests))
        return variant.compile_filter(node, F.col(self.doc_col)) if self.doc_col else typed.compile_filter(node, self.df.schema)

    # by id, and the whole ---------------------------------------------------
    def get(self, id_) -> DataFrame:
        return self.df.filter(F.col(self.id_col) == F.lit(id_))

    def get_one(self, id_):
        rows = self.get(id_).take(1)
        if not rows:
            raise NotFound(str(id_))
        return rows[0]

    def contains(self, id_) -> bool:
        return not self.get(id_).select(F.lit(1)).limit(1).isEmpty()

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def ids(self) -> DataFrame:
        return self.df.select(self.id_col)

    def iter(self) -> DataFrame:
        return self.df

    # layouts: what an index is here; they never change a result -----------------
    def with_layout(self, name: str, ordered: bool = False, partitions: int | None = None) -> Collection:
        """Lay the data out by a field: hashed for equality, or in ranges that a
        file's min/max statistics can prune. One layout a field; the last counts."""
        n = [partitions] if partitions else []
        c = typed.column(None, (name,)) if not self.doc_col else F.to_json(variant.get(F.col(self.doc_col), (name,)))
        df = self.df.repartitionByRange(*n, c).sortWithinPartitions(c) if ordered else self.df.repartition(*n, c)
        return Collection(df, self.id_col, self.doc_col, self.layouts | {name: "btree" if ordered else "hash"})

    def has_layout(self, name: str) -> bool:
        return name in self.layouts

    def drop_layout(self, name: str) -> Collection:
        if name not in self.layouts:
            raise IndexError_(name)
        return Collection(self.df, self.id_col, self.doc_col, {k: v for k, v in self.layouts.items() if k != name})
