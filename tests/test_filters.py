"""Filters: golden cases, and compiled columns against a row evaluator on random documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sableleaf.errors import InvalidArgument, NotFound
from sableleaf.operators.collection import Collection
from sableleaf.plans import ast

BOATS = [("k1", "heron", 12, "moored", 7.5), ("k2", "tern", 31, "at sea", 22.0), ("k3", "gannet", 31, "at sea", 4.25), ("k4", "auk", 8, "sold", 60.0), ("k5", "skua", 19, "moored", 22.0), ("k6", "petrel", 44, "at sea", 13.0), ("k7", "fulmar", 5, "sold", 1.0)]
NAMES = ("_id", "name", "length", "state", "draught")

#: Filters of every form; what they match is worked out by the row evaluator below.
QUERIES = [
    {"name": {"$eq": "auk"}}, {"name": "tern"}, {"state": {"$ne": "sold"}}, {"draught": {"$gt": 13}}, {"length": {"$lt": 19}}, {"draught": {"$gte": 22}}, {"length": {"$lte": 12}},
    {"name": {"$in": ["auk", "skua", "none"]}}, {"name": {"$nin": ["auk", "heron"]}}, {"name": {"$exists": True}}, {"mast": {"$exists": True}}, {"mast": {"$exists": False}},
    {"$and": [{"state": "at sea"}, {"length": {"$gt": 31}}]}, {"$or": [{"name": "auk"}, {"length": 31}]}, {"$not": {"state": "moored"}}, {"$or": [{"$and": [{"state": "sold"}, {"draught": {"$lt": 2}}]}, {"name": "tern"}]},
    {}, {"state": "moored", "length": {"$gte": 15}}, 5, "x", None, [], {"$and": []}, {"$or": []}, {"$and": 3}, {"name": {}}, {"nope": {}}, {"$or": [{"name": "skua"}], "name": "auk"},
    {"length": {"$gte": "x"}}, {"length": {"$gt": "x"}}, {"length": {"$in": 3}}, {"length": {"$nin": 3}}, {"length": {"$gt": 18.5}}, {"length": 31.0}, {"length": 31.5}, {"$nor": [{"name": "x"}]}, {"name": {"$regex": "a"}},
    {"$not": {"nope": 1}}, {"$not": {"length": {"$exists": False}}},
]


@pytest.fixture(scope="module")
def boats(spark):
    df = spark.createDataFrame(BOATS, "_id string, name string, length long, state string, draught double")
    return Collection(df), Collection.of_raw(df.select("_id", F.to_json(F.struct("*")).alias("raw")))


def test_every_form(boats):
    docs = [dict(zip(NAMES, b, strict=True)) for b in BOATS]
    want = [sum(row_match(d, q) for d in docs) for q in QUERIES]
    assert len({*want}) > 5
    for c in boats:
        got = c.df.agg(*(F.count_if(F.coalesce(c.predicate(q), F.lit(False))).alias(f"n{i}") for i, q in enumerate(QUERIES))).first()
        assert list(got) == want


def test_sort_offset_limit(boats):
    names = lambda df: [json.loads(r["raw"])["name"] if "raw" in r else r["name"] for r in df.collect()]
    for c in boats:
        assert names(c.query_with({"state": "at sea"}, sort="draught", descending=True, offset=1, limit=1)) == ["petrel"]
        assert names(c.query_with({}, sort="length")) == ["fulmar", "auk", "heron", "skua", "tern", "gannet", "petrel"]
        assert names(c.query_with({}, limit=0)) == []


def test_single_fields(boats):
    for c in boats:
        assert c.find("state", "sold").count() == 2 and c.find("length", 31).count() == 2
        assert c.find_range("length", 8, 19).count() == 3
        assert c.contains("k1") and not c.contains("zz") and len(c) == 7 and not c.is_empty()
        with pytest.raises(NotFound):
            c.get_one("zz")
        assert c.with_layout("length", ordered=True).find("length", 31).count() == 2
    assert boats[0].find_where("draught", lambda s: s > 20).count() == 3


def test_time_columns(spark):
    """A literal that is no time equals no time and compares with none; a missing field matches no test."""
    df = spark.createDataFrame([(1, "2024-01-05 10:00:00"), (2, "2024-02-01 00:00:00"), (3, None)], "i int, t string").select("i", F.col("t").cast("timestamp_ntz").alias("ts"))
    c = Collection(df, "i")
    got = lambda q: sorted(r["i"] for r in c.query(q).collect())
    good, bad = "2024-02-01 00:00:00", "not a date"
    assert got({"ts": good}) == [2] and got({"ts": {"$ne": good}}) == [1] and got({"ts": {"$lt": good}}) == [1] and got({"ts": {"$in": [bad, good]}}) == [2]
    assert got({"ts": bad}) == [] and got({"ts": {"$ne": bad}}) == [1, 2] and got({"ts": {"$nin": [bad]}}) == [1, 2] and got({"$not": {"ts": bad}}) == [1, 2, 3]
    assert got({"ts": {"$gt": bad}}) == [] and got({"ts": {"$gte": bad}}) == [1, 2] and got({"$not": {"ts": {"$gt": bad}}}) == [1, 2, 3]


def test_strict():
    for bad in ({"a": {"$near": 1}}, {"$or": [], "a": 1}, {"$not": {}, "a": 1}):
        ast.parse(bad)
        with pytest.raises(InvalidArgument):
            ast.parse(bad, strict=True)


def test_pushdown_and_topk(spark):
    c = Collection(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey")
    plan = lambda df: df._jdf.queryExecution().toString()
    p = plan(c.query({"$and": [{"o_orderstatus": "F"}, {"$not": {"o_totalprice": {"$gte": 1000}}}]}))
    assert "EqualTo(o_orderstatus,F)" in p and "Or(IsNull(o_totalprice),LessThan(o_totalprice,1000.0))" in p
    assert "GreaterThan(o_orderkey,100)" in plan(c.query({"o_orderkey": {"$gt": 100}}))
    assert "TakeOrderedAndProject" in plan(c.query_with({}, sort="o_totalprice", descending=True, limit=10))


# a row evaluator, written from the semantics ---------------------------------------
def row_equal(a, b):
    ka, kb = ast.kind(a), ast.kind(b)
    if ka != kb:
        return False
    if ka == "number":
        return float(a) == float(b)
    if ka == "array":
        return len(a) == len(b) and all(row_equal(x, y) for x, y in zip(a, b, strict=True))
    if ka == "object":
        return a.keys() == b.keys() and all(row_equal(a[k], b[k]) for k in a)
    return a == b


def row_cmp(a, b):
    if ast.kind(a) != ast.kind(b) or ast.kind(a) not in ("number", "string", "bool"):
        return 0
    if isinstance(a, str):
        a, b = a.encode(), b.encode()
    elif ast.kind(a) == "number":  # compared as doubles, like equality
        a, b = float(a), float(b)
    return (a > b) - (a < b)


def row_test(v, op, x):
    if op == "$exists":
        return x if isinstance(x, bool) else True
    if op in ("$in", "$nin"):
        hit = isinstance(x, list) and any(row_equal(v, y) for y in x)
        return hit if op == "$in" else not hit
    checks = {"$eq": lambda: row_equal(v, x), "$ne": lambda: not row_equal(v, x), "$gt": lambda: row_cmp(v, x) > 0, "$gte": lambda: row_cmp(v, x) >= 0, "$lt": lambda: row_cmp(v, x) < 0, "$lte": lambda: row_cmp(v, x) <= 0}
    return checks.get(op, lambda: True)()


MISSING = object()


def row_match(doc, q):
    if isinstance(q, list):
        return all(row_match(doc, x) for x in q)
    if not isinstance(q, dict):
        return False
    if "$and" in q:
        return isinstance(q["$and"], list) and all(row_match(doc, x) for x in q["$and"])
    if "$or" in q:
        return isinstance(q["$or"], list) and any(row_match(doc, x) for x in q["$or"])
    if "$not" in q:
        return not row_match(doc, q["$not"])
    for name, cond in q.items():
        v = doc
        for part in name.split("."):
            v = v.get(part, MISSING) if isinstance(v, dict) else MISSING
        if v is MISSING:
            if not (isinstance(cond, dict) and "$exists" in cond and cond["$exists"] is False):
                return False
        elif isinstance(cond, dict):
            if not all(row_test(v, op, x) for op, x in cond.items()):
                return False
        elif not row_equal(v, cond):
            return False
    return True


VALUES = [None, True, False, 0, 1, 1.0, 2.5, -3, 9007199254740992, 9007199254740993, "", "a", "b", "1", "é", [], [1], ["a", None], {}, {"x": 1}, {"x": {"y": "a"}}]


def random_query(r, depth=0):
    k = r.random()
    if depth < 3 and k < 0.35:
        op = r.choice(["$and", "$or"])
        return {op: [random_query(r, depth + 1) for _ in range(r.randint(0, 3))]} | ({"a": 1} if r.random() < 0.1 else {})
    if depth < 3 and k < 0.5:
        return {"$not": random_query(r, depth + 1)}
    if k < 0.53:
        return r.choice([5, "x", None, [], {}, [{"a": 1}]])
    out = {}
    for _ in range(r.randint(1, 2)):
        name = r.choice(["a", "b", "c.x", "c.x.y", "c.0", "d"])
        if r.random() < 0.3:
            out[name] = r.choice([v for v in VALUES if not isinstance(v, dict)])
        else:
            out[name] = {o: [r.choice(VALUES) for _ in range(r.randint(0, 3))] if o in ("$in", "$nin") and r.random() < 0.9 else r.choice(VALUES) for o in r.sample(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$odd"], r.randint(0, 2))}
    return out


def test_document_mode_against_rows(spark):
    r = random.Random(5)
    docs = [{k: r.choice(VALUES) for k in ("a", "b", "c", "d") if r.random() < 0.8} for _ in range(150)]
    c = Collection.of_raw(spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "_id string, raw string"))
    queries = [random_query(r) for _ in range(60)]
    for lo in range(0, len(queries), 20):
        part = queries[lo : lo + 20]
        got = c.df.select(F.col("_id").cast("int").alias("i"), *(c.predicate(q).alias(f"q{k}") for k, q in enumerate(part))).orderBy("i").collect()
        for k, q in enumerate(part):
            assert [row[f"q{k}"] for row in got] == [row_match(d, q) for d in docs], q


def test_typed_mode_against_rows(spark):
    r = random.Random(6)
    rows = [(str(i), r.choice([None, 0, 1, 2, -3, 9007199254740993]), r.choice([None, "", "a", "b", "1"]), r.choice([None, (1,), (None,)]), r.choice([None, 0.0, 1.0, 2.5])) for i in range(120)]
    c = Collection(spark.createDataFrame(rows, "_id string, a long, b string, c struct<x: long>, d double"))
    docs = [{k: v for k, v in {"a": a, "b": b, "c": None if x is None else {k: v for k, v in {"x": x[0]}.items() if v is not None}, "d": d}.items() if v is not None} for _, a, b, x, d in rows]
    names = {"c.x.y", "c.0"}
    queries = []
    while len(queries) < 60:
        q = random_query(r)
        if not any(n in json.dumps(q) for n in ('"c.0"', "{}")):
            queries.append(q)
    assert names
    for lo in range(0, len(queries), 20):
        part = queries[lo : lo + 20]
        got = c.df.select(F.col("_id").cast("int").alias("i"), *(F.coalesce(c.predicate(q), F.lit(False)).alias(f"q{k}") for k, q in enumerate(part))).orderBy("i").collect()
        for k, q in enumerate(part):
            assert [row[f"q{k}"] for row in got] == [row_match(d, q) for d in docs], q
