"""The engine's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sableleaf.functions import refs
from sableleaf.operators import maintenance
from sableleaf.operators.collection import Collection
from sableleaf.operators.replay import bases, effective_patches, replay, replay_entries
from sableleaf.sources import buckets, log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The keys of the tables used as collections.
KEYS = {"events": "event_id", "orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey", "part": "p_partkey", "nation": "n_nationkey"}
TRASH_CUTOFF = "2024-01-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str, name: str) -> Collection:
    return Collection(table(spark, sf_dir, name), KEYS[name])


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _filter(name: str, of: str, ast, where: str) -> None:
    _add(name, lambda s, d: collection(s, d, of).query(ast), f"select * from {of} where {where}")


# filters ------------------------------------------------------------------------
_filter("q_implicit_eq", "events", {"event_type": "purchase"}, "event_type = 'purchase'")
_filter("q_eq", "events", {"event_type": {"$eq": "purchase"}}, "event_type = 'purchase'")
_filter("q_ne", "events", {"event_type": {"$ne": "purchase"}}, "event_type <> 'purchase'")
_filter("q_gt", "lineitem", {"l_quantity": {"$gt": 45}}, "l_quantity > 45")
_filter("q_gte", "lineitem", {"l_extendedprice": {"$gte": 90000}}, "l_extendedprice >= 90000")
_filter("q_lt", "lineitem", {"l_orderkey": {"$lt": 500.5}}, "l_orderkey < 500.5")
_filter("q_lte", "lineitem", {"l_linenumber": {"$lte": 1}}, "l_linenumber <= 1")
_filter("q_gte_other_kind", "orders", {"o_orderstatus": {"$gte": 5}}, "true")
_filter("q_in", "orders", {"o_orderstatus": {"$in": ["F", "P", 3, None]}}, "o_orderstatus in ('F', 'P')")
_filter("q_nin", "orders", {"o_orderstatus": {"$nin": ["F", "P"]}}, "o_orderstatus not in ('F', 'P')")
_filter("q_exists_true", "events", {"value": {"$exists": True}}, "value is not null")
_filter("q_exists_false", "events", {"nope": {"$exists": False}}, "true")
_filter("q_unknown_op", "events", {"event_type": {"$near": 3}}, "event_type is not null")
_filter("q_multi_op", "events", {"value": {"$gte": 50, "$lt": 60}}, "value >= 50 and value < 60")
_filter("q_implicit_and", "events", {"event_type": "click", "user_id": {"$lte": 20}}, "event_type = 'click' and user_id <= 20")
_filter("q_and", "orders", {"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 200000}}]}, "o_orderstatus = 'F' and o_totalprice > 200000")
_filter("q_or", "orders", {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$lt": 5000}}]}, "o_orderstatus = 'P' or o_totalprice < 5000")
_filter("q_not", "orders", {"$not": {"o_orderstatus": "F", "o_totalprice": {"$gte": 100000}}}, "not (o_orderstatus = 'F' and o_totalprice >= 100000)")
_filter("q_top_array", "orders", [{"o_orderstatus": "F"}, {"o_orderpriority": {"$ne": "1-URGENT"}}], "o_orderstatus = 'F' and o_orderpriority <> '1-URGENT'")
_filter("q_all", "events", {}, "true")
_filter("q_scalar_ast", "events", 5, "false")
_filter("q_combinator_shadow", "orders", {"$or": [{"o_orderstatus": "P"}], "o_totalprice": {"$lt": 0}}, "o_orderstatus = 'P'")
_filter(
    "q_nested",
    "orders",
    {"$or": [{"$and": [{"o_orderstatus": "F"}, {"$not": {"o_totalprice": {"$lt": 300000}}}]}, {"$not": {"$or": [{"o_orderstatus": {"$in": ["F", "O"]}}, {"o_totalprice": {"$lte": 250000}}]}}]},
    "(o_orderstatus = 'F' and not o_totalprice < 300000) or not (o_orderstatus in ('F', 'O') or o_totalprice <= 250000)",
)
_filter("q_time_range", "events", {"ts": {"$gte": "2024-01-10 00:00:00", "$lt": "2024-01-11 00:00:00"}}, "ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-11'")


def props(spark: SparkSession, sf_dir: str) -> Collection:
    """events in document mode: `props` nested in the document."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("_id"), F.concat(F.lit('{"type":"'), "event_type", F.lit('","props":'), "props", F.lit("}")).alias("raw"))
    return Collection.of_raw(e)


_add("q_dot_path", lambda s, d: props(s, d).query({"props.k": {"$gte": 90}, "type": {"$ne": "view"}}).select("_id", "raw"), """select cast(event_id as varchar) as _id, '{"type":"' || event_type || '","props":' || props || '}' as raw from events where cast(json_extract(props, '$.k') as bigint) >= 90 and event_type <> 'view'""")
_add("q_doc_sort", lambda s, d: props(s, d).query_with({"props.k": {"$in": [1, 2, "3"]}}, sort="type", descending=True, limit=20).select("_id"), "select cast(event_id as varchar) as _id from events where cast(json_extract(props, '$.k') as bigint) in (1, 2) order by event_type desc, cast(event_id as varchar) limit 20")

# single fields --------------------------------------------------------------------
_add("find_eq", lambda s, d: collection(s, d, "events").find("event_type", "signup"), "select * from events where event_type = 'signup'")
_add("find_indexed", lambda s, d: collection(s, d, "events").with_layout("event_type").find("event_type", "signup"), "select * from events where event_type = 'signup'")
_add("find_num", lambda s, d: collection(s, d, "part").find("p_size", 10), "select * from part where p_size = 10")
_add("find_range", lambda s, d: collection(s, d, "events").find_range("value", 20, 40), "select * from events where value between 20 and 40")
_add("find_range_indexed", lambda s, d: collection(s, d, "events").with_layout("value", ordered=True).find_range("value", 20, 40), "select * from events where value between 20 and 40")
_add("find_where", lambda s, d: collection(s, d, "lineitem").find_where("l_extendedprice", lambda c: F.pmod(F.floor(c), F.lit(100)) == 7), "select * from lineitem where floor(l_extendedprice) % 100 = 7")
_add("get_by_id", lambda s, d: collection(s, d, "customer").get(42), "select * from customer where c_custkey = 42")
_add("contains_id", lambda s, d: collection(s, d, "customer").get(42).agg((F.count("*") > 0).alias("found")), "select count(*) > 0 as found from customer where c_custkey = 42")
_add("len_count", lambda s, d: collection(s, d, "lineitem").iter().agg(F.count("*").alias("n")), "select count(*) as n from lineitem")
_add("all_ids", lambda s, d: collection(s, d, "orders").ids(), "select o_orderkey from orders")
_add("iter_all", lambda s, d: collection(s, d, "nation").iter(), "select * from nation")


def _sorted(name: str, sql_order: str, ast=None, where: str = "true", **options) -> None:
    limit = f" limit {options['limit']}" if "limit" in options else ""
    offset = f" offset {options['offset']}" if "offset" in options else ""
    _add(name, lambda s, d: collection(s, d, "orders").query_with(ast or {}, **options), f"select * from orders where {where} order by {sql_order}{limit}{offset}")


_sorted("sort_asc", "o_totalprice, o_orderkey", {"o_orderstatus": "P"}, "o_orderstatus = 'P'", sort="o_totalprice")
_sorted("sort_desc", "o_totalprice desc, o_orderkey", {"o_orderstatus": "P"}, "o_orderstatus = 'P'", sort="o_totalprice", descending=True)
_sorted("sort_limit", "o_orderstatus, o_orderkey", sort="o_orderstatus", limit=25)
_sorted("page_offset", "o_totalprice desc, o_orderkey", sort="o_totalprice", descending=True, offset=40, limit=20)
_sorted("topk", "o_totalprice desc, o_orderkey", {"o_orderstatus": {"$ne": "P"}}, "o_orderstatus <> 'P'", sort="o_totalprice", descending=True, limit=10)


# the log ----------------------------------------------------------------------------
def corrupt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as JSON lines, every 97th cut short."""
    log.configure(spark)
    e = table(spark, sf_dir, "events")
    whole = F.to_json(F.struct(F.col("event_id").cast("string").alias("_id"), "event_type", "value"))
    return e.select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 97 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("value"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of users: a view is a whole document, a click sets value, a
    purchase pushes onto amounts, a signup removes value, an error is a tombstone."""
    log.configure(spark)
    e = table(spark, sf_dir, "events")
    id_ = F.col("user_id").cast("string").alias("_id")
    op = lambda name, *fields: F.to_json(F.struct(id_, F.lit(name).alias("_op"), *fields))
    value: Column = (
        F.when(F.col("event_type") == "view", F.to_json(F.struct(id_, "value", F.lit("view").alias("kind"))))
        .when(F.col("event_type") == "click", op("set", F.lit("value").alias("path"), "value"))
        .when(F.col("event_type") == "purchase", op("array_push", F.lit("amounts").alias("field"), "value"))
        .when(F.col("event_type") == "signup", op("remove", F.lit("value").alias("path")))
        .otherwise(F.to_json(F.struct(id_, F.lit(1).alias("_deleted"))))
    )
    return e.select(F.col("event_id").alias("pos"), value.alias("value"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(event_log(spark, sf_dir))[0].withColumn("doc", F.try_parse_json("raw"))


def _double(path: str) -> Column:
    return F.try_variant_get("doc", path, "double")


_BASE = """base as (select cast(user_id as varchar) as _id, max(event_id) as bp, arg_max(event_type, event_id) as kind, arg_max(value, event_id) as v
from events where event_type in ('view', 'error') group by user_id),
p as (select e.event_id, b._id, e.event_type, e.value from events e join base b on cast(e.user_id as varchar) = b._id where b.kind = 'view' and e.event_id > b.bp),
fin as (select b._id, coalesce(arg_max(struct_pack(t := p.event_type, v := p.value), p.event_id) filter (p.event_type in ('click', 'signup')), struct_pack(t := 'view', v := b.v)) as f from base b left join p using (_id) where b.kind = 'view' group by b._id, b.v)"""

_add("log_scan_valid", lambda s, d: log.classify(corrupt_lines(s, d)).select(F.col("pos").alias("event_id"), "_id", "kind"), "select event_id, cast(event_id as varchar) as _id, 'doc' as kind from events where event_id % 97 <> 0")
_add("log_corrupt_count", lambda s, d: log.corrupt_count(corrupt_lines(s, d)), "select count(*) as n_corrupt from events where event_id % 97 = 0")
_add("recover_valid", lambda s, d: log.valid(corrupt_lines(s, d)).select(F.col("pos").alias("event_id")), "select event_id from events where event_id % 97 <> 0")
_add("info_stats", lambda s, d: maintenance.statistics(corrupt_lines(s, d), replay(corrupt_lines(s, d))[0]).select("n_lines", "n_corrupt", "n_docs"), "select count(*) as n_lines, count(*) filter (event_id % 97 = 0) as n_corrupt, count(*) filter (event_id % 97 <> 0) as n_docs from events")
_add("replay_lww", lambda s, d: bases(log.classify(event_log(s, d))).select("_id", "kind", "base_pos"), "select cast(user_id as varchar) as _id, case arg_max(event_type, event_id) when 'view' then 'doc' else 'tombstone' end as kind, max(event_id) as base_pos from events where event_type in ('view', 'error') group by user_id")
_add("replay_deleted_ids", lambda s, d: replay(event_log(s, d))[1], "select cast(user_id as varchar) as _id from events where event_type in ('view', 'error') group by user_id having arg_max(event_type, event_id) = 'error'")
_add("replay_patch_scope", lambda s, d: effective_patches(log.classify(event_log(s, d)), bases(log.classify(event_log(s, d)))).select("_id", F.col("pos").alias("event_id")), f"with {_BASE} select _id, event_id from p")
_add(
    "replay_array_push",
    lambda s, d: live(s, d).select("_id", F.posexplode(F.try_variant_get("doc", "$.amounts", "array<double>")).alias("i", "amount")),
    f"with {_BASE} select _id, cast(row_number() over (partition by _id order by event_id) - 1 as integer) as i, value as amount from p where event_type = 'purchase'",
)
_add("replay_set_last", lambda s, d: live(s, d).select("_id", _double("$.value").alias("value")), f"with {_BASE} select _id, case when f.t = 'signup' then null else f.v end as value from fin")
_add("replay_remove", lambda s, d: Collection(live(s, d), "_id", "doc").query({"value": {"$exists": False}}).select("_id"), f"with {_BASE} select _id from fin where f.t = 'signup'")


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of the compacted log: what a replay of the log itself gives."""
    base = replay(event_log(spark, sf_dir))[0].select(F.lit(0).cast("long").alias("pos"), "_id", F.lit("doc").alias("kind"), "raw")
    docs = replay_entries(base)[0].withColumn("doc", F.try_parse_json("raw"))
    return docs.select("_id", _double("$.value").alias("value"), F.coalesce(F.size(F.try_variant_get("doc", "$.amounts", "array<double>")), F.lit(0)).cast("long").alias("n_amounts"))


_add("compact_equiv", compacted, f"with {_BASE}, n as (select _id, count(*) as n from p where event_type = 'purchase' group by _id) select _id, case when f.t = 'signup' then null else f.v end as value, coalesce(n.n, 0) as n_amounts from fin left join n using (_id)")


def trash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    log.configure(spark)
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("pos"), F.to_json(F.struct(F.col("user_id").cast("string").alias("_id"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("_deleted"))).alias("value"))


_add("restore_latest", lambda s, d: maintenance.latest(maintenance.trash_entries(trash_lines(s, d))).select("_id", F.try_variant_get(F.try_parse_json("raw"), "$.event_id", "bigint").alias("event_id")), "select cast(user_id as varchar) as _id, max(event_id) as event_id from events where event_type = 'error' group by user_id")
_add("trash_ttl_purge", lambda s, d: maintenance.keep_after(maintenance.trash_entries(trash_lines(s, d)), 1705276800).select(F.col("pos").alias("event_id"), "_id"), f"select event_id, cast(user_id as varchar) as _id from events where event_type = 'error' and epoch(date_trunc('second', ts)) > epoch(timestamp '{TRASH_CUTOFF}')")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.lit("base").alias("side"), "o_totalprice", (F.col("o_custkey") % 5).alias("_modified"))
    b = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("other").alias("side"), "o_totalprice", F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey") % 7).alias("_modified"))
    return maintenance.merge(a, b, id_col="o_orderkey")


_add(
    "merge_lww",
    merged,
    """with u as (select o_orderkey, 'base' as side, o_totalprice, o_custkey % 5 as _modified, 0 as k from orders where o_orderkey % 3 <> 0
union all select o_orderkey, 'other', o_totalprice, case when o_custkey % 11 <> 0 then o_custkey % 7 end, 1 from orders where o_orderkey % 2 = 0)
select o_orderkey, side, o_totalprice, _modified from u qualify row_number() over (partition by o_orderkey order by coalesce(_modified, 0) desc, k desc) = 1""",
)


# files and references --------------------------------------------------------------------
def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("bucket"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("type"))


def holders(spark: SparkSession, sf_dir: str, labelled: bool = False) -> DataFrame:
    """Documents that hold a reference to their text's file, as a string or as a `_file` object."""
    d = table(spark, sf_dir, "documents")
    if labelled:
        d = d.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    id_, hash_ = F.col("doc_id").cast("string").alias("_id"), F.substring(F.sha2("text", 256), 1, 8)
    text = F.to_json(F.struct(id_, F.struct(F.array(F.concat("source", F.lit(":"), hash_, F.lit(".txt"))).alias("files")).alias("a")))
    form = F.to_json(F.struct(id_, F.struct(F.struct(F.col("source").alias("bucket"), hash_.alias("id"), F.lit("txt").alias("ext")).alias("_file")).alias("a")))
    return d.select(id_, F.when(F.col("doc_id") % 2 == 0, text).otherwise(form).alias("raw"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.describe(blobs(spark, sf_dir)).select(F.concat("bucket", F.lit(":"), "id", F.lit("."), "ext").alias("ref")).distinct()


_REF = "source || ':' || substr(sha256(text), 1, 8) || '.txt'"
_LABELLED = "doc_id in (select doc_id from labels where quality = 1)"
_add("bucket_store_meta", lambda s, d: buckets.describe(blobs(s, d)).select("bucket", "name", "id", "ext", "size", "type"), "select source as bucket, cast(doc_id as varchar) || '.txt' as name, substr(sha256(text), 1, 8) as id, 'txt' as ext, cast(strlen(text) as bigint) as size, 'text/plain' as type from documents")
_add("bucket_dedup", lambda s, d: buckets.deduplicate(blobs(s, d)).select("bucket", "id", "name"), "select source as bucket, substr(sha256(text), 1, 8) as id, min(cast(doc_id as varchar) || '.txt') as name from documents group by source, sha256(text)")
_add("refs_extract", lambda s, d: refs.extract(holders(s, d)).select("_id", F.explode("refs").alias("ref")), f"select cast(doc_id as varchar) as _id, {_REF} as ref from documents")
_add("refs_count", lambda s, d: refs.counts(refs.extract(holders(s, d))), f"select {_REF} as ref, count(*) as n_docs from documents group by 1")
_add("refs_delta", lambda s, d: refs.delta(refs.extract(holders(s, d)), refs.extract(holders(s, d, True))).select("_id", F.size("added").alias("n_added"), F.array_join("dropped", ",").alias("dropped")), f"select cast(doc_id as varchar) as _id, cast(0 as integer) as n_added, {_REF} as dropped from documents where not {_LABELLED}")
_add("ref_parse", lambda s, d: stored(s, d).select("ref", *refs.parse(F.col("ref"))), f"select distinct {_REF} as ref, source as bucket, substr(sha256(text), 1, 8) as id, 'txt' as ext from documents")
_add("release_check", lambda s, d: stored(s, d).join(refs.extract(holders(s, d, True)).select(F.explode("refs").alias("ref")).distinct().withColumn("held", F.lit(True)), "ref", "left").select("ref", F.col("held").isNull().alias("releasable")), f"select {_REF} as ref, not bool_or({_LABELLED}) as releasable from documents group by 1")
_add("gc_orphans", lambda s, d: refs.orphans(stored(s, d), refs.extract(holders(s, d, True))), f"select {_REF} as ref from documents group by 1 having not bool_or({_LABELLED})")
_add("verify_dangling", lambda s, d: refs.dangling(refs.extract(holders(s, d)), stored(s, d).where("ref rlike '[0-7][.]txt$'")), f"select cast(doc_id as varchar) as _id, {_REF} as ref from documents where substr(sha256(text), 8, 1) not in ('0', '1', '2', '3', '4', '5', '6', '7')")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest purchases of 100 and more."""
    return collection(spark, sf_dir, "events").query_with({"$and": [{"event_type": "purchase"}, {"value": {"$gte": 100}}]}, sort="value", descending=True, limit=20)


_add("flagship", flagship, "select * from events where event_type = 'purchase' and value >= 100 order by value desc, event_id limit 20")
