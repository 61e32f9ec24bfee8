"""Sharding by Karmarkar-Karp differencing of indivisible groups."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, staged

#: Groups that are differenced at once, about.
BUCKET_GROUPS = 2_000
#: Partial partitions that are differenced at once, in turn.
FAN = 1_000
#: Rows of a shard that are numbered at once, about.
BLOCK_ROWS = 20_000


def difference(parts: list[list[tuple[int, object]]]) -> list[tuple[int, object]]:
    """Karmarkar-Karp: combine the two partial partitions of largest spread, oppositely ordered, until one is left.

    A partial partition is a list of k (sum, members); members are None, a list of leaves, or a pair of members.
    Returns the last partition, largest sum first.
    """
    heap = []
    for n, p in enumerate(parts):
        p = sorted(p, key=lambda x: -x[0])
        heap.append((p[-1][0] - p[0][0], n, p))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted(((x + y, (s, t) if s is not None and t is not None else s if t is None else t) for (x, s), (y, t) in zip(a, reversed(b), strict=True)), key=lambda x: -x[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], n, both))
        n += 1
    return heap[0][2] if heap else []


def members(tree) -> list:
    """All leaves of some members."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            out += x
        elif x is not None:
            todo.extend(x)
    return out


def assign(sizes: list[int], shards: int) -> list[int]:
    """The shard of each of some sizes."""
    out = [0] * len(sizes)
    for k, (_, tree) in enumerate(difference([[(s, [i]), *[(0, None)] * (shards - 1)] for i, s in enumerate(sizes)])):
        for i in members(tree):
            out[i] = k
    return out


def shards(docs: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put documents into n shards of near equal bytes; equal texts stay together.

    Returns (doc_id, size, text_crc32, shard, slot): size is the UTF-8 bytes of
    the text plus 1 (a null text: 1), slot numbers a shard's rows from 0 without
    gaps. The result depends on the rows and on n alone, not on the cluster.

    Groups of equal texts are dealt by digest to buckets of BUCKET_GROUPS or so
    and differenced there into one partial partition of n sums each. FAN of these
    are differenced into one in turn, all by tasks, until one is left; the way
    back from its shards to the groups is a join for each turn. A group is never
    split, so one of more than 1/n of all bytes makes its shard that large; null
    texts are one group. Slots are counted by block of a shard, so no task numbers
    a whole shard. Repeated ids are rows like others; an empty table gives an
    empty one; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("g"))
    with Scratch(docs.sparkSession) as tmp:
        d = tmp.staged(d, "sizes")
        groups = tmp.staged(d.groupBy("g").agg(F.sum("size").alias("bytes")), "groups")
        buckets = max(1, -(-groups.count() // BUCKET_GROUPS))
        groups = groups.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))

        def first(group: pa.Table) -> pa.Table:
            group = group.sort_by("g")
            part = assign(group.column("bytes").to_pylist(), n)
            return pa.table([group.column("g"), group.column("bucket"), pa.array(part, pa.int32()), group.column("bytes")], names=["g", "bucket", "part", "bytes"])

        def again(group: pa.Table) -> pa.Table:
            sums: dict[int, list] = {}
            for b, p, size in zip(*(group.column(c).to_pylist() for c in ("bucket", "part", "bytes")), strict=True):
                sums.setdefault(b, [(0, None)] * n)[p] = (size, (b, p))
            last = difference([[(size, [leaf] if leaf else None) for size, leaf in sums[b]] for b in sorted(sums)])
            rows = [(b, p, b // FAN, k) for k, (_, tree) in enumerate(last) for b, p in members(tree)]
            return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["bucket", "part", "above", "shard"])

        local = tmp.staged(groups.groupBy("bucket").applyInArrow(first, "g string, bucket long, part int, bytes long"), "local")
        parts = tmp.staged(local.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")), "parts")
        turns = []
        while buckets > 1:
            up = tmp.staged(parts.groupBy(F.floor(F.col("bucket") / FAN).alias("above")).applyInArrow(again, "bucket long, part int, above long, shard int"), "turn")
            turns.append(up)
            parts = tmp.staged(parts.join(up, ["bucket", "part"]).groupBy(F.col("above").alias("bucket"), F.col("shard").alias("part")).agg(F.sum("bytes").alias("bytes")), "parts")
            buckets = -(-buckets // FAN)
        of = local.select("g", "bucket", F.col("part").alias("shard"))
        for up in turns:
            up = up.select("bucket", F.col("part").alias("shard"), "above", F.col("shard").alias("next"))
            of = of.join(up, ["bucket", "shard"]).select("g", F.col("above").alias("bucket"), F.col("next").alias("shard"))
        # written, so that Spark can split a hot text in the join
        d = tmp.staged(d.join(tmp.staged(of.select("g", "shard"), "shard_of"), "g"), "sharded")

        blocks = max(1, -(-d.count() // (n * BLOCK_ROWS)))
        d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "g"), F.lit(blocks)).cast("int"))
        count = d.groupBy("shard", "block").agg(F.count("*").alias("c"))
        base = count.withColumn("base", F.sum("c").over(W.partitionBy("shard").orderBy("block")) - F.col("c")).drop("c")
        d = d.withColumn("k", F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "g")) - 1)
        out = d.join(tmp.staged(base, "base"), ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("k")).alias("slot"))
        return staged(out, "shards")


def write_shards(docs: DataFrame, path: str, n: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents by shard: folders shard=0 to shard=n-1, rows with their slot.

    Rows are matched to their shard by id and text, so rows that repeat both are
    written as often as they occur, with one of their slots each.
    """
    key = [F.col(id_col).alias("__i"), F.coalesce(F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), F.lit(0)).alias("__c"), F.coalesce(F.octet_length(text_col) + 1, F.lit(1)).cast("long").alias("__z")]
    own = docs.select("*", *key).withColumn("__k", F.row_number().over(W.partitionBy("__i", "__c", "__z").orderBy(F.lit(0))))
    got = shards(docs, n, id_col, text_col).select(F.col("doc_id").alias("__i2"), F.col("text_crc32").alias("__c2"), F.col("size").alias("__z2"), "shard", "slot")
    got = got.withColumn("__k2", F.row_number().over(W.partitionBy("__i2", "__c2", "__z2").orderBy("shard", "slot")))
    out = own.join(got, F.col("__i").eqNullSafe(F.col("__i2")) & (F.col("__c") == F.col("__c2")) & (F.col("__z") == F.col("__z2")) & (F.col("__k") == F.col("__k2")))
    out.select(*docs.columns, "slot", "shard").write.partitionBy("shard").parquet(path)
