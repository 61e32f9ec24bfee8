"""Line dedup by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, bound_batches, narrowed, staged
from .words import mix, powers, slices

#: Keys that are worked out and sent on at once.
CHUNK = 1 << 16
#: Code of the wildcard, beyond all characters.
_STAR = np.uint64(0x110001)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _digest(line: Column) -> list[Column]:
    return [F.xxhash64(line), F.xxhash64(F.lit(1), line)]


def lines_of(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, digest, line_no, line) of the lines that have a word; split at \\n only."""
    # the digest comes before the lines do: beside them, it would be taken of the whole text for each
    whole = docs.select("rid", "doc_id", F.xxhash64("text").alias("digest"), "text")
    rows = whole.select("rid", "doc_id", "digest", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def piece_keys(line: Column, chars: Column, edits: int) -> Column:
    """Keys of which two lines within `edits` edits share at least one.

    The shorter of the pair is cut into edits + 1 pieces; one of them has no edit,
    so it stands in the longer, the first at the same place, the last as far from
    the end, others moved by as many characters as there are edits at the most. A
    line has keys for every length that the shorter may have.
    """
    keys = []
    for less in range(edits + 1):
        n = chars - less
        cut = [F.floor(n * i / (edits + 1)).cast("int") for i in range(edits + 2)]
        for i in range(edits + 1):
            moves = [0] if not i else [less] if i == edits else range(-edits, edits + 1)
            for move in moves:
                at = cut[i] + move
                keys.append(F.when((n >= 0) & (at >= 0) & (at + cut[i + 1] - cut[i] <= chars), F.xxhash64(F.lit(i), n.cast("int"), line.substr(at + 1, cut[i + 1] - cut[i]))))
    return F.array_except(F.array(*keys), F.array(F.lit(None).cast("long")))


def _step(code: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of all strings that one wildcard more makes of a string of codes: it stands for a character, or between two."""
    n = len(code)
    power = powers(n + 1)
    pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:n], dtype=np.uint64)])
    own = np.flatnonzero(code != _STAR)
    for low in range(0, len(own), CHUNK):
        at = own[low : low + CHUNK]
        yield mix(pre[-1] + (_STAR - code[at]) * power[at] + np.uint64(n))
    for low in range(0, n + 1, CHUNK):
        at = np.arange(low, min(n + 1, low + CHUNK))
        yield mix(pre[at] + _STAR * power[at] + (pre[-1] - pre[at]) * _BASE + np.uint64(n + 1))


def variants(line: str, edits: int) -> Iterator[np.ndarray]:
    """Hashes of the line's deletion neighbourhood: its strings with `edits` characters taken out or none, each place marked.

    A mark (wildcard) stands for one character or none. Two lines are within
    `edits` edits if, and only if, they have such a string in common: an edit is a
    character that one of them lacks or has otherwise. So all lines that share a
    string are within the bound of each other. There are 2n + 1 for one edit, and
    about 2n^2 for two.
    """

    def more(code: np.ndarray, left: int) -> Iterator[np.ndarray]:
        if not left:
            yield from _step(code)
            return
        for i in range(len(code)):
            if code[i] != _STAR:
                other = code.copy()
                other[i] = _STAR
                yield from more(other, left - 1)
        for i in range(len(code) + 1):
            yield from more(np.insert(code, i, _STAR), left - 1)

    if not edits:
        return
    if edits == 1:
        yield from _step(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
        return
    held: list[np.ndarray] = []
    for part in more(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1), edits - 1):
        held.append(part)
        if sum(map(len, held)) >= CHUNK:
            yield np.unique(np.concatenate(held))
            held = []
    if held:
        yield np.unique(np.concatenate(held))


def _emit(edits: int):
    def run(batches):
        for batch in batches:
            keys, of, size = [], [], 0

            def flush(batch=batch):
                at = pa.array(np.repeat(of, [len(k) for k in keys]))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column("first").take(at)], ["v", "first"])

            for i, line in enumerate(batch.column("line").to_pylist()):
                for part in variants(line, edits):
                    keys.append(part)
                    of.append(i)
                    size += len(part)
                    if size >= CHUNK:
                        yield flush()
                        keys, of, size = [], [], 0
            if keys:
                yield flush()

    return run


def _bags(line: str, edits: int) -> np.ndarray:
    """Keys of a line's bag of letters, and of the bag less up to `edits` letters: lines within that many edits share one."""
    code, count = np.unique(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64), return_counts=True)
    g = mix(code * _BASE + np.uint64(1))
    level, out = (g * count.astype(np.uint64)).sum(keepdims=True), []
    for _ in range(edits + 1):
        out.append(level)
        level = np.unique((level[:, None] - g[None, :]).ravel())
    return np.unique(np.concatenate(out))


def _letters(edits: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "line", 1 << 18):
                keys = [_bags(x, edits) for x in part.column("line").to_pylist()]
                of = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([part.column("h1").take(of), pa.array(np.concatenate(keys).view(np.int64))], ["h1", "key"])

    return run


def _shared_by_two(keyed: DataFrame) -> DataFrame:
    """The lines (h1) of which a key is that of another line too; counted before keys are joined back."""
    many = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("key")
    return keyed.join(many, "key", "left_semi").select("h1").distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1) -> DataFrame:
    """Lines to remove from each document: equal to, or within `edits` edits of, an earlier line.

    Returns one row for each row: (rid, doc_id, digest, n_lines, n_equal, n_near,
    removed), removed being the sorted numbers (from 0) of the lines to drop, and
    digest that of the text. Lines without a word are left alone and not counted.
    Earlier means smaller (doc_id, number); a null id comes first. A line goes if
    any earlier line is within the bound, kept or not, however short it is;
    edits=0 matches equal lines only. Two edits and more cost keys by the square
    (and so on) of a line's length.

    Method. Lines are reduced to distinct ones by digest. Lines that share no piece
    with another line (pigeonhole) drop out, and so do lines whose letters, as a
    bag, are further from those of any other. The rest emit their deletion
    neighbourhood as hashed keys (`variants`). Lines with an equal key are within
    the bound of each other, so each goes for the earliest of them: groups are met
    by that one only, never pair by pair, and hold no more distinct lines than one
    character has values, for one edit. The edit distance of each match is then
    verified on the lines themselves.

    Null and empty texts have no lines; repeated ids are rows of their own; an
    empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    h1, h2 = _digest(F.col("line"))
    with Scratch(spark) as tmp:
        keys = [piece_keys(F.col("line"), F.col("chars"), edits).alias("keys")] if edits else []
        rows = tmp.staged(lines_of(src).withColumn("chars", F.char_length("line")).select("rid", "doc_id", "digest", "line_no", h1.alias("h1"), h2.alias("h2"), *keys), "lines")
        here = F.struct("doc_id", "line_no", "rid")
        firsts = rows.groupBy("h1", "h2").agg(F.min(here).alias("first"))
        if edits:
            live = tmp.staged(_shared_by_two(rows.select("h1", F.explode("keys").alias("key"))), "shared")
            # lines are read again; a bounded filter goes before the join that moves their text
            again = narrowed(lines_of(src).select("line", h1.alias("h1"), h2.alias("h2")), "h1", live).join(live, "h1", "left_semi")
            live = tmp.staged(again.groupBy("h1", "h2").agg(F.first("line").alias("line")), "piece_lines")
            live = live.join(_shared_by_two(live.mapInArrow(_letters(edits), "h1 long, key long")), "h1", "left_semi")
            live = tmp.staged(live.join(firsts, ["h1", "h2"]), "live_lines")
            kind = live.schema["first"].dataType.simpleString()
            v = tmp.staged(live.select("line", "first").repartition("first").mapInArrow(_emit(edits), f"v long, first {kind}"), "variants")
            least = v.groupBy("v").agg(F.min("first").alias("w"), F.max("first").alias("x")).where("w < x").select("v", "w")
            pairs = v.join(least, "v").where("w < first").select("first", "w").distinct()
            text = live.select("first", "line")
            pairs = pairs.join(text, "first").join(text.select(F.col("first").alias("w"), F.col("line").alias("earlier")), "w")
            near = pairs.where(F.levenshtein("line", "earlier", edits).between(1, edits)).select("first").distinct()
            firsts = firsts.join(near.withColumn("near", F.lit(True)), "first", "left").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
        else:
            firsts = firsts.withColumn("near", F.lit(False))
        # written, so that the join meets two plain shuffles and Spark can split a hot line
        told = rows.drop("keys").join(tmp.staged(firsts, "firsts"), ["h1", "h2"])
        again = F.struct("doc_id", "line_no", "rid") != F.col("first")
        by_row = told.groupBy("rid", "doc_id", "digest").agg(F.count("*").alias("n_lines"), F.sum(again.cast("long")).alias("n_equal"), F.sum((F.col("near") & ~again).cast("long")).alias("n_near"), F.array_sort(F.collect_list(F.when(F.col("near") | again, F.col("line_no")))).alias("removed"))
        blank = src.where("text is null or not rlike(text, '[^\\\\x20\\\\x09-\\\\x0D]')").select("rid", "doc_id", F.xxhash64("text").alias("digest"), *(F.lit(0).cast("long").alias(c) for c in ("n_lines", "n_equal", "n_near")), F.array().cast("array<int>").alias("removed"))
        return staged(by_row.unionByName(blank), "line_dedup")


def without(text: Column, removed: Column) -> Column:
    """A text without the lines of the given numbers."""
    every = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.array_join(F.transform(F.filter(every, lambda e: ~F.array_contains(removed, e["i"])), lambda e: e["x"]), "\n")


def dedup_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with their repeated and near-repeated lines taken out; other columns stay.

    A null text stays null. Rows are matched by id and digest of the text, and
    those that share both by number, so a row is cut by its own lines only.
    """
    found = line_dedup(docs, id_col, text_col, **how).where("n_lines > 0")
    found = found.select(F.col("doc_id").alias("__i"), F.col("digest").alias("__d"), F.col("removed").alias("__gone"), F.row_number().over(W.partitionBy("doc_id", "digest").orderBy("rid")).alias("__n")).where("size(__gone) > 0")
    own = docs.withColumn("__k", F.xxhash64(F.col(text_col).cast("string")))
    own = own.withColumn("__m", F.row_number().over(W.partitionBy(id_col, "__k").orderBy(F.lit(0))))
    out = own.join(found, own[id_col].eqNullSafe(F.col("__i")) & (F.col("__k") == F.col("__d")) & (F.col("__m") == F.col("__n")), "left")
    return out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col("__gone")))).select(*docs.columns)
