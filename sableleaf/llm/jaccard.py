"""N-gram Jaccard join by several global token orders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, narrowed, staged
from .components import connected_components
from .words import mix, ragged, shingle_sets, slices

#: Tokens of all sets for each bucket that long prefixes (three in ten of them) are dealt to.
BUCKET_TOKENS = 1_000_000
#: Bits of a set's signature: the parity of its tokens by hash.
SIGNATURE = 1024
#: Rounds in which a list's members meet one leader each, before leaders are taken off the lists.
LEADER_ROUNDS = 2
#: The leaders of a list in the first round after those, and how many times more in each later one.
FIRST_LEADERS, MORE_LEADERS = 64, 64


def least_overlap(n, percent: int):
    """Tokens that a set of n shares with any set it links to, at the least."""
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, percent: int, more: int = 1) -> np.ndarray:
    """The first tokens under an order, so many that linked sets share `more` of them at the least."""
    n = len(tokens)
    return tokens[: n - int(least_overlap(n, percent)) + more] if n else tokens


def spare(n, percent: int):
    """Tokens of the long prefix by hash that a set of n shares with the long prefix of any set it links to.

    A prefix is max(1, n // 10) - 1 tokens longer than needed for one; a partner
    has least_overlap(n) tokens at the least.
    """
    return np.maximum(1, least_overlap(n, percent) // 10)


def marks(tokens: np.ndarray) -> np.ndarray:
    """32-bit marks of tokens: equal tokens have equal marks."""
    return (tokens >> np.uint64(7)).astype(np.uint32)


def other_order(tokens: np.ndarray) -> np.ndarray:
    """A set in the order by another hash."""
    return tokens[np.argsort(mix(tokens * np.uint64(0xD1342543DE82EF95)))]


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _class(key: bytes) -> int:
    """A class's number: half the digest of its set."""
    return int.from_bytes(key[:8], "little", signed=True)


def _scan(percent: int):
    """Size, digest and long prefix of each set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                keys = [_digest(s) if len(s) else None for s in sets]
                long = [prefix(s, percent, max(1, len(s) // 10)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([k and _class(k) for k in keys], pa.int64()), ragged(long, pa.int64())],
                    ["doc_id", "n_shingles", "set_key", "cid", "prefix"],
                )

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of arrays, and the length of each."""
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _scatter(buckets: int):
    """Pack the long prefixes of a batch by bucket of tokens: a row for each bucket, not for each token.

    A token that several classes of the batch have is known to be shared: its
    classes are told at once (bucket -1 - x), and one entry, without a class,
    tells the token's bucket. So a hot token's entries are as many as the batches.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cid = batch.column("cid").to_numpy()
            cid, first = np.unique(cid, return_index=True)
            token, size = _flat(batch.column("prefix").take(pa.array(first)))
            of = np.repeat(cid, size)
            order = np.argsort(token, kind="stable")
            token, of = token[order], of[order]
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            many = np.diff(np.append(start, len(token))) > 1
            told = of[np.repeat(many, np.diff(np.append(start, len(token))))]
            token, of = token[start], np.where(many, 0, of[start])
            where = token.view(np.uint64) % np.uint64(buckets)
            order = np.argsort(where, kind="stable")
            token, of, where = token[order], of[order], where[order]
            cut = np.searchsorted(where, np.arange(buckets + 1).astype(np.uint64))
            full = np.flatnonzero(np.diff(cut))
            rows = [(int(b), token[cut[b] : cut[b + 1]].tobytes(), of[cut[b] : cut[b + 1]].tobytes()) for b in full]
            if len(told):
                rows.append((-1 - int(cid[0]) % buckets, b"", told.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "token", "cid"])

    return run


def _shared(group: pa.Table) -> pa.Table:
    """A row (cid) for each class and token of a bucket that another class has too."""
    token = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("token")])
    cid = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("cid")])
    if not len(token):
        return pa.table({"cid": pa.array(cid)})
    order = np.lexsort((cid, token))
    token, cid = token[order], cid[order]
    new = np.append(True, token[1:] != token[:-1])
    other = new | np.append(True, cid[1:] != cid[:-1])
    token, cid = token[other], cid[other]
    _, back, count = np.unique(token, return_inverse=True, return_counts=True)
    known = np.bincount(back, cid == 0) > 0  # shared within a batch
    return pa.table({"cid": pa.array(cid[((count > 1) | known)[back] & (cid != 0)])})


_SIG = [f"s{k}" for k in range(SIGNATURE // 64)]


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each bit, as 64-bit words: two sets differ in as many tokens as their signatures do in bits, or more."""
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % SIGNATURE, minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(percent: int):
    """Whole sets, marks of their prefixes under two orders by hash, and signatures."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                rows = [part.column("doc_id"), pa.array([_class(_digest(s)) for s in sets], pa.int64()), ragged(sets, pa.int64())]
                rows += [ragged([marks(prefix(order(s), percent)) for s in sets], pa.int32()) for order in (lambda s: s[::-1], other_order)]
                sig = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, len(_SIG)), np.int64)
                rows += [pa.array(np.ascontiguousarray(sig[:, k])) for k in range(len(_SIG))]
                yield pa.RecordBatch.from_arrays(rows, ["cls", "cid", "tokens", "high", "other", *_SIG])

    return run


class _Join:
    """The join's tables: scanned rows, classes of equal sets, lists of classes by token, and the sets of those."""

    def __init__(self, tmp: Scratch, docs: DataFrame, id_col: str, text_col: str, percent: int):
        self.tmp, self.percent = tmp, percent
        spark = docs.sparkSession
        bound_batches(spark)
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.scan = tmp.staged(docs.mapInArrow(_scan(percent), "doc_id long, n_shingles long, set_key binary, cid long, prefix array<bigint>"), "shingles")
        full = self.scan.where("n_shingles > 0 and doc_id is not null")
        self.classes = tmp.staged(full.groupBy("set_key").agg(F.min("doc_id").alias("cls"), F.first("cid").alias("cid"), F.min("n_shingles").alias("n")), "classes")

        # the order by hash, on documents: classes whose long prefix shares too few tokens with others' drop out
        total = self.classes.agg(F.sum("n")).first()[0] or 0
        buckets = int(total // BUCKET_TOKENS) + 1
        packed = full.select("cid", "prefix").mapInArrow(_scatter(buckets), "bucket int, token binary, cid binary")
        hits = packed.groupBy("bucket").applyInArrow(_shared, "cid long").groupBy("cid").agg(F.count("*").alias("k"))
        least = F.greatest(F.lit(1), F.expr(f"int(ceil({percent} * n / 100)) div 10"))
        able = tmp.staged(hits.join(self.classes, "cid").where(F.col("k") >= least).select(F.col("cls").alias("doc_id")).distinct(), "able")
        kept = narrowed(docs, "doc_id", able).join(able, "doc_id", "left_semi")
        self.sets = tmp.staged(kept.mapInArrow(_sets(percent), "cls bigint, cid bigint, tokens array<bigint>, high array<int>, other array<int>, " + ", ".join(f"{c} long" for c in _SIG)), "sets")
        if not self.scan.groupBy("doc_id").count().where("doc_id is not null and count > 1").isEmpty():  # rows that repeat id and text
            self.sets = tmp.staged(self.sets.dropDuplicates(["cls", "cid"]), "sets_once")

        # the order by frequency among those, rarest first: tokens of one set only lead it and can't be shared
        one = self.sets.select("cls", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
        many = one.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1")
        own = one.join(many, "token").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
        least = F.expr(f"int(ceil({percent} * n / 100))")
        lists = own.where(F.size("own") >= least).select("cls", "n", F.explode(F.slice("own", F.lit(1), F.size("own") - least + 1)).alias("x"))
        self.lists = tmp.staged(lists.select("cls", "n", F.col("x.token").alias("token")), "lists")

    def marked(self, lists: DataFrame) -> DataFrame:
        """Lists with their classes' signatures."""
        return lists.join(self.sets.select("cls", *_SIG), "cls")

    def near(self) -> str:
        """Whether a pair's sizes (n, m) and signatures let it link: the tokens that it differs in are no fewer than the bits."""
        differ = " + ".join(f"bit_count({c} ^ z{c})" for c in _SIG)
        return f"100 * least(n, m) >= {self.percent} * greatest(n, m) and {100 + self.percent} * ({differ}) <= {100 - self.percent} * (n + m)"

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), of classes with a common token under the order by frequency, that are links.

        Both orders by hash are intersected with that one on narrow rows, the
        marks of the prefixes; whole sets are fetched for the pairs that are left.
        """
        tmp = self.tmp
        of = lambda end, *cols: self.sets.select(F.col("cls").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in cols))
        passed = pairs.join(of("b", "high", "other"), "b").join(of("a", "high", "other"), "a").where(F.arrays_overlap("high_a", "high_b") & F.arrays_overlap("other_a", "other_b"))
        passed = tmp.staged(passed.select("a", "b"), "passed")
        both = passed.join(of("b", "tokens"), "b").join(of("a", "tokens"), "a")
        both = both.select("a", "b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("c"), (F.size("tokens_a") + F.size("tokens_b")).alias("total"))
        out = tmp.staged(both.where(f"100 * c >= {self.percent} * (total - c)").select("a", "b"), "links")
        tmp.drop(passed)
        return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Exact similarity join of 5-word shingle sets, as components.

    Returns (doc_id, n_shingles, component_id, set_id): the size of the set, the
    smallest id reachable by links of Jaccard >= percent/100, and the smallest id
    of those with the very same set. Ids are integers.

    Method. Copies of a set are one class (a pre-aggregated group-by on a digest).
    Linked sets share a token of their prefixes under any order of all tokens;
    four are used. By hash, on documents: classes stay whose long prefix has
    enough tokens that are in others', too. By frequency among those, rarest
    first: a pair is a candidate if it shares a token of that prefix, and sizes
    and signatures let it link. By the hash in reverse and by another hash: a
    candidate must share a prefix token in both as well, tested on narrow rows,
    before its sets are fetched and compared in full.

    A list holds the classes with one token in their frequency prefix. In two
    rounds each list proposes links to one leader, which joins most of a group of
    copies; then lists still in different components meet more and more leaders,
    64 times as many each round, and a leader that its list has met is taken
    off it. A list is done when one component is left in it, so no link between
    components is lost, and groups of copies never expand into all pairs.

    Nulls: a null text has no shingles; rows with a null id come back with a null
    component. Texts without words are linked with nothing. Rows that repeat an
    id are one document if their sets are equal; otherwise each row is compared
    and they meet in one component by their id. Other columns are ignored. An
    empty table gives an empty table.
    """
    with Scratch(docs.sparkSession) as tmp:
        j = _Join(tmp, docs, id_col, text_col, percent)
        lists, turn = j.lists, 0
        comps = tmp.staged(lists.select("cls", F.col("cls").alias("comp")).distinct(), "comps")
        while True:
            open_ = lists.select("cls", "n", "token").join(comps, "cls")
            # lists whose members are still in different components
            mixed = open_.groupBy("token").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first < last").select("token")
            open_ = tmp.staged(j.marked(open_.join(mixed, "token")), "open")
            tmp.drop(lists)
            if open_.isEmpty():
                break
            one = turn < LEADER_ROUNDS
            leaders = 1 if one else FIRST_LEADERS * MORE_LEADERS ** (turn - LEADER_ROUNDS)
            rank = F.struct("cls") if not turn else F.struct(F.xxhash64("cls", F.lit(turn)), "cls")
            lead = open_.groupBy("token", F.pmod(F.xxhash64("cls"), F.lit(leaders)).alias("place")).agg(F.min(rank)["cls"].alias("a")).select("token", "a")
            far = open_.select(F.col("cls").alias("a"), F.col("n").alias("m"), F.col("comp").alias("c"), *(F.col(c).alias(f"z{c}") for c in _SIG)).distinct()
            pairs = open_.join(lead.join(far, "a"), "token").where(f"comp <> c and {j.near()}")
            if one:
                pairs = pairs.groupBy(F.col("cls").alias("b")).agg(F.min("a").alias("a"))
            else:
                pairs = pairs.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()
            found = j.linked(pairs)
            if one:
                lists = open_.drop(*_SIG)
                lists._scratch = open_._scratch
            else:
                lists = tmp.staged(open_.drop(*_SIG, "comp").join(lead.select("token", F.col("a").alias("cls")), ["token", "cls"], "left_anti"), "lists")
                tmp.drop(open_)
            turn += 1
            if not found.isEmpty():
                # only components that a link joins are renamed
                named = comps.select(F.col("cls").alias("a"), F.col("comp").alias("u"))
                ends = found.join(named, "a").join(named.select(F.col("a").alias("b"), F.col("u").alias("v")), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
                now = tmp.staged(comps.join(connected_components(ends), F.col("comp") == F.col("node"), "left").select("cls", F.coalesce("component", "comp").alias("comp")), "comps")
                tmp.drop(comps)
                comps = now
            tmp.drop(found)

        # from classes back to documents; a repeated id ties its rows together
        joined = j.classes.join(comps, "cls", "left").select("set_key", F.col("cls").alias("set_id"), F.coalesce("comp", "cls").alias("comp"))
        full = F.expr("n_shingles > 0 and doc_id is not null")
        out = j.scan.where(full).select("doc_id", "n_shingles", "set_key").join(joined, "set_key").select("doc_id", "n_shingles", "set_id", "comp")
        bare = j.scan.where(~full).select("doc_id", "n_shingles", F.col("doc_id").alias("set_id"), F.col("doc_id").alias("comp"))
        out = staged(out.unionByName(bare), "members")
    twice = out.where("comp is not null").groupBy("doc_id").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    if not twice.isEmpty():
        ties = connected_components(out.join(twice, "doc_id").select(F.col("comp").alias("a"), F.col("x").alias("b")))
        out = out.join(ties, out["comp"] == ties["node"], "left").select("doc_id", "n_shingles", "set_id", F.coalesce("component", "comp").alias("comp"))
    return out.select("doc_id", "n_shingles", F.col("comp").alias("component_id"), "set_id")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Every link between different shingle sets: (a, b), a < b, the smallest ids that have the sets.

    The join's own output; `set_id` of `jaccard_components` says which documents
    stand behind an id. Every pair of a list that passes the bounds is verified,
    with no leaders, so pairs within a component are all there: its cost grows
    with the pairs of different near copies, not with equal ones. Two different
    sets of one repeated id aren't a pair. An empty table gives an empty one.
    """
    with Scratch(docs.sparkSession) as tmp:
        j = _Join(tmp, docs, id_col, text_col, percent)
        own = tmp.staged(j.marked(j.lists), "open")
        other = own.select("token", F.col("cls").alias("a"), F.col("n").alias("m"), *(F.col(c).alias(f"z{c}") for c in _SIG))
        pairs = own.join(other, "token").where(f"a < cls and {j.near()}").select("a", F.col("cls").alias("b")).distinct()
        return staged(j.linked(pairs), "links")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id.

    Documents without words and documents without an id are kept; of rows that
    repeat an id one stays for each different text. All columns of `docs` come
    back.
    """
    found = jaccard_components(docs, id_col, text_col, percent)
    gone = staged(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct(), "gone")
    own = docs.withColumn("__id", F.col(id_col).cast("long"))
    # only texts whose ids may be gone move for the join
    out = narrowed(own, "__id", gone).join(gone, "__id", "left_anti").unionByName(narrowed(own, "__id", gone, "left_anti")).drop("__id")
    twice = staged(docs.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1 and __id is not null").select("__id"), "repeated_ids")
    if twice.isEmpty():
        return out
    same = out[id_col].cast("long") == twice["__id"]
    once = out.join(twice, same, "left_semi").dropDuplicates([id_col, text_col])
    return out.join(twice, same, "left_anti").unionByName(once)
