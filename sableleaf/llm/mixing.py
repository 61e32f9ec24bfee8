"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, Scratch, staged

#: Score ranges in which a source's sizes are summed before single rows are ranked.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """Targets of sources: adds `target` to (source, source_size).

    Sources in code point order, null last, weigh `weights`, repeating, and share
    the sum of all sizes; none gets over `cap` times its own, and what it can't
    take goes to the others by weight. That is water-filling: by cap for each
    weight, the lowest first, sources are full until the first that the rest's
    level doesn't fill. One row for each source is ranked in one task.
    """
    pick = F.array(*map(F.lit, weights))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("w", F.element_at(pick, (rank % len(weights) + 1).cast("int")).cast("long")).withColumn("most", F.col("source_size") * cap)
    up = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    all_ = W.partitionBy()
    before = up.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(all_) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    s = s.withColumn("rest", F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("at", F.row_number().over(up))
    open_ = F.col("left") * F.col("w") <= F.col("most") * F.col("rest")
    level = F.min(F.when(open_, F.struct("at", "left", "rest"))).over(all_)
    s = s.withColumn("level", level)
    full = F.col("level").isNull() | (F.col("at") < F.col("level.at"))
    return s.withColumn("target", F.when(full, F.col("most").cast("double")).otherwise(F.col("level.left").cast("double") * F.col("w") / F.col("level.rest"))).select("source", "source_size", "target")


def rates(groups: DataFrame, cap: int) -> DataFrame:
    """Expected copies `e` of a word of each (s, share), so that a source's words come to its target.

    `groups` has (s, share, words, target), a row for each share of a source. e is
    proportional to the share, but `cap` at the most; what capped shares can't
    take goes to the others: shares are full, the largest first, up to the first
    that the rest's rate doesn't fill. A source's distinct shares are ranked in one
    task.
    """
    down = W.partitionBy("s").orderBy(F.col("share").desc())
    before, rest = down.rowsBetween(W.unboundedPreceding, -1), down.rowsBetween(0, W.unboundedFollowing)
    g = groups.withColumn("left", F.col("target") - cap * F.coalesce(F.sum("words").over(before), F.lit(0)))
    g = g.withColumn("weight", F.sum(F.col("share") * F.col("words")).over(rest).cast("double"))
    g = g.withColumn("rate", F.when(F.col("weight") > 0, F.col("left") / F.col("weight")))
    open_ = F.col("rate") * F.col("share").cast("double") <= cap
    rate = F.max_by(F.when(open_, F.col("rate")), F.when(open_, F.col("share"))).over(W.partitionBy("s"))
    e = F.when(F.col("share") > 0, F.coalesce(F.least(F.lit(float(cap)), rate * F.col("share").cast("double")), F.lit(float(cap)))).otherwise(0.0)
    return g.select("s", "share", e.alias("e"))


def _drawn(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str, share_col: str | None, share_of: Callable[[Column], Column] | None, *also: Column) -> DataFrame:
    """What the mix knows of each row: (doc_id, source, size, u, share, s) and the columns `also`; u is drawn from the id."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    own = F.col(share_col) if share_col else F.lit(1)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), u.alias("u"), own.alias("share"), *also)
    share = (share_of(F.col("size")) if share_of else F.col("share")).cast("decimal(18,6)")
    return d.withColumn("share", F.greatest(F.coalesce(share, F.lit(0)), F.lit(0)).cast("decimal(18,6)")).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))


def _ranked(d: DataFrame, cap: int) -> DataFrame:
    """Adds the certain copies, and the Pareto score `q` of those that may get one more, to rows with e and u."""
    d = d.withColumn("certain", F.floor("e").cast("long")).withColumn("p", F.when(F.col("certain") < cap, F.col("e") - F.col("certain")).otherwise(0.0))
    may = (F.col("p") > 0) & (F.col("size") > 0)
    return d.withColumn("q", F.when(may, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))).drop("u", "e", "p")


def _fitting(tmp: Scratch, free: DataFrame, gap: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The documents taken down the Pareto order wherever they fit what their source still lacks (s, gap).

    The same as going through them one by one. Each round marks (`fits`) the
    longest run that fits together, summed by range first, then leaves out those
    larger than what is left: the gap falls below the size of the one that ended
    the run, so the rounds are few. Returns two tables for each round: (rid) of
    those taken, and (s, gap, last), by which they can be told again: of the rows
    no larger than the gap, all up to `last` in the order are taken by then.
    What joins the rows by source is written first, so that its size is known.
    """
    taken, rounds = [], []
    gap = tmp.staged(gap, "gap")
    while True:
        free = free.join(gap, "s").where("size <= gap")
        runs = free.groupBy("s", "r").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
        runs = runs.withColumn("upto", F.sum("words").over(W.partitionBy("s").orderBy("r")))
        edge = runs.where("upto > gap").groupBy("s").agg(F.min(F.struct("r", (F.col("gap") - F.col("upto") + F.col("words")).alias("room"))).alias("x")).select("s", F.col("x.r").alias("edge"), "x.room")
        cut = free.join(tmp.staged(edge, "edge"), "s", "left")
        on = F.col("edge").isNotNull() & (F.col("r") == F.col("edge"))
        upto = F.sum("size").over(W.partitionBy("s").orderBy("q", "doc_id", "size", "rid").rowsBetween(W.unboundedPreceding, 0))
        inside = cut.where(on).withColumn("fits", upto <= F.col("room"))
        state = tmp.staged(cut.where(~on).withColumn("fits", F.col("edge").isNull() | (F.col("r") < F.col("edge"))).unionByName(inside).drop("edge", "room"), "fitting")
        if state.isEmpty():
            return taken, rounds
        taken.append(state.where("fits").select("rid"))
        last = F.max(F.when(F.col("fits"), F.struct("q", "doc_id", "size")))
        done = tmp.staged(state.groupBy("s").agg(F.first("gap").alias("gap"), last.alias("last"), F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("words")), "round")
        rounds.append(done.select("s", "gap", "last"))
        gap = done.select("s", (F.col("gap") - F.col("words")).alias("gap"))
        free = state.where("not fits").drop("gap", "fits")


def _mix(tmp: Scratch, docs: DataFrame, id_col: str, source_col: str, text_col: str, weights, cap: int, seed: str, share_col: str | None, share_of: Callable[[Column], Column] | None) -> tuple[DataFrame, DataFrame]:
    """The rows of `mix`, and the rules that give them: (s, share, e, rounds), a row for each share of a source."""
    d = tmp.staged(_drawn(docs, id_col, source_col, text_col, seed, share_col, share_of, F.monotonically_increasing_id().alias("rid")), "sizes")
    sums = tmp.staged(d.groupBy("s", "share").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "sums")
    goal = targets(sums.groupBy("s").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")).select("source", "source_size"), weights, cap)
    goal = goal.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    rate = rates(sums.select("s", "share", "words").join(goal.select("s", "target"), "s"), cap)
    rate = tmp.staged(rate.join(goal, "s"), "rates")  # a row for each share of a source
    d = _ranked(d.join(rate, ["s", "share"]), cap)
    d = tmp.staged(d.withColumn("r", F.floor(F.col("q") / (1 + F.col("q")) * RANGES)).drop("share"), "ranked")
    gap = d.groupBy("s").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("gap"))
    open_ = d.where("q is not null").select("s", "r", "q", "doc_id", "size", "rid")
    taken, rounds = _fitting(tmp, open_, gap)
    more = reduce(DataFrame.unionByName, taken, d.limit(0).select("rid"))
    none = open_.limit(0).select("s", F.lit(0.0).alias("gap"), F.struct("q", "doc_id", "size").alias("last"))
    rule = reduce(DataFrame.unionByName, rounds, none).groupBy("s").agg(F.collect_list(F.struct("gap", "last")).alias("rounds"))
    d = d.join(more.withColumn("more", F.lit(1)), "rid", "left").withColumn("copies", F.col("certain") + F.coalesce("more", F.lit(0)))
    out = d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    return out, rate.select("s", "share", "e").join(rule, "s", "left")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(5, 2, 1), cap: int = 3, seed: str = "mix", share_col: str | None = None, share_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """Copies of each document that a mix of sources takes.

    Returns (doc_id, source, size, source_size, target, copies, taken); `size` is
    the number of words. Within a source a document is to be taken a number of
    times e that goes by its share (`share_col`, or `share_of` its size, or 1 for
    all; six decimals), `cap` at the most, so that the words come to the target
    (`rates`). The whole part of e is certain; the fraction p is the inclusion
    probability of one more copy. Documents are ranked by Pareto order: odds of a
    random u, drawn from the id, over the odds of p; down this order each is taken
    whose words fit what its source still lacks. So the sample has a fixed size in
    words, its documents unequal probabilities, and the source misses its target
    by less than the smallest document left over.

    Scale. One narrow table (no texts) is written; sizes are summed by score
    range, and rows are ranked in the one range in which a source's target falls,
    so a hot source is never sorted in one task.

    Null texts have size 0 and are taken as often as is certain, and a null source
    is a source; a null or negative share is 0. Rows that repeat an id draw the
    same u and are ranked by size after it. Runs agree. An empty table gives an
    empty one; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as tmp:
        return staged(_mix(tmp, docs, id_col, source_col, text_col, weights, cap, seed, share_col, share_of)[0], "mix")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(5, 2, 1), cap: int = 3, seed: str = "mix", share_col: str | None = None, share_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with all columns.

    No text moves: a row's copies are told where it is, from the rates and the
    rounds' gaps and last documents, a few rows for each source. Only rows that
    share id, source and size can't be told apart so; if there are any, they are
    joined with their copies. They are taken alike often in sum; where that doesn't
    go evenly, copies are dealt to them in order of the text's digest.
    """
    how = (id_col, source_col, text_col)
    with Scratch(docs.sparkSession) as tmp:
        rows, rules = _mix(tmp, docs, *how, weights, cap, seed, share_col, share_of)
        rules = staged(rules, "rules")
        key = rows.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n"), F.count("*").alias("many")).where("many > 1")
        again = staged(key.select(F.col("doc_id").alias("i"), F.col("source").alias("o"), F.col("size").alias("z"), "n", "many"), "repeated")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = _drawn(docs, *how, seed, share_col, share_of, row, F.xxhash64(F.col(text_col).cast("string")).alias("t"))
    place = F.struct("q", "doc_id", "size")
    fits = F.exists("rounds", lambda x: (F.col("size") <= x["gap"]) & (place <= x["last"]))
    more = F.col("q").isNotNull() & F.coalesce(fits, F.lit(False))
    out = _ranked(own.join(rules, ["s", "share"]), cap).select("row", "doc_id", "source", "size", (F.col("certain") + more.cast("long")).alias("copies"))
    if not again.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("o")) & (F.col("size") == F.col("z"))
        at = F.row_number().over(W.partitionBy("i", "o", "z").orderBy("t")) - 1
        dealt = own.join(again, same).withColumn("copies", F.floor(F.col("n") / F.col("many")) + (at < F.col("n") % F.col("many")).cast("long"))
        out = out.join(again, same, "left_anti").unionByName(dealt.select("row", "doc_id", "source", "size", "copies"))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
