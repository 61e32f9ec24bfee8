"""Quality rules as a short-circuit cascade."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .words import Words, raw, repeated_words, slices, words

#: Fixed value: the symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"
#: Rows that the cost and selectivity of the rules are estimated on, about.
SAMPLE_ROWS = 2000


class Features:
    """The figures of a batch of texts, each worked out when first asked for, and
    only for the rows asked for."""

    def __init__(self, texts: pa.Array, split: Words | None = None):
        self.texts, self._split = texts, split
        self._known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.texts)

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        value, done = self._known.setdefault(name, (np.zeros(len(self), np.int64), np.zeros(len(self), bool)))
        todo = rows[~done[rows]]
        if len(todo):
            own = self if len(todo) == len(self) else Features(self.texts.take(pa.array(todo)), self._split and self._split.take(todo))
            value[todo] = FEATURES[name](own)
            done[todo] = True
        return value[rows]

    @property
    def words(self) -> Words:
        if self._split is None:
            self._split = words(self.texts, lower=False)
        return self._split


def _per_text(table: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Sum of a figure of each byte, for each text."""
    data, at = raw(texts)
    out = np.zeros(len(at) - 1, np.int64)
    for i in range(len(out)):
        out[i] = np.count_nonzero(table[data[at[i] : at[i + 1]]])
    return out


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
#: The first byte of each code point that is not white space.
_IS_CHAR = np.ones(256, bool)
_IS_CHAR[0x80:0xC0] = False
_IS_CHAR[[9, 10, 11, 12, 13, 32]] = False


def _lines(f: Features) -> tuple[np.ndarray, np.ndarray]:
    every, again = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
    for i, t in enumerate(f.texts):
        full = [x for x in (t.as_py() or "").split("\n") if x.strip(" \t\n\v\f\r")]
        every[i], again[i] = len(full), len(full) - len(set(full))
    return every, again


#: Name -> figure of every text: all are whole numbers.
FEATURES: dict[str, Callable[[Features], np.ndarray]] = {
    "n_words": lambda f: f.words.counts.astype(np.int64),
    "word_chars": lambda f: _per_text(_IS_CHAR, f.texts),
    "n_symbols": lambda f: _per_text(_IS_SYMBOL, f.texts),
    "n_lines": lambda f: _lines(f)[0],
    "n_dup_lines": lambda f: _lines(f)[1],
    "n_repeat_words": lambda f: repeated_words(f.words),
}


@dataclass(frozen=True)
class Rule:
    """A text is rejected where `rejects` holds for the named figures."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]

    def __call__(self, f: Features, rows: np.ndarray) -> np.ndarray:
        return self.rejects(*(f.get(x, rows) for x in self.needs))


BASE = (
    Rule("too_few_words", ("n_words",), lambda n: n < 10),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 20 * n),
)
#: Beyond the base: symbols for more than a tenth of the words, a mean word of
#: under 2 or over 15 characters, over 30 % of the lines repeated.
RULES = BASE + (
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 15 * n)),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 100 * d > 30 * n),
)


def estimate(docs: DataFrame, rules=RULES, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[dict]:
    """Cost (seconds a text) and selectivity of each rule on a sample of about `rows` texts.

    The sample fixes the order only, never a verdict. An empty table gives no
    cost and no rejection.
    """
    bound_batches(docs.sparkSession)
    every = docs.count()  # of parquet, from the files' footers
    share = min(1.0, rows / max(1, every))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for rule in rules:
                    f = Features(part.column("text"))  # each rule pays for its own figures
                    began = time.perf_counter_ns()
                    gone = int(rule(f, np.arange(len(f))).sum())
                    out.append((rule.name, len(f), gone, time.perf_counter_ns() - began))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["rule", "n", "gone", "ns"])

    sample = docs.select(F.col(text_col).cast("string").alias("text")).sample(share, 7) if share < 1 else docs.select(F.col(text_col).cast("string").alias("text"))
    got = {r["rule"]: r for r in sample.mapInArrow(run, "rule string, n long, gone long, ns long").groupBy("rule").agg(F.sum("n").alias("n"), F.sum("gone").alias("gone"), F.sum("ns").alias("ns")).collect()}
    return [{"rule": r.name, "cost": got[r.name]["ns"] / 1e9 / max(1, got[r.name]["n"]) if r.name in got else 0.0, "selectivity": got[r.name]["gone"] / max(1, got[r.name]["n"]) if r.name in got else 0.0} for r in rules]


def ordered(rules, estimates: list[dict]) -> list[Rule]:
    """By rejection per cost, highest first; ties by name."""
    by = {x["rule"]: x["selectivity"] / max(x["cost"], 1e-9) for x in estimates}
    return sorted(rules, key=lambda r: (-by[r.name], r.name))


def cascade(f: Features, rules) -> tuple[np.ndarray, np.ndarray]:
    """Run rules in order, each on the rows that all before it kept: (kept, index of the rejecting rule or -1)."""
    alive, by = np.arange(len(f)), np.full(len(f), -1)
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        gone = rule(f, alive)
        by[alive[gone]] = k
        alive = alive[~gone]
    return by < 0, by


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Figures and verdict of every text: (doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept).

    `kept` is the cascade's verdict: no rule rejects the text; it doesn't depend
    on the order, which is by rejection per cost on a sample. A null text has no
    words and fails the base. Ids pass through unread, so nulls and repeats are
    as they were; an empty table gives an empty one; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ordered(rules, estimate(docs, rules, "text", sample_rows))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                f = Features(part.column("text"))
                every = np.arange(len(f))
                figures = [f.get(x, every) for x in shown]
                kept, _ = cascade(f, order)
                base = ~cascade(f, [r for r in rules if r in BASE])[0]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, figures), pa.array(base), pa.array(kept)], ["doc_id", *shown, "base_failed", "kept"])

    return docs.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{x} long' for x in shown)}, base_failed boolean, kept boolean")


def keep(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with all their columns; figures are worked
    out only for the texts a rule still has to see."""
    order = ordered(rules, estimate(docs, rules, text_col, sample_rows))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                kept, _ = cascade(Features(part.column(text_col).cast(pa.string())), order)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
