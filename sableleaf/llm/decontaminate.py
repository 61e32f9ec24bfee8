"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, staged
from .words import raw, slices

#: Bytes of a piece that the scan looks up: the most of these that the piece has.
ANCHORS = (16, 8, 4, 2, 1)
#: Errors allowed, as a share of the item's characters.
ERROR_RATE = 0.05
#: Characters of test items that one pass over the documents looks for.
BLOCK_CHARS = 4 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def normal(text: str | None) -> str:
    """A-Z lower-cased, runs of white space (0x20, 0x09-0x0D) one space, none at the ends."""
    return b" ".join((text or "").encode().lower().split()).decode()


def pieces(item: str, rate: float = ERROR_RATE) -> tuple[int, list[tuple[int, str]]]:
    """The error budget k of a normalised item, and its k + 1 pieces with their places.

    k is `rate` of the length (every piece has a character at least). By the
    pigeonhole principle at most k errors leave one piece whole.
    """
    m = len(item)
    k = max(0, min(int(m * rate), m - 1))
    cut = [m * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and that part's (first) end.

    Myers' bit-parallel search; a Python integer serves as one word of any length.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    mask, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask  # row 0 is free: the match may begin anywhere
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Index:
    """Pieces of a block of test items, by the hash of their first bytes: as many of ANCHORS as they have."""

    items: list[tuple[object, str]]
    rate: float = ERROR_RATE
    budget: list[int] = field(default_factory=list)
    by_anchor: dict[int, dict[int, list[tuple[int, int, bytes]]]] = field(default_factory=dict)

    def __post_init__(self):
        for n, (_, item) in enumerate(self.items):
            k, parts = pieces(item, self.rate)
            self.budget.append(k)
            for at, piece in parts:
                b = piece.encode()
                wide = next(w for w in ANCHORS if w <= len(b))
                key = int(_anchors(np.frombuffer(b[:wide], np.uint8), wide)[0])
                self.by_anchor.setdefault(wide, {}).setdefault(key, []).append((n, at, b))
        self.tables = []
        for wide, own in self.by_anchor.items():
            bits = min(26, max(16, (32 * len(own)).bit_length()))
            keys, maybe = np.sort(np.array(list(own), np.uint64)), np.zeros(1 << bits, bool)
            maybe[keys >> np.uint64(64 - bits)] = True
            self.tables.append((wide, keys, maybe, np.uint64(64 - bits)))

    def places(self, data: np.ndarray):
        """(place, pieces) of every place in the bytes where an anchor stands."""
        for wide, keys, maybe, shift in self.tables:
            h = _anchors(data, wide)
            place = np.flatnonzero(maybe[h >> shift])
            place = place[keys[np.minimum(np.searchsorted(keys, h[place]), len(keys) - 1)] == h[place]]
            own = self.by_anchor[wide]
            for p, key in zip(place.tolist(), h[place].tolist(), strict=True):
                yield p, own[key]


def _anchors(data: np.ndarray, wide: int) -> np.ndarray:
    """Hash of the `wide` bytes from each place on."""
    n = len(data) - wide + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.empty(len(data), np.uint64)
    for r in range(8):
        part = pad[r : r + (len(data) - r + 7) // 8 * 8]
        part = part[: len(part) // 8 * 8].view("<u8") if r == 0 else np.frombuffer(part[: len(part) // 8 * 8].tobytes(), "<u8")
        eight[r::8] = part[: len(eight[r::8])]
    if wide < 8:
        eight &= np.uint64((1 << 8 * wide) - 1)
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    if wide == 16:
        h ^= eight[8 : 8 + n]
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def _folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes of all texts, and where each begins (ends keep one space at most)."""
    data, at = raw(texts)
    data = _FOLD[data]
    space = data == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    keep[edge] = ~space[edge]  # no space begins a text
    new = np.concatenate([[0], np.cumsum(keep)])[at]
    return data[keep], new


def _search(index: Index, texts: pa.Array):
    """(text number, item number, distance, start, end) of the best hit of each item in each text."""
    data, at = _folded(texts)
    found: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}  # by place: least and largest offset of a piece found there
    for p, pieces_there in index.places(data):
        t = int(np.searchsorted(at, p, "right")) - 1
        for n, offset, piece in pieces_there:
            if p + len(piece) <= at[t + 1] and data[p : p + len(piece)].tobytes() == piece:
                hits = found.setdefault((t, n), {})
                a, b = hits.get(p, (offset, offset))
                hits[p] = min(a, offset), max(b, offset)
    now = None
    for (t, n), hits in sorted(found.items(), key=lambda x: x[0]):
        item, k = index.items[n][1], index.budget[n]
        if t != now:
            own = data[at[t] : at[t + 1]]
            now, text, char = t, own.tobytes().decode(), np.cumsum((own & 0xC0) != 0x80) - 1
        if not k:  # without errors allowed, an item stands apart from the letters and digits around it
            for p in sorted(hits):
                low = int(char[p - at[t]])
                high = low + len(item)
                if not (low and text[low - 1].isalnum() and item[0].isalnum()) and not (high < len(text) and text[high].isalnum() and item[-1].isalnum()):
                    yield t, n, 0, low, high
                    break
            continue
        # windows in characters; those that overlap are searched as one
        windows: list[list[int]] = []
        for p in sorted(hits):
            c, (least, most) = int(char[p - at[t]]), hits[p]
            low, high = max(0, c - most - k), min(len(text), c - least + len(item) + k)
            while windows and low <= windows[-1][1]:
                first, last = windows.pop()
                low, high = min(low, first), max(high, last)
            windows.append([low, high])
        best = None
        for low, high in windows:
            d, end = myers(item, text[low:high])
            if d <= k and (best is None or d < best[0]):
                left = myers(item[::-1], text[low : low + end][::-1])[1]
                best = (d, low + end - left, low + end)
        if best:
            yield (t, n, *best)


def _blocks(items: DataFrame, rate: float):
    """The items in blocks of BLOCK_CHARS characters, read one after the other."""
    block, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        text = normal(r["text"])
        if text:
            block.append((r["item_id"], text))
            size += len(text)
            if size >= BLOCK_CHARS:
                yield Index(block, rate)
                block, size = [], 0
    if block:
        yield Index(block, rate)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """Every (document, test item) where the text holds the item within its error budget.

    Returns (doc_id, item_id, distance, start, end): the least edit distance and
    the place of the (first) best match, in characters of the normalised text.
    An item too short for an error must stand apart from letters and digits.
    Test items are read in blocks of BLOCK_CHARS characters; each block is sent to
    the executors, makes one pass over the documents, which are never shuffled,
    and is released when what it found is written.

    Null or empty texts and items match nothing; ids pass through unread, so rows
    that repeat an id give a row each, and items that repeat give a row each.
    Empty tables give an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, start long, end long"
    out = None
    for index in _blocks(items, rate):
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            own = held.value
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    rows = sorted(_search(own, part.column("text")))
                    if rows:
                        t, n, d, a, b = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(t)), pa.array([own.items[x][0] for x in n]), pa.array(d, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "item_id", "distance", "start", "end"])

        hits = staged(docs.mapInArrow(run, schema), "leaks")
        held.destroy()
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no test item, with all their columns.

    Each block of items makes one pass in which a row stays if its own text holds
    none of them; texts aren't shuffled or joined. Beyond the first block, what a
    pass kept is written before the next, so that a worker holds one block.
    Null and empty texts stay, ids aren't read, empty tables give what is left.
    """
    spark, schema, held = docs.sparkSession, docs.schema, None
    bound_batches(spark)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    for index in _blocks(items, rate):
        if held is not None:
            docs = staged(docs, "unleaked")
            held.destroy()
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            own = held.value
            for batch in batches:
                for part in slices(batch, text_col, 1 << 20):
                    keep = np.ones(part.num_rows, bool)
                    keep[[hit[0] for hit in _search(own, part.column(text_col))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
