"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .words import slices

#: Counts of distinct chunks that a worker keeps, at most; it then starts anew.
CACHE = 400_000
#: Fixed value: the split that the byte-level pre-tokenizer uses.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that print stand for themselves; the others take the code points from
    256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + spare))
            spare += 1
    return out


class Counter:
    """Counts the tokens of texts for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.symbol = byte_symbols()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.split = regex.compile(SPLIT)
        # a single space between two characters that aren't white space: no token runs across
        self.seam = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
        self.chunks: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Initial symbols minus merges of one pre-token."""
        known = self.pieces.get(text)
        if known is not None:
            return known
        symbol = [self.symbol[b] for b in text.encode()]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, merges = self.rank, 0
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one side has been merged since
            symbol[i], symbol[j] = left + right, ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbol[i], symbol[k]))
            if (h := before[i]) >= 0 and (r := rank.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (r, h, symbol[h], symbol[i]))
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        if n <= 64:
            self.pieces[text] = n - merges
        return n - merges

    def chunk(self, text: str) -> int:
        return sum(map(self.piece, self.split.findall(text)))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, known, lead = 0, self.chunks, ""
        for part in self.seam.split(text):
            got = known.get(lead + part)
            if got is None:
                got = self.chunk(lead + part)
                if len(known) >= CACHE:
                    known.clear()
                if len(part) <= 64:
                    known[lead + part] = got
            total += got
            lead = " "
        return total

    def count(self, text: str) -> int:
        """A special string in the text is one token, as the library has it by default."""
        if self.cut is None or not any(t in text for t in self.special):
            return self.plain(text) if text else 0
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(self.plain(x) for x in parts if x)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every whole text: (doc_id, n_bytes, n_tokens, over_limit).

    A null text is empty and has 0 tokens. Ids pass through unread, so nulls and
    repeats are as they were; an empty table gives an empty one; other columns
    are ignored. `path` names a vocabulary file that every executor can open. One
    worker's caches hold CACHE entries each at most.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        own = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = ["" if t is None else t for t in part.column("text").to_pylist()]
                n = np.fromiter(map(own.count, texts), np.int64, len(texts))
                size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
