"""Token-id files of bit-plane shuffled, zstandard-compressed blocks.

A file holds, in this order (all numbers little-endian):

    magic           8 bytes, b"SLTOKEN1"
    blocks          one after the other; a block is its planes, one after the
                    other, each a zstandard frame
    block index     for each block: u64 offset, u32 ids, u8 kind, u8 planes,
                    then u32 length of each plane
    text index      zstandard frame of i64 doc_id (null: 0) and u32 ids of each
                    text, then a bit of each text that is set for a null doc_id
    footer          u64 offset of the block index, u64 offset of the text index,
                    u64 blocks, u64 texts, u64 ids, magic

Kind 0 cuts the ids into byte planes, kind 1 into bit planes (the lowest first,
as many as the largest id of the block needs). Blocks hold BLOCK ids, the last of a file the rest.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bound_batches, new_path, staged
from .counts import byte_symbols
from .words import slices

MAGIC = b"SLTOKEN1"
BLOCK = 1 << 16
FOOTER = struct.Struct("<5Q8s")
#: Distinct words whose ids a worker keeps, at most: about 150 bytes each.
CACHE = 300_000
#: Fixed value: the split that keeps letters, digits and other signs apart.
APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Signs of ASCII but for the apostrophe, which the split joins to letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A run of them at the end of a word, behind a letter (Latin-1) or digit.
TAIL = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([" + re.escape(SIGNS) + r"]+)(\s|$)"
#: Letters that are their own lower case and composed form, whatever stands beside them.
PLAIN = "[a-z\u00df-\u00f6\u00f8-\u00ff]+"
#: Bytes of text that one file is meant to hold.
FILE_BYTES = 32 << 20


def planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block of ids, lowest first; as many as its largest id needs."""
    top = int(ids.max(initial=0))
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [wide[:, k].tobytes() for k in range(max(1, -(-top.bit_length() // 8)))]
    bits = np.unpackbits(wide, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(max(1, top.bit_length()))]


def unplanes(parts: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        wide = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(parts):
            wide[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(parts):
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        wide = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(wide).view("<u4").ravel()


class Writer:
    """Writes one file, block by block; what it holds is one block and the index."""

    def __init__(self, out, kind: str = "byte", level: int = 3):
        self.out, self.kind, self.pack = out, kind, zstandard.ZstdCompressor(level=level)
        self.at, self.rest, self.index, self.docs, self.sizes, self.ids = 8, [], [], [], [], 0
        self.held = 0
        out.write(MAGIC)

    def text(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= BLOCK:
            all_ = np.concatenate(self.rest)
            for k in range(0, len(all_) - BLOCK + 1, BLOCK):
                self._block(all_[k : k + BLOCK])
            self.rest = [all_[len(all_) // BLOCK * BLOCK :]]
            self.held = len(self.rest[0])

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.pack.compress(p) for p in planes(ids, self.kind)]
        self.index.append(struct.pack("<QIBB", self.at, len(ids), self.kind == "bit", len(packed)) + struct.pack(f"<{len(packed)}I", *map(len, packed)))
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        blocks = b"".join(self.index)
        null = np.packbits([d is None for d in self.docs], bitorder="little") if self.docs else np.zeros(0, np.uint8)
        texts = self.pack.compress(np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.sizes, "<u4").tobytes() + null.tobytes())
        self.out.write(blocks + texts + FOOTER.pack(self.at, self.at + len(blocks), len(self.index), len(self.docs), self.ids, MAGIC))


class Reader:
    """Reads a file from its index, a block at a time, or one text by its number."""

    def __init__(self, file):
        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - FOOTER.size)
        blocks_at, texts_at, blocks, texts, self.ids, magic = FOOTER.unpack(file.read(FOOTER.size))
        file.seek(0)
        if magic != MAGIC or file.read(8) != MAGIC:
            raise ValueError("no token file, or a file cut short")
        file.seek(blocks_at)
        index = file.read(texts_at - blocks_at)
        own = self.unpack.decompress(file.read(size - FOOTER.size - texts_at))
        self.doc_id = np.frombuffer(own, "<i8", texts)
        self.size = np.frombuffer(own, "<u4", texts, 8 * texts).astype(np.int64)
        self.null = np.unpackbits(np.frombuffer(own, np.uint8, -1, 12 * texts), count=texts, bitorder="little").astype(bool)
        self.end = np.cumsum(self.size)
        self.blocks, at = [], 0
        for _ in range(blocks):
            offset, n, bit, k = struct.unpack_from("<QIBB", index, at)
            self.blocks.append((offset, n, "bit" if bit else "byte", struct.unpack_from(f"<{k}I", index, at + 14)))
            at += 14 + 4 * k
        self.block_end = np.cumsum([b[1] for b in self.blocks], dtype=np.int64)

    def block(self, k: int) -> np.ndarray:
        offset, n, kind, sizes = self.blocks[k]
        self.file.seek(offset)
        return unplanes([self.unpack.decompress(self.file.read(s)) for s in sizes], n, kind)

    def text(self, k: int) -> np.ndarray:
        """Ids of the k-th text, read from its blocks alone."""
        high, n = int(self.end[k]), int(self.size[k])
        if not n:
            return np.zeros(0, np.uint32)
        first, last = np.searchsorted(self.block_end, [high - n, high - 1], "right")
        held = np.concatenate([self.block(int(i)) for i in range(first, last + 1)])
        skip = high - n - (int(self.block_end[first - 1]) if first else 0)
        return held[skip : skip + n]

    def texts(self):
        """(number, ids) of every text, in order."""
        held, block = np.zeros(0, np.uint32), 0
        for k, n in enumerate(self.size):
            if len(held) < n:
                more = [held]
                have = len(held)
                while have < n:
                    more.append(self.block(block))
                    have += len(more[-1])
                    block += 1
                held = np.concatenate(more)
            yield k, held[:n]
            held = held[n:]


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once.

    Only for vocabularies whose pre-tokenizer drops white space: there the ids of
    a text are those of its words (split at 0x20 and 0x09-0x0D), one after the
    other; where letters and signs are kept apart, so is a run of signs at the
    end of a word, and A-Z may be folded before, but where an added string may
    stand. Other vocabularies are encoded text by text.

    A word of the letters in PLAIN is its own normal form and one pre-token, so it
    goes straight to the library's model, which is most of the work saved.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        cut = pre.get("pretokenizers") or [{}]
        # the matches stay and no match holds white space; added strings hold none either and keep their surroundings
        self.by_word = cut[0].get("behavior") == "Removed" and cut[0].get("invert") is True and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] or set(t["content"]) & set(" \t\n\v\f\r") for t in spec["added_tokens"])
        self.first = sorted({t["content"][:1] for t in spec["added_tokens"]})
        # signs behind a word are then a word of their own, and case doesn't count
        self.apart = self.by_word and cut[0].get("pattern") == {"Regex": APART} and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        bytewise = [x["type"] for x in cut[1:]] == ["ByteLevel"] and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        self.plain = re.compile(PLAIN).fullmatch if self.apart and bytewise else None
        self.model, self.symbol = self.lib.model, byte_symbols()
        self.known: dict[str, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _lib(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, one after the other, and the number of each."""
        flat: list[int] = []
        size: list[int] = []
        other = []
        plain, model, symbol = self.plain, self.model, self.symbol
        for w in words:
            if plain and plain(w):
                own = model.tokenize(w if w.isascii() else "".join([symbol[b] for b in w.encode()]))
                flat += [t.id for t in own]
                size.append(len(own))
            else:
                other.append(w)
                size.append(-1)
        n = np.array(size, np.int64)
        if not other:
            return np.array(flat, np.uint32), n
        more = self._lib(other)
        late = n < 0
        n[late] = [len(x) for x in more]
        out, mine = np.zeros(int(n.sum()), np.uint32), np.repeat(late, n)
        out[~mine] = flat
        out[mine] = [x for ids in more for x in ids]
        return out, n

    def _of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each of some distinct words begin, how many they are, and the ids.

        A word is kept while fewer than CACHE are; the first met are the common ones.
        """
        known = self.known
        place = np.array([known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(place < 0)
        start, size, flat = self.start, self.size, self.flat
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            ids, n = self._ids(fresh)
            place[new] = len(size) + np.arange(len(new))
            start = np.concatenate([start, len(flat) + np.cumsum(n) - n])
            size = np.concatenate([size, n])
            flat = np.concatenate([flat, ids])
            room = max(0, CACHE - len(known))
            if room:
                known.update(zip(fresh[:room], place[new][:room].tolist(), strict=True))
                keep = len(self.size) + min(room, len(fresh))
                self.start, self.size = start[:keep].copy(), size[:keep].copy()
                self.flat = flat[: int(self.start[-1] + self.size[-1])].copy()
        return start[place], size[place], flat

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each; a null is an empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_word:
            ids = self._lib(texts.to_pylist())
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((x for i in ids for x in i), np.uint32, int(n.sum())), n
        if self.apart:  # texts that may hold an added string keep their words, and words that may, their case
            split = pc.replace_substring_regex(texts, TAIL, r"\1 \2\3")
            texts = pc.if_else(self._marked(texts), texts, split)
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        if self.apart:
            flat = pc.if_else(self._marked(flat), flat, pc.ascii_lower(flat))
        coded = flat.dictionary_encode()  # white space at the ends of a text gives empty words, which have no ids
        start, size, known = self._of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        of = coded.indices.to_numpy()
        start, size = start[of], size[of]
        end = np.cumsum(size)
        out = known[np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
        cut = np.concatenate([[0], end])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return out, np.diff(cut)

    def _marked(self, texts: pa.Array) -> pa.Array:
        """Whether each text holds the first sign of an added string."""
        out = pa.array(np.zeros(len(texts), bool))
        for sign in self.first:
            out = pc.or_(out, pc.match_substring(texts, sign))
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def write_token_files(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, kind: str = "byte") -> DataFrame:
    """Encode every whole text, append `end_id`, and write files in ascending id order.

    Runs the job and returns the files' table: (file, n_texts, n_ids, start), in
    order, `start` being the ids of all files before. Null texts are empty; null
    ids come first; rows that repeat an id (or have none) lie next to each other,
    by the digest of their text, and may go on in the next file. An empty table
    writes no file. A file is written under another name and then
    moved, so a task that is run again replaces it with the same bytes. `out` is
    a URI that the executors' pyarrow can open (file, hdfs, s3, gs).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    at = fs.FileSystem.from_uri(out)
    at[0].create_dir(at[1], recursive=True)

    def run(batches):
        store, folder = fs.FileSystem.from_uri(out)
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}.tokens"
        own, writer, temp = tokenizer(path), None, f"{name}.{task.taskAttemptId()}"
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    file = store.open_output_stream(temp)
                    writer = Writer(file, kind)
                ids, n = own.encode(part.column("text"))
                at = np.concatenate([[0], np.cumsum(n)])
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    writer.text(doc, np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)))
        if writer is not None:
            writer.close()
            file.close()
            store.move(temp, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(writer.docs)]), pa.array([writer.ids])], ["file", "n_texts", "n_ids"])

    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    bound_batches(spark)
    dealt = docs.repartitionByRange(files, *key).sortWithinPartitions(*key, "text")
    rows = staged(dealt.mapInArrow(run, "file string, n_texts long, n_ids long"), "token_file_rows")
    before = F.sum("n_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))  # a row for each file
    return staged(rows.withColumn("start", F.coalesce(before, F.lit(0))), "token_file_table").repartitionByRange(files, "file")


def read_token_files(files: DataFrame, out: str) -> DataFrame:
    """Read files back: (doc_id, start, n_tokens, ids_crc32), one row for each text, null ids too."""

    def run(batches):
        store, _ = fs.FileSystem.from_uri(out)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(name) as file:
                    r = Reader(file)
                    crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in r.texts()), np.int64, len(r.size))
                yield pa.RecordBatch.from_arrays([pa.array(r.doc_id, pa.int64(), mask=r.null), pa.array(start + r.end - r.size), pa.array(r.size), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, kind: str = "byte") -> DataFrame:
    """Write the files to the shared folder and return what reading them back gives."""
    spark: SparkSession = docs.sparkSession
    out = new_path(spark, "tokens")
    out = out if "://" in out else f"file://{out.removeprefix('file:')}"
    return read_token_files(write_token_files(docs, path, out, id_col, text_col, end_id, kind), out)
