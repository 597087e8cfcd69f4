"""Token ids in fixed-width bit-packed files.

A shard file is a run of blocks, each ended by a newline byte, and a footer:

* block: ``FWB1``, u8 bits, u32 documents, u64 ids, u32 CRC-32 of the rest;
  then i64 document ids (with a u8 null flag each), u64 id positions (one more
  than documents) and the ids, ``bits`` bits each, least significant first.
* footer: ``FWBI``, u32 blocks, u64 byte offset of each block, u64 id position
  of each block and one more, u64 bytes of the footer.

``bits`` is the least number of bits that holds every id of the vocabulary.
All numbers are little-endian. A reader finds a block by the footer, and an id
by ``position * bits``; unpacking is vectorised.

Documents are range-partitioned and sorted by (doc_id, hash of the text), so
shards in name order hold ascending ids. Files go through Spark's text writer,
one row a block, so the output committer drops what lost or repeated tasks
wrote, and any store that Spark writes will do.

Cases: a null or empty text has the end id only. Null document ids come first.
Repeated rows are all written. A text beyond ``BLOCK_IDS`` ids is one block. An
empty table gives no shard and no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Cache, fresh_path, written

BLOCK_IDS = 1 << 20
CACHE = 100 << 20             # bytes of encoded words per worker
HEAD = struct.Struct("<4sBIQI")


def min_bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of packed data, touching only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", stop - start, start * (bits // 8)).astype("<u4")
    first, last = start * bits // 8, -(-stop * bits // 8)
    raw = np.unpackbits(np.frombuffer(data, np.uint8, last - first, first), bitorder="little")
    at = start * bits - first * 8
    planes = raw[at:at + (stop - start) * bits].reshape(-1, bits).astype(np.uint32)
    return (planes << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def block(bits: int, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    at = np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes()
    body = nulls + keys + at + pack(ids, bits)
    return HEAD.pack(b"FWB1", bits, len(doc_ids), len(ids), zlib.crc32(body)) + body


class Shard:
    """Random access to the bytes of one shard file."""

    def __init__(self, data: bytes):
        self.data = data
        end = len(data) - 1  # the newline after the footer
        size = struct.unpack_from("<Q", data, end - 8)[0]
        magic, n = struct.unpack_from("<4sI", data, end - size)
        if magic != b"FWBI":
            raise ValueError("not a shard of packed ids")
        self.offsets = np.frombuffer(data, "<u8", n, end - size + 8)
        self.positions = np.frombuffer(data, "<u8", n + 1, end - size + 8 + 8 * n)

    def docs(self, k: int) -> tuple[list[int | None], np.ndarray, int, int]:
        """Document ids and id positions of block k, its bits, and where its ids start."""
        at = int(self.offsets[k])
        magic, bits, n, _, _ = HEAD.unpack_from(self.data, at)
        if magic != b"FWB1":
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        nulls = np.frombuffer(self.data, np.uint8, n, at)
        keys = np.frombuffer(self.data, "<i8", n, at + n)
        starts = np.frombuffer(self.data, "<u8", n + 1, at + 9 * n).astype(np.int64)
        return [None if z else int(d) for z, d in zip(nulls, keys)], starts, bits, at + 9 * n + 8 * (n + 1)

    def check(self, k: int) -> None:
        at = int(self.offsets[k])
        _, bits, n, ids, crc = HEAD.unpack_from(self.data, at)
        size = 9 * n + 8 * (n + 1) + -(-ids * bits // 8)
        if zlib.crc32(memoryview(self.data)[at + HEAD.size:at + HEAD.size + size]) != crc:
            raise ValueError(f"block {k} fails its checksum")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the whole shard."""
        out = []
        k = int(np.searchsorted(self.positions, start, "right")) - 1
        while start < stop:
            base, end = int(self.positions[k]), min(stop, int(self.positions[k + 1]))
            _, _, bits, at = self.docs(k)
            out.append(unpack(memoryview(self.data)[at:], bits, start - base, end - base))
            start, k = end, k + 1
        return np.concatenate(out) if out else np.zeros(0, "<u4")


class WordEncoder:
    """A tokenizers file whose words are encoded once per worker.

    White space ends every pre-token of the file's pipeline and no rule looks
    across it, so a text's ids are its words' ids in order. Words of letters
    below U+0250 are keyed in lower case, as the pipeline lowers them one by
    one. A ``.`` or ``,`` between a letter and white space is a pre-token of its
    own, so it is parted from its word in one pass over the text and both are
    looked up. A text that holds an added token goes to the library whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words = Cache(CACHE)
        # Lower-case letters that the file's normalizer leaves alone and its pre-tokenizer keeps within
        # a run of letters, with what the model sees of each: such words go to the model at once.
        seen = {}
        for c in map(chr, range(0x61, 0x250)):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(f"a{c}a")
            if c.isalpha() and self.library.normalizer.normalize_str(f"a{c}a") == f"a{c}a" and len(pieces) == 1:
                seen[c] = pieces[0][0][1:-1]
        letters = "[" + "".join(seen) + "]"
        self.plain, self.seen = re.compile(letters + "+"), str.maketrans(seen)
        self.stop = re.compile(rf"[.,](?<={letters}.)(?=[ \n]|\Z)")
        self.beyond = re.compile("[\u0250-\U0010ffff]")

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if self.plain.fullmatch(word):
            got = array("I", [t.id for t in self.library.model.tokenize(word.translate(self.seen))]).tobytes()
        else:
            got = self._whole(word)
        return self.words.keep(word, got, len(word) + len(got)) if len(word) < 200 else got

    def encode(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.frombuffer(self._whole(text), "<u4")
        if text.isascii() or not self.beyond.search(text):
            text = text.lower()
        words = self.stop.sub(r" \g<0>", text).replace("\n", " ").split(" ")
        out = list(map(self.words.get, words))
        for i, got in enumerate(out):
            if got is None:
                w = words[i]
                out[i] = (self.words.get(w) or self._word(w)) if w else b""
        return np.frombuffer(b"".join(out), "<u4")


@functools.lru_cache(maxsize=2)
def encoder(spec: str) -> WordEncoder:
    return WordEncoder(spec)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Encode ``doc_id, text`` and write the shards; returns their folder."""
    path = path or fresh_path(docs.sparkSession, "token-shards")
    bits = min_bits(max(encoder(tokenizer).vocabulary, end_id + 1))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        enc.words.alone()
        keys, parts, held = [], [], 0
        offsets, positions, at = [], [0], 0

        def cut() -> bytes:
            nonlocal at, held
            data = block(bits, keys, [len(p) for p in parts], np.concatenate(parts))
            offsets.append(at)
            positions.append(positions[-1] + held)
            at += len(data) + 1
            keys.clear()
            parts.clear()
            held = 0
            return data

        for batch in batches:
            for d, t in zip(batch["doc_id"], batch["text"]):
                ids = np.append(enc.encode(t) if t else np.zeros(0, "<u4"), np.uint32(end_id))
                keys.append(None if pd.isna(d) else int(d))
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield pd.DataFrame({"value": [cut()]})
        if parts:
            yield pd.DataFrame({"value": [cut()]})
        if offsets:
            foot = struct.pack("<4sI", b"FWBI", len(offsets)) + np.array(offsets, "<u8").tobytes() + np.array(positions, "<u8").tobytes()
            yield pd.DataFrame({"value": [foot + struct.pack("<Q", len(foot) + 8)]})

    # The hash only orders repeated ids, and lets many rows of one id part.
    rows = docs.select(F.col("doc_id").cast("long").cast("decimal(20,0)").alias("_d"), "text", F.xxhash64("text").alias("_h"))
    ordered = rows.repartitionByRange("_d", "_h").sortWithinPartitions("_d", "_h")
    (ordered.select(F.col("_d").cast("string").alias("doc_id"), "text").mapInPandas(blocks, "value binary")
     .select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path))
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the shards: shard, position (in it), doc_id, n_tokens, ids."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                for k, docs, starts, ids in _documents(data):
                    yield pd.DataFrame({"shard": name, "position": starts[:-1] + k, "doc_id": pd.array(docs, "Int64"),
                                        "n_tokens": np.diff(starts), "ids": np.split(ids.astype(np.int32), starts[1:-1])})

    return _files(spark, path).mapInPandas(rows, "shard string, position long, doc_id long, n_tokens long, ids array<int>")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .where("length > 0").select("path", "content"))


def _documents(data: bytes) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray]]:
    """Block by block: position of the block, documents, starts in the block, ids."""
    shard = Shard(data)
    for k in range(len(shard.offsets)):
        shard.check(k)
        docs, starts, _, _ = shard.docs(k)
        first, last = int(shard.positions[k]), int(shard.positions[k + 1])
        yield first, docs, starts, shard.ids(first, last)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the shards.

    Only one number per shard is summed up in order; documents never meet.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                for k, docs, starts, ids in _documents(data):
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, starts[1:])]
                    yield pd.DataFrame({"shard": name, "position": starts[:-1] + k, "doc_id": pd.array(docs, "Int64"),
                                        "n_tokens": np.diff(starts), "ids_crc32": np.array(crc, np.int64)})

    got = written(_files(spark, path).mapInPandas(
        rows, "shard string, position long, doc_id long, n_tokens long, ids_crc32 long"), "token-digests")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = got.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    bases = written(shards.select("shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base")), "token-bases")
    return got.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")
