"""SentencePiece encoding and decoding with source offsets.

``PieceModel`` reads a BPE model file. Encoding has three steps:

1. Normalisation. The compiled character map is a double-array trie followed by
   its replacement strings; at each position the longest matching prefix is
   replaced, and every byte written remembers the source byte it came from.
2. Segmentation. No piece has a word mark after another character, so merges
   never cross such a place: the normalised text is cut there and every
   distinct chunk is merged once per worker (highest score first, then
   leftmost). Characters without a piece fall back to byte pieces.
3. Projection. A piece covers a run of normalised bytes; the alignment gives
   the source bytes ``[begin, end)`` of each piece.

Decoding maps ids back to pieces, joins runs of byte pieces as UTF-8 (each bad
byte becomes U+FFFD) and drops the mark that encoding put in front.

Cases: null and empty texts have no pieces, only the end id. Repeated rows are
encoded alike; the columns of the input other than the text are untouched. The
cache of chunks is bounded in bytes, which bounds memory only.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache

MARK = "▁"
CACHE = 100 << 20             # bytes of merged chunks per worker
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NO_PIECE = float("-inf")      # the score of two parts that make no piece


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    i, n = 0, len(buf)

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = buf[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < n:
        key = varint()
        width = {0: None, 1: 8, 5: 4}.get(key & 7, -1)
        if width is None:
            yield key >> 3, varint()
            continue
        if width < 0:
            width = varint()
        yield key >> 3, buf[i:i + width]
        i += width


class CharMap:
    """The compiled character map: u32 trie size, trie units, replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size:] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest mapped prefix at ``at`` and the prefix's length."""
        if not self.units:
            return None
        found = None
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (self.units[node] & 0x7FFFFFFF, k + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.texts[start:self.texts.index(b"\0", start)], found[1]


class PieceModel:
    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.scores: list[float] = []
        self.end_id, self.unknown_id, self.dummy, self.squeeze, self.escape = 2, 0, True, True, True
        self.unknown_text, charmap, kind, suffix, fallback = " ⁇ ", b"", 1, False, False
        for field, value in _fields(blob):
            if field == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.types.append(piece[3])
            elif field == 2:
                spec = dict(_fields(value))
                kind, suffix, fallback = spec.get(3, 1), bool(spec.get(24, 0)), bool(spec.get(35, 0))
                self.unknown_id, self.end_id = spec.get(40, 0), spec.get(42, 2)
                self.unknown_text = spec.get(44, self.unknown_text.encode()).decode()
            elif field == 3:
                spec = dict(_fields(value))
                charmap = spec.get(2, b"")
                self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if kind != 2 or suffix or not self.escape or set(self.types) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with marks in front and plain pieces are read")
        self.map = CharMap(charmap)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.score = {p: self.scores[i] for p, i in self.ids.items()}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i, t in enumerate(self.types) if t == BYTE} if fallback else {}
        #: Normalised bytes that a piece covers.
        self.width = np.array([1 if t == BYTE else len(p.encode()) for p, t in zip(self.pieces, self.types)], np.int64)
        self.odd = np.array([t != NORMAL for t in self.types])
        self.cut = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.cache = Cache(CACHE)

    # -- normalisation -------------------------------------------------------
    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, its source byte."""
        data = text.encode()
        if not self.map.units and not self.squeeze:
            return self._marked(data)
        out, where, at = bytearray(), [], 0
        mark = MARK.encode()

        def prefix() -> tuple[bytes, int]:
            hit = self.map.longest(data, at)
            if hit:
                return hit
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            return data[at:at + size], size

        if self.squeeze:
            while at < len(data) and (hit := prefix())[0] == b" ":
                at += hit[1]
        if at >= len(data):
            return b"", np.array([at])
        if self.dummy:
            out += mark
            where += [at] * 3
        after_space = self.squeeze
        while at < len(data):
            new, size = prefix()
            if after_space:
                new = new.lstrip(b" ")
            if new:
                for c in new:
                    piece = mark if c == 32 else bytes((c,))
                    out += piece
                    where += [at] * len(piece)
                after_space = new.endswith(b" ")
            at += size
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(mark):
                at = where[len(out) - 3]
                del out[-3:], where[-3:]
        return bytes(out), np.array([*where, at])

    def _marked(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The same for a model without a map that keeps its spaces."""
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        where = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
        lead = 3 * self.dummy
        body = data.replace(b" ", MARK.encode())
        return MARK.encode() * self.dummy + body, np.concatenate([np.zeros(lead, np.int64), where, [len(raw)]])

    # -- segmentation --------------------------------------------------------
    def _merged(self, chunk: str) -> list[str]:
        parts, score = list(chunk), self.score
        if len(parts) > 48:
            return self._merged_long(parts)
        value = [score.get(a + b, NO_PIECE) for a, b in zip(parts, parts[1:])]
        while value and (best := max(value)) != NO_PIECE:
            at = value.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del value[at]
            if at < len(value):
                value[at] = score.get(parts[at] + parts[at + 1], NO_PIECE)
            if at:
                value[at - 1] = score.get(parts[at - 1] + parts[at], NO_PIECE)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same merges with a heap and links, in n log n."""
        n, score = len(parts), self.score
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-s, i, parts[i], parts[i + 1]) for i in range(n - 1) if (s := score.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y >= 0 and (s := score.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (-s, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def chunk_ids(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self._merged(chunk):
            found = self.ids.get(piece)
            if found is not None:
                ids.append(found)
            elif self.byte_id:
                ids += [self.byte_id[c] for c in piece.encode()]
            else:
                ids.append(self.unknown_id)
        return struct.pack(f"<{len(ids)}I", *ids)

    def segment(self, normal: bytes) -> np.ndarray:
        """Ids of a normalised text."""
        text = normal.decode()
        if not text:
            return np.zeros(0, np.uint32)
        chunks = re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text) if self.cut else [text]
        cache = self.cache
        out = list(map(cache.get, chunks))
        for at in [i for i, got in enumerate(out) if got is None]:
            chunk = chunks[at]
            got = cache.get(chunk)                  # the text may hold it twice
            if got is None:
                got = self.chunk_ids(chunk)
                if len(chunk) < 200:
                    cache.keep(chunk, got, len(chunk) + len(got))
            out[at] = got
        return np.frombuffer(b"".join(out), "<u4")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (without the end id) and the source bytes [begin, end) of each."""
        normal, where = self.normalise(text)
        ids = self.segment(normal)
        if self.byte_id or not self.odd[ids].any():
            ends = np.cumsum(self.width[ids])
        else:  # an unknown character covers its own bytes
            ends = self._unknown_ends(normal, ids)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ids) else ends.astype(np.int64)
        return ids, where[begins], where[ends.astype(np.int64)]

    def _unknown_ends(self, normal: bytes, ids: np.ndarray) -> np.ndarray:
        ends, at = [], 0
        for i in ids.tolist():
            if i == self.unknown_id:
                c = normal[at]
                at += 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            else:
                at += int(self.width[i])
            ends.append(at)
        return np.array(ends, np.int64)

    # -- decoding ------------------------------------------------------------
    def decode(self, ids: np.ndarray) -> str:
        ids = ids[ids != self.end_id]
        if not self.odd[ids].any():
            text = "".join(map(self.pieces.__getitem__, ids.tolist()))
            if self.dummy or self.squeeze:
                text = self._front(text)
            return text.replace(MARK, " ")
        out: list[str] = []
        run, started = bytearray(), False

        def flush() -> None:
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()

        def plain(stretch: list[int]) -> None:
            """Pieces of text up to the next other one; the mark that encoding put in front is dropped."""
            nonlocal started
            flush()
            k = 0
            while k < len(stretch) and (self.dummy or self.squeeze) and not started and not any(out):
                piece = self.pieces[stretch[k]]
                started = piece.startswith(MARK) and not self.squeeze
                out.append(piece.removeprefix(MARK).replace(MARK, " "))
                k += 1
            out.append("".join(map(self.pieces.__getitem__, stretch[k:])).replace(MARK, " "))

        listed, done = ids.tolist(), 0
        for at in np.flatnonzero(self.odd[ids]).tolist():
            if at > done:
                plain(listed[done:at])
            i, done = listed[at], at + 1
            kind = self.types[i]
            if kind == BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            flush()
            if kind == UNKNOWN:
                out.append(self.unknown_text.replace(MARK, " "))
        plain(listed[done:])
        return "".join(out)

    def _front(self, text: str) -> str:
        return text.lstrip(MARK) if self.squeeze else text.removeprefix(MARK)


def _utf8(data: bytes) -> str:
    """Decode with one U+FFFD for each byte that is not part of a character."""
    return "".join("\ufffd" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in data.decode("utf-8", "surrogateescape"))


@functools.lru_cache(maxsize=2)
def loaded(blob: bytes) -> PieceModel:
    """One model, with its cache of chunks, per Python worker."""
    return PieceModel(blob)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text: str = "text", offsets: bool = True, rows: int = 256,
           cache: int = CACHE) -> DataFrame:
    """Append ``ids`` (end id last) and, with ``offsets``, ``begins`` and ``ends``
    (source bytes; the end id covers the empty run at the end) to the input's
    columns. Rows leave in small batches, as their arrays are larger than the texts."""
    names = ["ids", "begins", "ends"] if offsets else ["ids"]
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept])
    for name in names:
        schema.add(name, T.ArrayType(T.IntegerType() if name == "ids" else T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(model)
        m.cache.alone().limit = cache
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                found: list[list[np.ndarray]] = [[] for _ in names]
                for t in part.column(kept.index(text)).to_pylist():
                    ids, begins, ends = m.encode(t or "")
                    size = len((t or "").encode())
                    full = (np.append(ids, m.end_id).astype(np.int32), np.append(begins, size), np.append(ends, size))
                    for place, values in zip(found, full):
                        place.append(values)
                arrays = [pa.array(x, pa.list_(pa.int32() if i == 0 else pa.int64())) for i, x in enumerate(found)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*kept, *names])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """Append ``decoded`` to rows with an array of ids."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = loaded(model)
        for batch in batches:
            yield pd.Series([None if x is None else m.decode(np.asarray(x)) for x in batch], dtype=object)

    return encoded.withColumn("decoded", run(F.col(ids)))


def round_trips(docs: DataFrame, model: bytes) -> DataFrame:
    """Encode and decode in one pass, returning only digests of the ids and texts.

    doc_id, n_tokens, ids_sha256, decoded_sha256, and covered_bytes: the source
    bytes that the pieces cover, the whole text when nothing is lost.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = loaded(model)
        m.cache.alone().limit = CACHE
        decimal = [str(i) for i in range(len(m.pieces))]
        for batch in batches:
            rows = []
            for t in batch:
                ids, begins, ends = m.encode(t or "")
                ids = np.append(ids, np.uint32(m.end_id))
                listed = " ".join(map(decimal.__getitem__, ids.tolist()))
                rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(),
                             hashlib.sha256(m.decode(ids).encode()).hexdigest(), int((ends - begins).sum())))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    return docs.select("doc_id", run("text").alias("_got")).select("doc_id", "_got.*")
