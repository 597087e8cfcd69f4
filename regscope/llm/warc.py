"""WARC archives: writing with revisit records, and a salvage reader.

Writing. Payloads are hashed (SHA-1); of records with equal payloads the one
with the smallest id is a ``response``, the others are ``revisit`` records that
refer to it and carry no payload. Payloads below ``least_bytes`` are all
responses. Each record is a gzip member of its own. Files go through Spark's
text writer, one record a row: its separator is an empty gzip member, which
every gzip reader passes over, so lost or repeated tasks leave no trace.

Reading. Files are read whole by Spark's ``binaryFile`` source and parsed
record by record. A record is checked: member CRC, version line, headers,
length, block digest, trailing blank lines. When a check fails the reader
searches for the next place where a member opens with a version line (or, in
plain files, for the next version line that parses), goes on from there, and
logs the bytes between as a quarantined gap with the reason.

Cases: a null payload is empty. Null ids are written without an id and read
back as null; they count as the largest id when a response is chosen. Repeated
rows are records of their own. An empty table writes no records. Very long
payloads are one record; files roll after ``records_per_file`` records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh_path, written

EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = re.compile(rb"WARC/(0\.1[78]|1\.[01])\r?\n")
MAGIC = b"\x1f\x8b\x08"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits at a time, by base conversion."""
    hexes = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(hexes, 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.upper(F.concat(*[part(i) for i in range(4)])), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def plan_records(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record_id, uri, payload -> adds payload_bytes, payload_digest, record_type, refers_to.

    Only digests shared by several records are joined back, from a written table:
    within a checked size it is broadcast and the payloads stay where they are;
    beyond it they are shuffled by digest and adaptive execution splits the hot one.
    """
    hashed = rows.select("record_id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload"))
    hashed = hashed.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"),
                           base32_sha1(F.col("payload")).alias("payload_digest"))
    shared = written(
        hashed.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(F.min("record_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("payload_digest", "first"), "warc-shared")
    first = F.when(F.col("payload_bytes") >= least_bytes, F.col("first"))
    revisit = F.coalesce(first.isNotNull() & (F.col("record_id").isNull() | (first != F.col("record_id"))), F.lit(False))
    return (hashed.join(broadcast_if_small(shared), "payload_digest", "left")
            .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first"))


def record_bytes(kind: str, record_id: int | None, uri: str | None, payload: bytes, digest: str, size: int,
                 refers_to: int | None, date: str) -> bytes:
    """One WARC 1.1 record. The block of a revisit is empty; digest and length describe the full payload."""
    block = b"" if kind == "revisit" else payload
    own = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    if record_id is not None:
        lines.append(f"WARC-Record-ID: <urn:record:{record_id}>")
    lines += [f"WARC-Date: {date}", f"WARC-Block-Digest: sha1:{own}", f"WARC-Payload-Digest: sha1:{digest}",
              f"X-Payload-Length: {size}", f"Content-Length: {len(block)}"]
    if uri:
        lines.append("WARC-Target-URI: " + re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", uri))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:record:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str | None = None, level: int = 1, records_per_file: int = 20_000,
               date: str = "2000-01-01T00:00:00Z") -> str:
    """Write planned records; returns the folder of the archives."""
    path = path or fresh_path(records.sparkSession, "warc")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for kind, rid, uri, payload, digest, size, refers in batch.itertuples(index=False):
                raw = record_bytes(kind, None if rid is None else int(rid), uri, bytes(payload or b""), digest, size,
                                   None if refers is None else int(refers), date)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.append(z.compress(raw) + z.flush())
            yield pd.DataFrame({"value": out})

    # Revisits carry no payload into the Python workers. Ids go as text: nulls stay exact.
    rows = records.select("record_type", F.col("record_id").cast("string"), "uri",
                          F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"),
                          "payload_digest", "payload_bytes", F.col("refers_to").cast("string"))
    (rows.mapInPandas(members, "value binary").select(F.col("value").cast("string")).write
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", records_per_file).text(path))
    return path


@dataclass
class Salvage:
    """The records and quarantined gaps of one archive, in file order."""

    data: bytes
    gaps: list[tuple[int, int, str]] = field(default_factory=list)

    def records(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """(offset, headers by lower-case name, block) of each good record."""
        at, end = 0, len(self.data)
        while at < end:
            try:
                nxt, headers, block = self._member(at) if self.data.startswith(MAGIC, at) else self._plain(self.data, at)
            except ValueError as fault:
                nxt = self._resume(at + 1)
                if self.gaps and self.gaps[-1][1] == at:
                    self.gaps[-1] = (self.gaps[-1][0], nxt, self.gaps[-1][2])
                else:
                    self.gaps.append((at, nxt, str(fault)))
                at = nxt
                continue
            if headers is not None:
                yield at, headers, block
            at = nxt

    def _member(self, at: int) -> tuple[int, dict[str, str] | None, bytes]:
        z = zlib.decompressobj(31)
        view, out, pos = memoryview(self.data), [], at
        try:
            while not z.eof and pos < len(self.data):
                piece = view[pos:pos + (1 << 16)]
                out.append(z.decompress(piece))
                pos += len(piece)
        except zlib.error as fault:
            raise ValueError(f"gzip: {fault}") from None
        if not z.eof:
            raise ValueError("gzip: member is cut off")
        stop = pos - len(z.unused_data)
        raw = b"".join(out)
        if not raw:
            return stop, None, b""
        used, headers, block = self._plain(raw, 0)
        if used != len(raw):
            raise ValueError("member holds more than a record")
        return stop, headers, block

    @staticmethod
    def _plain(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
        version = VERSION.match(data, at)
        if not version:
            raise ValueError("no version line")
        stop = re.compile(rb"\r?\n\r?\n").search(data, version.end() - 2)
        if not stop:
            raise ValueError("headers are cut off")
        headers: dict[str, str] = {}
        last = ""
        for line in data[version.end():stop.start()].decode("utf-8", "replace").splitlines():
            if line[:1] in " \t" and last:
                headers[last] += " " + line.strip()
            elif ":" in line:
                last, value = line.split(":", 1)
                last = last.strip().lower()
                headers[last] = value.strip()
            else:
                raise ValueError("a header line without a name")
        size = headers.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            raise ValueError("no content length")
        block = data[stop.end():stop.end() + int(size)]
        after = stop.end() + int(size)
        if len(block) < int(size):
            raise ValueError("block is cut off")
        tail = re.compile(rb"\r?\n\r?\n").match(data, after)
        if not tail:
            raise ValueError("no blank lines after the block")
        kind, _, digest = headers.get("warc-block-digest", "").partition(":")
        if kind.lower() == "sha1" and digest != base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError("block digest differs")
        return tail.end(), headers, block

    def _resume(self, at: int) -> int:
        """The next member that opens with a version line, or version line outside members."""
        while True:
            member = self.data.find(MAGIC, at)
            line = VERSION.search(self.data, at, member + 16 if member >= 0 else len(self.data))
            if line and (member < 0 or line.start() < member):
                return line.start()
            if member < 0:
                return len(self.data)
            try:
                head = zlib.decompressobj(31).decompress(memoryview(self.data)[member:member + 4096], 64)
            except zlib.error:
                head = b""
            if VERSION.match(head):
                return member
            at = member + 1


SCHEMA = ("archive string, offset long, record_id long, record_type string, uri string, payload_bytes long, "
          "payload_digest string, refers_to long, payload binary, gap_end long, fault string")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``; a gap has ``fault`` set and
    covers the bytes [offset, gap_end)."""

    def number(text: str | None) -> int | None:
        found = re.search(r"(?:^|:)(-?\d+)>?$", text or "")
        return int(found[1]) if found else None

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                salvage, out = Salvage(bytes(data)), []

                def frame() -> pd.DataFrame:
                    got = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                    out.clear()
                    return got.astype({c: "Int64" for c in ("record_id", "payload_bytes", "refers_to", "gap_end")})

                held = 0
                for at, h, block in salvage.records():
                    kind = h.get("warc-type", "")
                    digest = h.get("warc-payload-digest", "").partition(":")[2]
                    size = number(h.get("x-payload-length")) if kind == "revisit" else len(block)
                    if kind == "response":
                        digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                    out.append((name, at, number(h.get("warc-record-id")), kind, h.get("warc-target-uri"), size, digest,
                                number(h.get("warc-refers-to")), block if payloads else None, None, None))
                    held += len(block) * payloads + 500
                    if held > 8 << 20:
                        yield frame()
                        held = 0
                out += [(name, a, None, None, None, None, None, None, None, b, why) for a, b, why in salvage.gaps]
                yield frame()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).where("length > 0")
    return files.select("path", "content").mapInPandas(rows, SCHEMA)
