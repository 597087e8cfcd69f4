"""Package archive readers (S4, S5) and text decoding.

Input is ``binaryFile``-shaped: ``(path, content)``, e.g.
``spark.read.format("binaryFile").load(landing_dir)``. One ``mapInPandas`` pass
opens each archive and emits one row per member of interest — the manifest
and README spellings for npm tarballs, ``*.nuspec`` and ``*.md`` for NuGet zips
— together with the archive's member counts. A damaged archive gives a row
with ``error`` set instead of failing the task. Everything after that
(README choice, decoding, JSON/XML fields) is Catalyst.
"""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

MEMBER_SCHEMA = ("path string, kind string, member string, content binary, "
                 "n_members int, n_dirs int, error string")
NPM_WANTED = ("package/package.json", *C.NPM_README_NAMES)


def _tar_rows(path, data):
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
        members = tar.getmembers()
        names = [m.name for m in members]
        n_dirs = sum(1 for m in members if m.isdir())
        out = []
        for m in members:
            if m.name in NPM_WANTED and m.isfile():
                out.append((path, "npm", m.name, tar.extractfile(m).read(), len(names), n_dirs, None))
        return out or [(path, "npm", None, None, len(names), n_dirs, None)]


def _zip_rows(path, data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        n_dirs = sum(1 for i in infos if i.is_dir())
        out = []
        for i in infos:
            base = i.filename.rsplit("/", 1)[-1]
            if not i.is_dir() and (base.endswith(".nuspec") or base.endswith(".md")):
                out.append((path, "nuget", i.filename, z.read(i), len(infos), n_dirs, None))
        return out or [(path, "nuget", None, None, len(infos), n_dirs, None)]


def _read_batches(batches):
    import pandas as pd
    cols = ["path", "kind", "member", "content", "n_members", "n_dirs", "error"]
    for b in batches:
        rows = []
        for path, data in zip(b["path"], b["content"]):
            data = bytes(data) if data is not None else b""
            try:
                if data[:2] == b"PK":
                    rows.extend(_zip_rows(path, data))
                else:
                    rows.extend(_tar_rows(path, data))
            except Exception as e:  # noqa: BLE001 - a damaged archive is data, not a crash
                rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        pdf = pd.DataFrame(rows, columns=cols)
        yield pdf.astype({"n_members": "Int32", "n_dirs": "Int32"})


def archive_members(files: DataFrame) -> DataFrame:
    """S4 + S5: ``(path, kind, member, content, n_members, n_dirs, error)``."""
    return files.select("path", "content").mapInPandas(_read_batches, MEMBER_SCHEMA)


def valid_utf16(content: Column) -> Column:
    """Whether bytes are UTF-16 (big-endian without a mark): whole units, every high
    surrogate followed by a low one and every low one after a high one."""
    little = F.hex(F.substring(content, 1, 2)) == "FFFE"
    units = F.regexp_extract_all(F.hex(content), F.lit(".{4}"), F.lit(0))
    # The first two hex digits of the number that a unit writes.
    tops = F.when(little, F.transform(units, lambda u: F.substring(u, 3, 2))).otherwise(F.transform(units, lambda u: F.substring(u, 1, 2)))
    high, low = (lambda t: t.between("D8", "DB")), (lambda t: t.between("DC", "DF"))
    edge = F.array(F.lit("00"))
    paired = F.forall(F.zip_with(F.concat(edge, tops), F.concat(tops, edge), lambda a, b: high(a) == low(b)), lambda ok: ok)
    return (F.octet_length(content) % 2 == 0) & paired


def decode_utf8_or(content: Column, fallback: str = "ISO-8859-1") -> list[Column]:
    """UTF-8 when the bytes are valid UTF-8, else ``fallback`` (Latin-1 for
    npm READMEs, UTF-16 for nuspec files). Returns (text, used_fallback); bytes that
    are valid in neither have no text."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    other = F.decode(content, fallback)
    if fallback.upper() == "UTF-16":  # any bytes are Latin-1
        other = F.when(utf8.isNull() & valid_utf16(content), other)
    return [F.coalesce(utf8, other).alias("text"),
            (utf8.isNull() & content.isNotNull()).alias("used_fallback")]


def npm_packages(members: DataFrame) -> DataFrame:
    """§3.2 ingest: one npm package row per tarball — manifest fields, the first
    README spelling present (P5), decoded with the Latin-1 fallback (P6)."""
    from ..operators.normalise import npm_manifest, pick_member
    ok = members.where(F.col("error").isNull())
    counts = ok.groupBy("path").agg(F.max("n_members").alias("num_files"))
    # A manifest with bad bytes is a package without one, not the end of the job.
    man = (ok.where(F.col("member") == "package/package.json")
           .select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("manifest")))
    man = npm_manifest(man, "manifest")
    readme = pick_member(ok.where(F.col("member").isNotNull()), "path", list(C.NPM_README_NAMES))
    readme = readme.select("path", *decode_utf8_or(F.col("content"))).withColumnRenamed(
        "text", "readme").withColumnRenamed("used_fallback", "readme_latin")
    return (counts.join(man, "path", "left").join(readme, "path", "left")
            .select("path", F.coalesce("name", F.lit("")).alias("name"),
                    F.coalesce("description", F.lit("")).alias("description"),
                    F.coalesce("homepage_domain", F.lit("")).alias("homepage_domain"),
                    F.coalesce("repo_url", F.lit("")).alias("repo_url"),
                    F.coalesce("readme", F.lit("")).alias("readme"),
                    F.coalesce("readme_latin", F.lit(False)).alias("readme_latin"), "num_files"))
