"""Stand-in inputs derived from the landed tables (FIXTURES.md §3–4).

``packages`` is the image-registry document table the pipelines score. It is
built from ``documents`` (text, author), ``pages`` (link targets), ``events``
(release time) and ``labels``; its size grows with all of them. The small
companions are lookup tables of fixed size (rank list, URL lists) or
projections of ``packages`` and the landed tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches
from .tables import table


def _link_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: up to four links to pages, in slot order, as one string."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # Scalar subquery, evaluated once; page ids are dense from 0.
    n_pages = table(spark, sf_dir, "pages").select(F.count(F.lit(1))).scalar()
    slots = F.when(F.col("doc_id") % 5 > 0,
                   F.sequence(F.lit(0), (F.col("doc_id") % 5 - 1).cast("int")))
    refs = (docs.select("doc_id", F.explode(slots).alias("k"))
            .withColumn("page_id", (F.col("doc_id") * (F.col("k") + 1)) % n_pages))
    piece = (F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("[ref]("), F.col("url"), F.lit(") ")))
             .when(F.col("doc_id") % 11 == 0, F.concat(F.lit('<a href="'), F.col("url"), F.lit('">x</a> ')))
             .otherwise(F.concat(F.col("url"), F.lit(" "))))
    pieces = refs.join(pages, "page_id").select("doc_id", F.struct("k", piece.alias("piece")).alias("p"))
    # At most four pieces per document: a bounded list, sorted by slot.
    return pieces.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda s: s["piece"]), "").alias("block"))


def packages(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The normalised ``packages`` table.

    Built once per input snapshot and written as parquet under the shared
    checkpoint directory (ingest -> normalised table, SURVEY §3.2); every
    query then scans it with column pruning and filter push-down instead of
    re-running the joins that assemble it.
    """
    if not materialize:
        return packages_plan(spark, sf_dir)
    from .store import materialized
    return materialized(spark, "packages", sf_dir, ["documents", "pages", "labels", "events"],
                        lambda: packages_plan(spark, sf_dir))


def packages_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivation itself (one row per image document)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts"))
    d = F.col("doc_id")
    sid = d.cast("string")
    nl = F.lit("\n")
    full = F.concat(
        F.col("text"), nl, F.coalesce(F.col("block"), F.lit("")),
        F.when((d % 3 == 0) & (d % 5 > 0), F.concat(F.lit("https://bit.ly/"), sid, F.lit(" "))).otherwise(F.lit("")),
        F.when((d % 4 == 0) & (d % 5 > 0), F.lit("https://hub.docker.com/r/x ")).otherwise(F.lit("")),
        F.when(d % 9 == 1, F.lit("https://cdn.example.org/a.png https://cdn.example.org/a.png ")).otherwise(F.lit("")),
        F.when(d % 6 == 0, F.concat(nl, F.lit("```"), nl, F.lit("run"), nl, F.lit("```"))).otherwise(F.lit("")))
    # The narrow sides meet first, so the text takes part in one join only.
    narrow = (_link_block(spark, sf_dir).join(labels, "doc_id", "full_outer").join(events, "doc_id", "full_outer"))
    return (docs.join(narrow, "doc_id", "left")
            .select(
                d.alias("package_id"),
                F.when(d % 89 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("namespace"),
                F.when(d % 97 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("pkg-"), sid)).alias("name"),
                F.concat_ws(" ", F.lit("package of"), "source", F.lit("in"), "lang").alias("description"),
                F.when(d % 53 == 0, F.lit(None).cast("string")).otherwise(full).alias("full_description"),
                ((d * 7919) % 100003).alias("pull_count"),
                F.when(d % 13 == 0, F.lit("official")).otherwise(F.lit("community")).alias("filter_type"),
                F.when(d % 4 == 0, F.lit("")).when(d % 4 == 1, F.lit("https://www.example.net/x"))
                 .when(d % 4 == 2, F.lit("https://docs.example.org")).alias("homepage"),
                F.when(d % 5 < 2, F.lit("git+https://github.com/u/p.git")).otherwise(F.lit("")).alias("repo_url"),
                F.when(d % 3 == 0, F.concat(F.col("source"), F.lit("@example.com")))
                 .when(d % 3 == 1, F.concat(F.col("source"), F.lit("@mail.example.com")))
                 .otherwise(F.lit("")).alias("user_email"),
                F.col("ts").alias("release_ts"),
                F.col("lang"),
                F.when(F.col("quality") == 0, F.lit("abuse"))
                 .when(F.col("quality") == 1, F.lit("non-abuse")).alias("label")))


# --- small companions -------------------------------------------------------
# FIXED VALUES — stand-in domain ranks (example.org is deliberately unranked)
RANK_ROWS = [("example.com", 120), ("example.net", 45000), ("docker.com", 350),
             ("github.com", 60), ("bit.ly", 900)]


def rank_domain(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("domain", T.StringType()), T.StructField("rank", T.LongType())])
    return spark.createDataFrame(RANK_ROWS, schema)


def image_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type table keyed by ``namespace/name`` (slug), the same rows as the
    packages' own names and types but read straight from ``documents``."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return (docs.where((d % 89 != 0) & (d % 97 != 0))
            .select(F.concat_ws("/", F.col("source"), F.concat(F.lit("pkg-"), d.cast("string"))).alias("slug"),
                    F.when(d % 13 == 0, F.lit("official")).otherwise(F.lit("community")).alias("filter_type")))


def npm_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """npm-shaped rows: manifest name/description, README text, homepage,
    repository URL and publisher."""
    return packages(spark, sf_dir).select(
        "package_id", "name", "description", F.col("full_description").alias("readme"), "homepage",
        "repo_url", F.col("namespace").alias("user_name"), "user_email", "release_ts", "pull_count", "label",
        F.concat(F.lit("p"), F.col("package_id").cast("string"), F.lit(".tgz")).alias("tar_name"))


def nuget_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NuGet-shaped rows: file name, description (README + nuspec description),
    author, project URL, repository URLs, license flag."""
    d = F.col("package_id")
    return packages(spark, sf_dir).select(
        "package_id", F.col("name").alias("file_name"), F.col("full_description").alias("description"),
        F.col("namespace").alias("author"), F.col("homepage").alias("project_url"),
        F.when(F.col("repo_url") == "", F.array().cast("array<string>")).otherwise(F.array("repo_url")).alias("repository_urls"),
        F.when(d % 2 == 0, F.lit(1)).otherwise(F.lit(0)).alias("license"),
        F.when(F.col("full_description").isNull(), F.lit(0)).otherwise(F.lit(1)).alias("readme_tag"),
        "release_ts", "pull_count", "label")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed stand-in predictions for sink tests: ``pull_count % 4 = 0`` -> abuse."""
    return packages(spark, sf_dir).select(
        "package_id", "label",
        F.when(F.col("pull_count") % 4 == 0, F.lit("abuse")).otherwise(F.lit("non-abuse")).alias("pred"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary: ``(vec_id, vec array<double>)``."""
    return (table(spark, sf_dir, "embeddings")
            .select("vec_id", F.col("embedding").cast("array<double>").alias("vec")))


def readme_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """README bytes of the packages that have an overview: UTF-8, every tenth UTF-16, a few
    that are neither (a surrogate without its other half in front)."""
    d, text = F.col("package_id"), F.col("full_description")
    content = (F.when(d % 25 == 4, F.concat(F.unhex(F.lit("D800")), F.encode(text, "UTF-8")))
               .when(d % 10 == 3, F.encode(text, "UTF-16")).otherwise(F.encode(text, "UTF-8")))
    return packages(spark, sf_dir).where(text.isNotNull()).select("package_id", "name", "namespace", "release_ts", content.alias("content"))


# --- archives built from the package rows (S4/S5 inputs) ---------------------------
ARCHIVE_SCHEMA = "path string, content binary"


def _npm_tgz(pid, name, description, homepage, repo_url, readme):
    import io
    import json
    import tarfile
    if pid % 50 == 7:
        return b"not an archive"
    manifest = {k: v for k, v in (("name", name), ("description", description), ("homepage", homepage)) if v is not None}
    manifest["repository"] = {"type": "git", "url": repo_url or ""}
    files = [("package/package.json", json.dumps(manifest).encode("utf-8"))]
    spelling = {0: "package/README.md", 1: "package/readme.md", 2: "package/Readme.md"}.get(pid % 4)
    if spelling and readme is not None:
        enc = "utf-8"
        if pid % 10 == 3:
            try:
                readme.encode("latin-1")
                enc = "latin-1"
            except UnicodeEncodeError:
                pass
        files.append((spelling, readme.encode(enc)))
    files.append(("package/index.js", b"module.exports = 1;\n"))
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for n, data in files:
            info = tarfile.TarInfo(n)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return buf.getvalue()


def _nupkg(pid, name, nuspec, readme):
    import io
    import zipfile
    if pid % 50 == 9:
        return b"PK\x03\x04 broken"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        enc = "utf-16" if pid % 10 == 5 else "utf-8"
        z.writestr(f"{name or 'package'}.nuspec", nuspec.encode(enc))
        if readme is not None:
            z.writestr("readme.md", readme.encode("utf-8"))
        z.writestr(zipfile.ZipInfo("lib/"), b"")
        z.writestr("lib/x.dll", b"\x00\x01")
    return buf.getvalue()


def npm_archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``.tgz`` per package, as ``binaryFile``-shaped rows ``(path, content)``."""
    small_batches(spark)
    p = packages(spark, sf_dir).select("package_id", "name", "description", "homepage", "repo_url",
                                       F.col("full_description").alias("readme"))

    def build(batches):
        import pandas as pd
        for b in batches:
            paths, data = [], []
            for r in b.itertuples(index=False):
                paths.append(f"npm/{r.package_id}.tgz")
                data.append(_npm_tgz(int(r.package_id), r.name, r.description, r.homepage, r.repo_url, r.readme))
            yield pd.DataFrame({"path": paths, "content": data})
    return p.mapInPandas(build, ARCHIVE_SCHEMA)


def nuget_archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``.nupkg`` per package (nuspec in UTF-16 for every tenth)."""
    small_batches(spark)
    from ..plans.q_maint import nuspec_text
    p = packages(spark, sf_dir)
    p = p.select("package_id", "name", nuspec_text(p).alias("nuspec"), F.col("full_description").alias("readme"))

    def build(batches):
        import pandas as pd
        for b in batches:
            paths, data = [], []
            for r in b.itertuples(index=False):
                paths.append(f"nuget/{r.package_id}.nupkg")
                data.append(_nupkg(int(r.package_id), r.name, r.nuspec, r.readme))
            yield pd.DataFrame({"path": paths, "content": data})
    return p.mapInPandas(build, ARCHIVE_SCHEMA)
