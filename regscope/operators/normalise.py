"""Manifest, sidecar, nuspec and catalog normalisers (P5, P7–P9, S13) and the
repository / homepage / e-mail rank features (A10–A12). Catalyst only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import urls as U
from ..sources.tables import rank_score

MANIFEST_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("homepage", T.StringType()),
    T.StructField("repository", T.StructType([T.StructField("url", T.StringType())]))])


def homepage_domain(url: Column) -> Column:
    """Last two labels of the homepage's network location; '' when empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), C.NETLOC_ANY, 1)
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(U.registered_domain(host))


def npm_manifest(df: DataFrame, json_col: str) -> DataFrame:
    """Name, description, repository URL and homepage domain from
    ``package.json`` text; unparsable text gives empty fields."""
    m = F.from_json(F.col(json_col), MANIFEST_SCHEMA, {"mode": "PERMISSIVE"})
    e = lambda c: F.coalesce(c, F.lit(""))
    return df.select("*", m.alias("_m")).select(
        *[c for c in df.columns if c != json_col],
        e(F.col("_m.name")).alias("name"), e(F.col("_m.description")).alias("description"),
        e(F.col("_m.repository.url")).alias("repo_url"), homepage_domain(F.col("_m.homepage")).alias("homepage_domain"))


def npm_publisher(sidecar: Column) -> list[Column]:
    """The quoted name and e-mail after ``'_npmUser'`` (up to the first
    ``}``); both empty when the text does not have that shape."""
    parts = F.split(F.regexp_extract(F.coalesce(sidecar, F.lit("")), r"'_npmUser'.*?\}", 0), "'")
    ok = F.size(parts) >= 10
    return [F.when(ok, F.get(parts, 5)).otherwise(F.lit("")).alias("user_name"),
            F.when(ok, F.get(parts, 9)).otherwise(F.lit("")).alias("user_email")]


def _between(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)


def nuspec_fields(nuspec: Column) -> list[Column]:
    """Authors, description, projectUrl, the url="..." values inside the
    first ``<repository .. />`` (each followed by a space), licence flag.
    Missing tags give ''. Entities are left as written."""
    t = F.coalesce(nuspec, F.lit(""))
    repo = F.regexp_extract(t, r"(?s)<repository(.*?)/>", 1)
    urls = F.regexp_extract_all(repo, F.lit(r'url="(.*?)"'), 1)
    return [_between(t, "authors").alias("author"), _between(t, "description").alias("description"),
            _between(t, "projectUrl").alias("project_url"),
            F.array_join(F.transform(urls, lambda u: F.concat(u, F.lit(" "))), "").alias("repository"),
            F.when(t.contains("<licenseUrl>"), F.lit(1)).otherwise(F.lit(0)).alias("license")]


def pick_member(members: DataFrame, id_col: str, names: list[str], last: bool = False) -> DataFrame:
    """P5: per archive, the member whose name comes first (or last) in ``names``."""
    prio = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("member"))
    cand = members.where(prio > 0).withColumn("_p", prio)
    agg = F.max_by if last else F.min_by
    return cand.groupBy(id_col).agg(agg("content", "_p").alias("content"), agg("member", "_p").alias("member"))


CATALOG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("listed", T.BooleanType()), T.StructField("created", T.StringType()),
    T.StructField("commitTimeStamp", T.StringType()),
    T.StructField("packageEntries", T.ArrayType(T.StructType([
        T.StructField("fullName", T.StringType()), T.StructField("@id", T.StringType())])))])


def iso_second(c: Column) -> Column:
    """ISO-8601 text truncated to the second, zone dropped."""
    return F.to_timestamp(F.substring(c, 1, 19), "yyyy-MM-dd'T'HH:mm:ss")


def catalog_versions(leaves: DataFrame, json_col: str, start: str, end: str) -> DataFrame:
    """Catalog leaves committed within [start, end] (seconds, inclusive)
    as version records with their download entries."""
    j = F.from_json(F.col(json_col), CATALOG_SCHEMA)
    rows = leaves.select(j.alias("l"))
    commit = iso_second(F.col("l.commitTimeStamp"))
    return (rows.where(commit.between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))
            .select(F.col("l.id").alias("package_name"), F.col("l.version").alias("version"),
                    F.when(F.col("l.listed"), F.lit(C.STATUS_NORMAL)).otherwise(F.lit(C.STATUS_UNLISTED)).alias("status"),
                    F.lit(0).alias("download_status"),
                    iso_second(F.col("l.created")).alias("publish_time"),
                    F.transform(F.coalesce(F.col("l.packageEntries"), F.array()),
                                lambda e: F.struct(e["fullName"].alias("name"), e["@id"].alias("url"))).alias("download_info"),
                    F.lit("cSharp").alias("language"), F.lit("official").alias("source")))


def domain_score(df: DataFrame, domain_col: str, ranks: DataFrame, out: str) -> DataFrame:
    """Left join on a domain column with the size-checked rank table."""
    r = ranks.select(F.col("domain").alias("_d"), F.col("rank").alias("_r"))
    return (df.join(r, F.col(domain_col) == F.col("_d"), "left")
            .withColumn(out, rank_score(F.col("_r"))).drop("_d", "_r"))


def repo_homepage(df: DataFrame, ranks: DataFrame) -> DataFrame:
    """A10 (npm): ``has_repo`` and ``homepage_rank``; [0, 0] with neither."""
    s = domain_score(df, "homepage_domain", ranks, "_hs")
    hp, repo = F.coalesce(F.col("homepage_domain"), F.lit("")), F.coalesce(F.col("repo_url"), F.lit(""))
    return s.select("*",
                    F.when((hp == "") & (repo == ""), F.lit(0)).when(hp != "", F.when(repo == "", 0).otherwise(1))
                     .otherwise(F.lit(1)).alias("has_repo"),
                    F.when(hp != "", F.col("_hs")).otherwise(F.lit(0.0)).alias("homepage_rank")).drop("_hs")


def email_rank(df: DataFrame, email_col: str, ranks: DataFrame) -> DataFrame:
    """A12 (npm): rank score of everything after the first '@' (0 if none)."""
    dom = F.regexp_extract(F.coalesce(F.col(email_col), F.lit("")), "@(.+)$", 1)
    s = domain_score(df.withColumn("_ed", dom), "_ed", ranks, "_es")
    return s.withColumn("email_rank", F.when(F.col("_ed") == "", F.lit(0.0)).otherwise(F.col("_es"))).drop("_ed", "_es")


def repo_score(df: DataFrame, id_col: str, project_url: str, repository: str, ranks: DataFrame) -> DataFrame:
    """A11 (NuGet): (projectUrl score + mean score of the repository URLs) / 2;
    the mean runs over the parseable URLs found in the repository text."""
    pj = domain_score(df.select(id_col, homepage_domain(F.col(project_url)).alias("_pd"),
                                F.coalesce(F.col(project_url), F.lit("")).alias("_pu"), repository),
                      "_pd", ranks, "_ps")
    pj = pj.withColumn("_ps", F.when(F.col("_pu") == "", F.lit(0.0)).otherwise(F.col("_ps")))
    urls = (pj.select(id_col, F.explode(U.extract_urls(F.col(repository))).alias("_u"))
            .where(U.parseable(U.netloc(F.col("_u")))).select(id_col, U.url_domain(F.col("_u")).alias("_rd")))
    rs = domain_score(urls, "_rd", ranks, "_rs").groupBy(id_col).agg(F.avg("_rs").alias("_rm"))
    return (pj.join(rs, id_col, "left")
            .select(id_col, ((F.col("_ps") + F.coalesce(F.col("_rm"), F.lit(0.0))) / 2).alias("repo_score")))


def reconcile(counted: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Per listed key, what was counted (``n``, 0 if nothing was) against the listed
    ``expected``; ``same`` is 1 if they agree, else 0, also where the listing is unknown."""
    return listed.join(counted, key, "left").select(
        key, F.coalesce("n", F.lit(0)).alias("n"), "expected",
        F.when(F.col("expected") == F.coalesce("n", F.lit(0)), F.lit(1)).otherwise(F.lit(0)).alias("same"))
