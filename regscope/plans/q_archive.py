"""Step 8 queries: archive readers, decoding, npm ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import archives as AR
from ..sources import fixtures as FX
from . import twins as TW
from .catalog import register


def _members_out(m):
    # counts of a damaged archive are reported as 0; has_error marks the row
    return m.select("path", "member", F.coalesce(F.col("n_members").cast("long"), F.lit(0)).alias("n_members"),
                    F.coalesce(F.col("n_dirs").cast("long"), F.lit(0)).alias("n_dirs"),
                    F.col("error").isNotNull().alias("has_error"))


@register("npm_members", TW.with_ctes(TW.PACKAGES, """
nm as (select concat('npm/', cast(package_id as varchar), '.tgz') as path, package_id, full_description,
  case package_id % 4 when 0 then 'package/README.md' when 1 then 'package/readme.md' when 2 then 'package/Readme.md' end as rd
  from packages),
nn as (select *, case when rd is not null and full_description is not null then 3 else 2 end as n from nm)
""", body="""
select path, null::varchar as member, 0::bigint as n_members, 0::bigint as n_dirs, true as has_error from nn where package_id % 50 = 7
union all select path, 'package/package.json', n, 0, false from nn where package_id % 50 <> 7
union all select path, rd, n, 0, false from nn where package_id % 50 <> 7 and rd is not null and full_description is not null"""))
def q_npm_members(spark, sf):
    """Manifest and README members of every package tarball, with counts."""
    return _members_out(AR.archive_members(FX.npm_archive_files(spark, sf)))


@register("nupkg_members", TW.with_ctes(TW.PACKAGES, """
nz as (select concat('nuget/', cast(package_id as varchar), '.nupkg') as path, package_id, name, full_description,
  case when full_description is null then 3 else 4 end as n from packages)
""", body="""
select path, null::varchar as member, 0::bigint as n_members, 0::bigint as n_dirs, true as has_error from nz where package_id % 50 = 9
union all select path, concat(coalesce(name, 'package'), '.nuspec'), n, 1, false from nz where package_id % 50 <> 9
union all select path, 'readme.md', n, 1, false from nz where package_id % 50 <> 9 and full_description is not null"""))
def q_nupkg_members(spark, sf):
    """Nuspec and markdown members of every package zip, file and folder counts."""
    return _members_out(AR.archive_members(FX.nuget_archive_files(spark, sf)))


@register("decode_text")
def q_decode_text(spark, sf):
    """README bytes decoded as UTF-8, else Latin-1; nuspec as UTF-8, else UTF-16."""
    npm = AR.archive_members(FX.npm_archive_files(spark, sf)).where(F.col("member").rlike("(?i)readme"))
    nug = AR.archive_members(FX.nuget_archive_files(spark, sf)).where(F.col("member").endswith(".nuspec"))
    a = npm.select("path", "member", *AR.decode_utf8_or(F.col("content"), "ISO-8859-1"))
    b = nug.select("path", "member", *AR.decode_utf8_or(F.col("content"), "UTF-16"))
    return a.unionByName(b).select("path", "member", F.char_length("text").alias("n_chars"), "used_fallback")


@register("npm_ingest")
def q_npm_ingest(spark, sf):
    """§3.2 ingest: tarballs -> one normalised npm package row each."""
    return AR.npm_packages(AR.archive_members(FX.npm_archive_files(spark, sf)))
