"""Promoted links and result rows.

All row-local: link arrays are extracted and de-duplicated inside the row,
then exploded for the URL sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.urls import extract_links


def http_links(text: Column, pattern: str) -> Column:
    """Distinct group-1 matches of ``pattern`` that start with 'http'."""
    return F.filter(F.array_distinct(extract_links(text, pattern)), lambda u: u.startswith("http"))


def image_links(overview: Column) -> Column:
    """Image: distinct href values starting with http."""
    return http_links(overview, C.HREF)


def npm_links(readme: Column, latin: Column | None = None) -> Column:
    """npm: distinct markdown-link targets; plus distinct hrefs when the README
    had to be decoded as Latin-1. Duplicates across the two kinds are kept."""
    md = http_links(readme, C.MD_LINK)
    if latin is None:
        return md
    return F.when(latin, F.concat(md, http_links(readme, C.HREF))).otherwise(md)


def nuget_links(description: Column) -> Column:
    """NuGet: distinct markdown targets, then distinct hrefs (kinds concatenated)."""
    return F.concat(http_links(description, C.MD_LINK), http_links(description, C.HREF))


def nuget_url_string(links: Column) -> Column:
    """Newline-joined link list, 'no_url' when empty (sorted: the source order
    was a set order, i.e. unspecified)."""
    return F.when(F.size(links) == 0, F.lit("no_url")).otherwise(F.array_join(F.array_sort(links), "\n"))


def link_rows(df: DataFrame, id_col: str, links: Column, width: int | None = None) -> DataFrame:
    """One row per link, cut to ``width`` characters."""
    url = F.col("url") if width is None else F.substring("url", 1, width)
    return (df.select(id_col, F.explode(links).alias("url"))
            .where(F.col("url") != "")
            .select(id_col, url.alias("url")))


def cut(c: Column, width: int = C.RESULT_TEXT_WIDTH, empty: str | None = None) -> Column:
    """First ``width`` characters; '' (or null) replaced by ``empty`` when given."""
    s = F.substring(c, 1, width)
    if empty is None:
        return s
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(empty)).otherwise(s)


def npm_result_rows(scored: DataFrame, *more: str) -> DataFrame:
    """S10 (npm form): name / tar name / publisher cut to 95 characters,
    empty publisher fields written as 'NULL'. ``scored`` has ``result``; its columns
    ``more`` are kept."""
    return scored.select(
        "package_id",
        F.when(F.col("result") == "name_n", F.lit("name_null")).otherwise(cut(F.col("name"))).alias("name"),
        "result",
        cut(F.col("tar_name")).alias("tar_name"),
        F.when(F.col("result").isin("name_n", "rdm_n"), F.lit(None).cast("string"))
         .otherwise(cut(F.col("user_name"), empty="NULL")).alias("user_name"),
        F.when(F.col("result").isin("name_n", "rdm_n"), F.lit(None).cast("string"))
         .otherwise(cut(F.col("user_email"), empty="NULL")).alias("user_email"), *more)


def image_result_rows(gated: DataFrame) -> DataFrame:
    """S10 (image form): no name -> name/author 'null'; no namespace -> author
    'null'; otherwise name and namespace. ``gated`` has ``result``."""
    no_name = (F.col("name").isNull()) | (F.col("name") == "")
    no_ns = (F.col("namespace").isNull()) | (F.col("namespace") == "")
    return gated.select(
        "package_id",
        F.when(no_name, F.lit("null")).otherwise(F.col("name")).alias("name"),
        "result",
        F.when(no_name | no_ns, F.lit("null")).otherwise(F.col("namespace")).alias("author"))


def _time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def image_sink_rows(scored: DataFrame, run_time: Column) -> DataFrame:
    """S10 (image form), the whole row: names, run time, result, id and the package's times.

    ``scored`` has ``result`` and ``release_ts``, which stands for both of the package's times. A
    package without a name writes 'null' for all but its id and the run time."""
    no_name = F.coalesce(F.col("name"), F.lit("")) == ""
    shown = lambda c: F.when(no_name, F.lit("null")).otherwise(F.coalesce(c, F.lit("null")))
    author = F.when(F.col("namespace") == "", F.lit(None)).otherwise(F.col("namespace"))
    return scored.select(
        "package_id", shown(F.col("name")).alias("name"), _time(run_time).alias("date"), shown(F.col("result")).alias("result"),
        F.col("package_id").cast("string").alias("docker_id"), shown(author).alias("author"),
        shown(_time(F.col("release_ts"))).alias("date_registered"), shown(_time(F.col("release_ts"))).alias("last_updated"))


def npm_sink_rows(scored: DataFrame, run_time: Column) -> DataFrame:
    """S10 (npm form), the whole row: ``npm_result_rows`` with run time, release day and its year, by which the
    sink is partitioned (null without a release time)."""
    rows = npm_result_rows(scored.withColumn("_day", F.to_date("release_ts")), "_day")
    return rows.select("package_id", "name", _time(run_time).alias("date"), "result", "tar_name",
                       F.date_format("_day", "yyyy-MM-dd").alias("release_date"), "user_name", "user_email",
                       F.year("_day").alias("year"))


def nuget_sink_rows(scored: DataFrame, run_time: Column) -> DataFrame:
    """S10 (NuGet form), the whole row. ``scored`` has ``result`` and ``urls``; packages that the gate let
    through without scoring have no link list and write 'no_url'."""
    shown = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit("null")).otherwise(F.col(c))
    return scored.select(
        "package_id", shown("file_name").alias("name"), _time(run_time).alias("time"), "result",
        F.date_format("release_ts", "yyyy-MM-dd").alias("date"), shown("author").alias("author"),
        F.coalesce("urls", F.lit("no_url")).alias("urls"))


def write_partitions(df: DataFrame, path: str, partition_col: str) -> None:
    """S10/S12 batch sink: dynamic partition overwrite, so re-running a day's
    job replaces that day's rows instead of appending a second copy."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))
