"""Package text and gate cascades.

Gates are one ``CASE`` column; candidates are filtered on it before any
explode or Python stage, so expensive features only see scored rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import urls as U
from ..functions.text import is_blank, strip

SCORE = "score"


def missing(c: Column) -> Column:
    """Null, absent and '' are treated alike by the gates (no strip)."""
    return c.isNull() | (c == F.lit(""))


def image_text(name: Column, description: Column, full_description: Column) -> Column:
    """name + ' ' + description + ' ' + full_description, null parts skipped."""
    return F.concat_ws(" ", name, description, full_description)


def npm_text(name: Column, description: Column, readme: Column) -> Column:
    return F.concat_ws(" ", name, description, readme)


def nuget_text(file_name: Column, description: Column) -> Column:
    """File name and description joined with no separator."""
    return F.concat(F.coalesce(file_name, F.lit("")), F.coalesce(description, F.lit("")))


def gate_image(pkgs: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Adds ``gate`` — first hit wins: no name / no namespace -> 'null',
    no overview -> 'no_overview', no URL in the overview -> 'overview_no_link',
    known type other than community -> 'non-abuse', else 'score'. An unknown
    type is scored. ``types`` is ``(slug, filter_type)``; without it the
    package's own ``filter_type`` column is used."""
    fd = F.col("full_description")
    # What the row itself says is settled before the join, so a caller that drops the
    # overview doesn't carry it through the exchange.
    local = (F.when(missing(F.col("name")), F.lit("null"))
             .when(missing(F.col("namespace")), F.lit("null"))
             .when(missing(fd), F.lit("no_overview"))
             .when(~fd.rlike(C.URL_FEATURE), F.lit("overview_no_link")))
    pkgs = pkgs.withColumn("gate", local)
    if types is not None:
        pkgs = pkgs.join(types.withColumnRenamed("filter_type", "_type"),
                         F.concat_ws("/", pkgs["namespace"], pkgs["name"]) == types["slug"], "left").drop("slug")
        ftype = F.col("_type")
    else:
        ftype = F.col("filter_type")
    typed = F.when(ftype.isNotNull() & (ftype != F.lit("community")), F.lit("non-abuse")).otherwise(F.lit(SCORE))
    out = pkgs.withColumn("gate", F.coalesce(F.col("gate"), typed))
    return out.drop("_type") if types is not None else out


def gate_npm(df: DataFrame) -> DataFrame:
    """No name -> 'name_n'; README blank after strip -> 'rdm_n'; else 'score'."""
    gate = (F.when(missing(F.col("name")), F.lit("name_n"))
            .when(is_blank(F.col("readme")), F.lit("rdm_n"))
            .otherwise(F.lit(SCORE)))
    return df.withColumn("gate", gate)


def gate_nuget(df: DataFrame, text: Column) -> DataFrame:
    """Stripped text under 20 characters -> row dropped; no gate URL ->
    'non-abuse' (links 'no_url'); else 'score'."""
    kept = df.where(F.char_length(strip(text)) >= F.lit(C.NUGET_MIN_TEXT))
    gate = F.when(~U.has_url(text, C.URL_GATE), F.lit("non-abuse")).otherwise(F.lit(SCORE))
    return kept.withColumn("gate", gate)


def gate_funnel(gated: DataFrame) -> DataFrame:
    """Rows per gate outcome."""
    return gated.groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


def corpus_audit(df: DataFrame, text: Column, url_pattern: str = C.URL_GATE) -> DataFrame:
    """Total texts, texts under 20 stripped characters, texts without a URL."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.char_length(strip(text)) < C.NUGET_MIN_TEXT).alias("short_text"),
                  F.count_if(~U.has_url(text, url_pattern)).alias("no_url"))
