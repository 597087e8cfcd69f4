"""URL features.

Plan shape: every count is computed inside the package row with higher-order
array functions (no shuffle, text dropped right after extraction, R3). Only the
rank score needs a lookup table: the external domains are exploded, joined to
the size-checked rank table and summed back per package. Because all URLs of a
package come from one input row they sit in one partition, so the partial
aggregate collapses them to one row per package before the single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..profiles import IMAGE, RegistryProfile
from ..sources.tables import rank_score

URL_FEATURES = ("url_external", "url_short", "url_domains", "url_rank", "url_dups")
# A package without any URL gets (0/1, 0/1, 1/1, 0/1, 1/1) from the same formulas.


def duplicate_count(arr: Column) -> Column:
    """Number of distinct values that occur more than once: one pass over the
    sorted array that counts a run when it reaches its second element."""
    zero = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["prev"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("prev"), run.alias("run"), (acc["n"] + F.when(run == 2, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.array_sort(arr), zero, step, lambda acc: acc["n"])


def links(urls: Column, profile: RegistryProfile = IMAGE, homepage_domain: Column | None = None) -> Column:
    """Each URL parsed once: array<struct<url, host, dom, ok, ext, short, media>>.

    Callers put it in a projection of its own and read every count from there."""
    media_re = U.media_suffix_regex()

    def marked(s: Column) -> Column:
        internal = s["dom"].isin(list(profile.internal_hosts))
        if homepage_domain is not None:
            internal = internal | ((homepage_domain != "") & (s["dom"] == homepage_domain))
        ok = U.parseable(s["host"])
        return F.struct(s["url"].alias("url"), s["host"].alias("host"), s["dom"].alias("dom"), ok.alias("ok"),
                        (ok & ~internal).alias("ext"), (ok & s["dom"].isin(list(profile.short_hosts))).alias("short"),
                        s["url"].rlike(media_re).alias("media"))

    hosts = F.transform(urls, lambda u: F.struct(u.alias("url"), U.netloc(u).alias("host")))
    domains = F.transform(hosts, lambda s: F.struct(s["url"].alias("url"), s["host"].alias("host"), U.registered_domain(s["host"]).alias("dom")))
    return F.transform(domains, marked)


def media_count(urls: Column, profile: RegistryProfile = IMAGE,
                homepage_domain: Column | None = None) -> Column:
    """External URLs that end with an image suffix (case-sensitive)."""
    return F.size(F.filter(links(urls, profile, homepage_domain), lambda s: s["ext"] & s["media"]))


def url_counts(parsed: Column) -> list[Column]:
    """Row-local counts over a column of ``links`` (duplicates kept)."""
    each = lambda rows, name: F.transform(rows, lambda s: s[name])
    only = lambda name: F.filter(parsed, lambda s: s[name])
    return [
        F.size(parsed).alias("n_urls"),
        F.size(only("ext")).alias("n_external"),
        F.size(only("short")).alias("n_short"),
        F.size(F.array_distinct(each(only("ok"), "host"))).alias("n_hosts"),
        duplicate_count(each(parsed, "url")).alias("n_dup_urls"),
        F.size(F.filter(parsed, lambda s: s["ext"] & s["media"])).alias("n_media"),
        F.size(F.array_distinct(each(only("ext"), "dom"))).alias("n_external_domains"),
        each(only("ext"), "dom").alias("external_domains"),
    ]


COUNT_COLS = ("n_urls", "n_external", "n_short", "n_hosts", "n_dup_urls", "n_media",
              "n_external_domains")


def url_local(df: DataFrame, id_col: str = "package_id", text: Column | None = None,
              profile: RegistryProfile = IMAGE, homepage_domain: Column | None = None,
              keep: tuple = ()) -> DataFrame:
    """Row-local step: ``(id, keep..., counts..., external_domains)``; the text
    is read once here and dropped."""
    text = F.col("text") if text is None else text
    parsed = df.select(F.col(id_col), *keep, links(U.extract_urls(text), profile, homepage_domain).alias("_links"))
    return parsed.select(F.col(id_col), *keep, *url_counts(F.col("_links")))


def url_scores(local: DataFrame, ranks: DataFrame, id_col: str = "package_id") -> DataFrame:
    """Scoring step over ``url_local`` rows: the external domains' rank scores
    are summed back per package (one narrow exchange), then the five ratios."""
    ranks = ranks.select("domain", "rank")
    scored = (local.select(id_col, *COUNT_COLS, F.explode_outer("external_domains").alias("domain"))
              .join(ranks, "domain", "left")
              .groupBy(id_col, *COUNT_COLS)
              .agg(F.sum(rank_score(F.col("rank"))).alias("external_score")))
    plus1 = lambda c: F.col(c) + F.lit(1)
    return scored.select(
        id_col, *COUNT_COLS, "external_score",
        (F.col("n_external") / plus1("n_urls")).alias("url_external"),
        (F.col("n_short") / plus1("n_urls")).alias("url_short"),
        (F.lit(1.0) / plus1("n_hosts")).alias("url_domains"),
        (F.col("external_score") / plus1("n_external")).alias("url_rank"),
        (F.lit(1.0) / plus1("n_dup_urls")).alias("url_dups"))


def url_features(df: DataFrame, ranks: DataFrame, id_col: str = "package_id",
                 text: Column | None = None, profile: RegistryProfile = IMAGE,
                 homepage_domain: Column | None = None) -> DataFrame:
    """``(id, counts..., url_external, url_short, url_domains, url_rank, url_dups)``.

    ``text`` defaults to the package text column ``text``. Every input row gives
    one output row (packages without URLs get the no-URL values).
    """
    return url_scores(url_local(df, id_col, text, profile, homepage_domain), ranks, id_col)


def url_rows(df: DataFrame, id_col: str = "package_id", text: Column | None = None,
             profile: RegistryProfile = IMAGE) -> DataFrame:
    """F1/F3/J4 at URL grain: ``(id, pos, url, netloc, domain, parseable, external, short)``."""
    text = F.col("text") if text is None else text
    u = F.col("url")
    return (df.select(id_col, F.posexplode(U.extract_urls(text)).alias("pos", "url"))
            .select(id_col, F.col("pos").cast("long").alias("pos"), "url",
                    U.netloc(u).alias("netloc"), U.url_domain(u).alias("domain"),
                    U.parseable(U.netloc(u)).alias("parseable"),
                    (U.parseable(U.netloc(u)) & ~U.url_domain(u).isin(list(profile.internal_hosts))).alias("external"),
                    (U.parseable(U.netloc(u)) & U.url_domain(u).isin(list(profile.short_hosts))).alias("short")))
