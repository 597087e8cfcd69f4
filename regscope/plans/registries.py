"""npm (40-wide) and NuGet (36-wide) feature tables, same operators as the
image plan with the registry profile's lists, keyword count and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import npm_code_feature
from ..operators import context as CTX
from ..operators import normalise as N
from ..operators import semantics as S
from ..operators.gates import SCORE, gate_npm, gate_nuget, npm_text, nuget_text
from ..functions.urls import extract_urls
from ..operators.url_features import COUNT_COLS, URL_FEATURES, links, url_counts, url_scores
from ..session import cut_lineage
from ..profiles import NPM, NUGET, RegistryProfile
from ..sources import fixtures as FX
from . import keywords as K

SEM = [f"sem_{i}" for i in range(10)]


def semantic_columns(spark: SparkSession, sf_dir: str, ids: DataFrame, profile: RegistryProfile) -> DataFrame:
    """Top-k keywords, in-vocabulary ones kept, the first ten distances padded."""
    kw = K.keywords(spark, sf_dir, profile)
    d = S.platform_distance(kw, FX.vectors(spark, sf_dir), K.platform_vectors(spark, sf_dir, profile))
    # keep the first ten in-vocabulary keywords (a bounded window per package)
    from pyspark.sql import Window
    d = (d.withColumn("_r", F.row_number().over(Window.partitionBy("package_id").orderBy("pos")))
         .where(F.col("_r") <= 10).drop("_r"))
    sv = S.semantic_vector(d, ids)
    return sv.select("package_id", *[F.col("semantic")[i].alias(c) for i, c in enumerate(SEM)])


def _context(feats: DataFrame, author: str, block: list[str]) -> DataFrame:
    arr = feats.withColumn("own_block", F.array(*[F.col(c).cast("double") for c in block]))
    return CTX.author_context(arr, author, ["release_ts", "package_id"], "own_block")


def npm_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 (npm): own 20 + author context over the same 20 = 40."""
    g = gate_npm(FX.npm_view(spark, sf_dir)).where(F.col("gate") == SCORE)
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    base = g.select("package_id", "user_name", "user_email", "release_ts", "repo_url",
                    npm_text(c("name"), c("description"), c("readme")).alias("text"),
                    N.homepage_domain(F.col("homepage")).alias("homepage_domain"),
                    F.when(c("readme") == "", F.lit(0.0)).otherwise(F.lit(1.0)).alias("readme_flag"))
    ranks = FX.rank_domain(spark)
    # the only pass over the text: row-local features into a narrow table
    kept = ["package_id", "user_name", "user_email", "release_ts", "repo_url", "homepage_domain", "readme_flag"]
    parsed = base.select(*kept, npm_code_feature(F.col("text")).alias("code_blocks"),
                         links(extract_urls(F.col("text")), NPM, F.col("homepage_domain")).alias("_links"))
    narrow = cut_lineage(parsed.select(*kept, "code_blocks", *url_counts(F.col("_links"))))
    urls = url_scores(narrow.select("package_id", *COUNT_COLS, "external_domains"), ranks).select(
        "package_id", *URL_FEATURES)
    local = narrow.select("package_id", "user_name", "user_email", "release_ts", "repo_url", "homepage_domain",
                          "readme_flag", "code_blocks")
    local = N.email_rank(N.repo_homepage(local, ranks), "user_email", ranks)
    feats = (local.join(urls, "package_id")
             .join(semantic_columns(spark, sf_dir, narrow.select("package_id"), NPM), "package_id"))
    own = list(NPM.own_features)
    ctx = _context(feats, "user_name", own)
    return ctx.select("package_id", F.concat(F.col("own_block"), F.col("ctx")).alias("features"))


def nuget_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 (NuGet): own 18 + author context over url, repo, readme, licence,
    semantics = 36."""
    g = gate_nuget(FX.nuget_view(spark, sf_dir), F.col("description")).where(F.col("gate") == SCORE)
    base = g.select("package_id", "author", "release_ts", F.col("license").cast("double").alias("license"),
                    F.col("readme_tag").cast("double").alias("readme_flag"),
                    F.coalesce("project_url", F.lit("")).alias("project_url"),
                    F.array_join(F.transform("repository_urls", lambda u: F.concat(u, F.lit(" "))), "").alias("repository"),
                    nuget_text(F.col("file_name"), F.col("description")).alias("text"))
    ranks = FX.rank_domain(spark)
    kept = ["package_id", "author", "release_ts", "license", "readme_flag", "project_url", "repository"]
    parsed = base.select(*kept, links(extract_urls(F.col("text")), NUGET).alias("_links"))
    narrow = cut_lineage(parsed.select(*kept, *url_counts(F.col("_links"))))
    urls = url_scores(narrow.select("package_id", *COUNT_COLS, "external_domains"), ranks).select(
        "package_id", *URL_FEATURES)
    repo = N.repo_score(narrow, "package_id", "project_url", "repository", ranks)
    feats = (narrow.select("package_id", "author", "release_ts", "license", "readme_flag")
             .join(urls, "package_id").join(repo, "package_id")
             .join(semantic_columns(spark, sf_dir, narrow.select("package_id"), NUGET), "package_id"))
    ctx = _context(feats, "author", list(NUGET.context_features))
    own = F.array(*[F.col(c).cast("double") for c in NUGET.own_features])
    return ctx.select("package_id", F.concat(own, F.col("ctx")).alias("features"))
