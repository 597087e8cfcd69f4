"""Image-registry scoring plan as one lazy DataFrame plan.

scan -> type lookup -> gate -> candidates (text dropped after row-local
extraction) -> URL / code / semantic / popularity features -> author window
-> feature vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import image_code_features, popularity
from ..operators import context as CTX
from ..operators.gates import SCORE, gate_image, image_text, missing
from ..operators.url_features import URL_FEATURES
from ..profiles import IMAGE
from ..sources import fixtures as FX


def gated_packages(spark: SparkSession, sf_dir: str, use_type_table: bool = True) -> DataFrame:
    pkgs = FX.packages(spark, sf_dir)
    types = FX.image_types(spark, sf_dir) if use_type_table else None
    return gate_image(pkgs, types)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows only, with the package text assembled once."""
    g = gated_packages(spark, sf_dir)
    return (g.where(F.col("gate") == SCORE)
            .select("package_id", "namespace", "name", "release_ts", "pull_count", "full_description",
                    image_text(F.col("name"), F.col("description"), F.col("full_description")).alias("text")))


def with_context(feats: DataFrame, block: list[str], chunks: int | None = None) -> DataFrame:
    """Author context over the named feature columns (as one array)."""
    arr = feats.withColumn("own_block", F.array(*[F.col(c).cast("double") for c in block]))
    return CTX.author_context(arr, "namespace", ["release_ts", "package_id"], "own_block", chunks=chunks)


SEM = [f"sem_{i}" for i in range(10)]
CODE = ["code_md", "code_blocks"]
OWN_ORDER = [*CODE, *SEM, *URL_FEATURES]            # the package's own 17 values
CTX_ORDER = [*URL_FEATURES, *CODE, *SEM]            # the block the author context blends
FEATURE_NAMES = [*OWN_ORDER, *[f"ctx_{c}" for c in CTX_ORDER], "popularity"]   # 35


def semantic_block(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """Ten platform distances per package (its top ten words, in-vocabulary)."""
    from ..operators import semantics as S
    from . import keywords as K
    d = S.platform_distance(K.keywords(spark, sf_dir, IMAGE), FX.vectors(spark, sf_dir), K.platform_vectors(spark, sf_dir, IMAGE))
    sv = S.semantic_vector(d, ids)
    return sv.select("package_id", *[F.col("semantic")[i].alias(c) for i, c in enumerate(SEM)])


def narrow_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the package text for every package: the gate outcome,
    and for scored packages every row-local feature (code, popularity, URL
    counts and external domains). They are taken before the type table is joined,
    so the text isn't shuffled by slug; packages without a link in the overview
    skip the regex work. Written to the shared checkpoint directory; later
    branches read this narrow table instead of re-reading the text (R3)."""
    from ..operators.url_features import COUNT_COLS, links, url_counts
    from ..functions.urls import extract_urls
    from ..session import cut_lineage
    pkgs = FX.packages(spark, sf_dir)
    fd = F.col("full_description")
    text = image_text(F.col("name"), F.col("description"), fd)
    # Whatever its type, a package without an overview or a link in it isn't scored.
    maybe = ~missing(fd) & fd.rlike(C.URL_FEATURE)
    feats = [*image_code_features(fd), popularity(F.col("pull_count"))]
    lazy = [F.when(maybe, c).alias(n) for n, c in zip([*CODE, "popularity"], feats)]
    names = [*CODE, "popularity", *COUNT_COLS, "external_domains"]
    # URLs are extracted and parsed in a projection of their own, once per row.
    base = pkgs.select("package_id", "name", "namespace", "release_ts", "full_description", *lazy,
                       F.when(maybe, links(extract_urls(text), IMAGE)).alias("_links"))
    counts = [F.when(F.col("_links").isNotNull(), c).alias(n)
              for n, c in zip([*COUNT_COLS, "external_domains"], url_counts(F.col("_links")))]
    base = base.select("package_id", "name", "namespace", "release_ts", "full_description", *CODE, "popularity", *counts)
    # The features meet the type table; the text stays behind.
    g = gate_image(base, FX.image_types(spark, sf_dir))
    scored = F.col("gate") == SCORE
    return cut_lineage(g.select("package_id", "name", "namespace", "release_ts", "gate",
                                *[F.when(scored, F.col(n)).alias(n) for n in names]))


def narrow_candidates(spark: SparkSession, sf_dir: str, narrow: DataFrame | None = None) -> DataFrame:
    n = narrow if narrow is not None else narrow_packages(spark, sf_dir)
    return n.where(F.col("gate") == SCORE)


def feature_table(spark: SparkSession, sf_dir: str, narrow: DataFrame | None = None) -> DataFrame:
    """M1: one row per scored package with the 35-wide ``features`` array."""
    from ..operators.url_features import COUNT_COLS, url_scores
    nc = narrow_candidates(spark, sf_dir, narrow)
    ids = nc.select("package_id")
    urls = url_scores(nc.select("package_id", *COUNT_COLS, "external_domains"), FX.rank_domain(spark))
    feats = (nc.select("package_id", "namespace", "release_ts", *CODE, "popularity")
             .join(urls.select("package_id", *URL_FEATURES), "package_id")
             .join(semantic_block(spark, sf_dir, ids), "package_id", "left"))
    ctx = with_context(feats, CTX_ORDER)
    own = F.array(*[F.col(c).cast("double") for c in OWN_ORDER])
    return ctx.select("package_id", "namespace", "release_ts",
                      F.concat(own, F.col("ctx"), F.array(F.col("popularity").cast("double"))).alias("features"))
