"""Scoring jobs of the three registries: features -> stored forest -> result rows.

The forest of a registry is fitted once per input snapshot (``sources/models.py``); every
job loads it. Package texts stay out of the joins: gates, links and names are taken first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links as L
from ..operators import model as M
from ..operators.gates import SCORE, gate_npm, gate_nuget
from ..profiles import IMAGE, NPM, NUGET, RegistryProfile
from ..session import cut_lineage
from ..sources import fixtures as FX
from ..sources.models import ForestSettings, StoredForest, stored_forest
from ..sources.store import fingerprint
from ..sources.tables import table
from . import image as IMG
from . import registries as R
from .keywords import PACKAGE_INPUTS

# Share of labelled rows kept for the test side; npm trains on the smaller part.
TEST_SHARE = {IMAGE.name: 0.3, NPM.name: 0.7, NUGET.name: 0.3}
FEATURES = {IMAGE.name: IMG.feature_table, NPM.name: R.npm_feature_table, NUGET.name: R.nuget_feature_table}


def labels_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("package_id"),
        F.when(F.col("quality") == 0, F.lit("abuse")).otherwise(F.lit("non-abuse")).alias("label"))


def feature_names(profile: RegistryProfile) -> list[str]:
    """Names of the feature vector, in its order."""
    return [*profile.own_features, *[f"ctx_{c}" for c in profile.context_features], *profile.extra_features]


def forest(spark: SparkSession, sf_dir: str, profile: RegistryProfile, features: DataFrame | None = None,
           split_key: str = "package_id") -> StoredForest:
    """The registry's forest on the labelled rows of this snapshot; ``features`` may carry its table."""
    def labelled() -> DataFrame:
        ft = features if features is not None else FEATURES[profile.name](spark, sf_dir)
        return ft.join(labels_for(spark, sf_dir), "package_id")

    key = fingerprint(spark, sf_dir, [*PACKAGE_INPUTS, "embeddings"])
    return stored_forest(spark, profile.name, key, ForestSettings(split_key, TEST_SHARE[profile.name]), labelled)


def predictions(spark: SparkSession, sf_dir: str, profile: RegistryProfile, features: DataFrame | None = None) -> DataFrame:
    """M3: ``(package_id, pred)`` of every scored package."""
    ft = features if features is not None else cut_lineage(FEATURES[profile.name](spark, sf_dir))
    return M.score(forest(spark, sf_dir, profile, ft).model(), ft).select("package_id", "pred")


def with_result(gated: DataFrame, pred: DataFrame) -> DataFrame:
    """``result``: the forest's label of scored packages, the gate's outcome of the others."""
    return gated.join(pred, "package_id", "left").withColumn(
        "result", F.when(F.col("gate") == SCORE, F.col("pred")).otherwise(F.col("gate"))).drop("pred")


def run_time(spark: SparkSession, sf_dir: str):
    """The run time written into result rows: the snapshot's last release, so reruns agree."""
    return FX.packages(spark, sf_dir).select(F.max("release_ts")).scalar()


def image_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IMG.gated_packages(spark, sf_dir).select("package_id", "name", "namespace", "release_ts", "gate")


def npm_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_npm(FX.npm_view(spark, sf_dir)).select(
        "package_id", "name", "tar_name", "user_name", "user_email", "release_ts", "gate")


def nuget_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the link list of scored packages, so the description takes part in no join."""
    urls = L.nuget_url_string(L.nuget_links(F.col("description")))
    return gate_nuget(FX.nuget_view(spark, sf_dir), F.col("description")).select(
        "package_id", "file_name", "author", "release_ts", "gate", F.when(F.col("gate") == SCORE, urls).alias("urls"))


def image_sink(spark: SparkSession, sf_dir: str, pred: DataFrame) -> DataFrame:
    return L.image_sink_rows(with_result(image_gated(spark, sf_dir), pred), run_time(spark, sf_dir))


def npm_sink(spark: SparkSession, sf_dir: str, pred: DataFrame) -> DataFrame:
    return L.npm_sink_rows(with_result(npm_gated(spark, sf_dir), pred), run_time(spark, sf_dir))


def nuget_sink(spark: SparkSession, sf_dir: str, pred: DataFrame) -> DataFrame:
    return L.nuget_sink_rows(with_result(nuget_gated(spark, sf_dir), pred), run_time(spark, sf_dir))
