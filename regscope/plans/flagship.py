"""Flagship: score image packages end to end.

gate -> features (URL, code, semantic, popularity) -> author context ->
stored forest (fitted once per snapshot on the labelled train side) -> result rows for every package
(gate outcome, or the forest's label for scored packages).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import links as L
from ..profiles import IMAGE
from ..session import cut_lineage
from . import image as IMG
from .scoring import predictions, with_result


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = IMG.narrow_packages(spark, sf_dir)           # the only pass over the text
    ft = cut_lineage(IMG.feature_table(spark, sf_dir, narrow=narrow))
    preds = predictions(spark, sf_dir, IMAGE, ft)
    return L.image_result_rows(with_result(narrow.select("package_id", "name", "namespace", "gate"), preds))
