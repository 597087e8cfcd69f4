"""Fitted forests kept in shared storage (M6).

```
<shared>/forests/<name>-<key>/try-<id>/model         the fitted pipeline, in parts, and its importances
<shared>/forests/<name>-<key>/try-<id>/data          the labelled rows, by split
```

``key`` covers the input files and the settings of the fit, so a changed input or setting
gives another model and every job on the same snapshot loads the same one. A fit is published
by a manifest (``commits.published``): it counts whole or not at all.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model as M
from ..session import shared_path
from .commits import published


@dataclass(frozen=True)
class ForestSettings:
    split_key: str = "package_id"
    test_share: float = 0.3
    num_trees: int = 100
    max_depth: int = 15
    seed: int = 0


@dataclass(frozen=True)
class StoredForest:
    """A published fit: its folder, read anew by every job."""

    spark: SparkSession
    path: str

    def model(self) -> M.Forest:
        return M.load_forest(self.spark, f"{self.path}/model")

    def rows(self, split: str) -> DataFrame:
        """The labelled rows of ``train`` or ``test``; only that split's files are read."""
        return self.spark.read.parquet(f"{self.path}/data").where(F.col("split") == split)


def stored_forest(spark: SparkSession, name: str, key: str, settings: ForestSettings,
                  labelled: Callable[[], DataFrame]) -> StoredForest:
    """The forest of ``settings`` on the rows of ``labelled()`` (features, label and the split key),
    fitted only if none is published under ``key``.

    The labelled rows are written first and the fit reads them from there, so the feature plan runs
    once and the kept matrices are the ones that the model saw."""
    settings_key = hashlib.sha1(json.dumps(asdict(settings), sort_keys=True).encode()).hexdigest()[:12]

    def fit(folder: str) -> None:
        M.split_rows(labelled(), settings.split_key, settings.test_share).write.partitionBy("split").parquet(f"{folder}/data")
        train = StoredForest(spark, folder).rows("train")
        model = M.fit_forest(train, num_trees=settings.num_trees, max_depth=settings.max_depth, seed=settings.seed)
        M.save_forest(model, spark, f"{folder}/model")

    return StoredForest(spark, published(spark, shared_path(spark, "forests", f"{name}-{key}-{settings_key}"), fit))
