"""Model loop.

Feature vectors stay named columns (or ``array<double>``) until the final
``VectorAssembler``/``array_to_vector``; the forest is Spark ML's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

LABELS = ("abuse", "non-abuse")
# MB of node statistics that a task of the fit holds at a time.
FIT_MB = 256
# Nodes of a forest that the driver writes, loads or sends to a scoring job at a time.
PART_NODES = 200_000


# --- labels, splits, samples -------------------------------------------------
def labelled(packages: DataFrame, labels: DataFrame, key: str = "package_id") -> DataFrame:
    """Packages with a label (equi-join on the key)."""
    return packages.join(labels, key)


def labelled_by_name(packages: DataFrame, labels: DataFrame, name: str = "name") -> DataFrame:
    """J1 by name, first match: the package with the lowest id of each name.

    Null names match no label and are dropped first; ids alone are combined per
    name, map-side, and the packages' rows come by id."""
    first = packages.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("package_id").alias("package_id"))
    return packages.join(first.join(labels, name).drop(name), "package_id")


def training_set(abuse: DataFrame, benign: DataFrame) -> DataFrame:
    """Union of the two label sets, duplicates kept."""
    return abuse.unionByName(benign)


def split_threshold(test_share: float) -> str:
    """md5 prefixes below this 8-hex-digit string go to the test side."""
    return format(int(test_share * 16 ** 8), "08x")


def split_rows(df: DataFrame, key: str, test_share: float = 0.3) -> DataFrame:
    """L3: stateless per-row split on the key's md5 prefix; every class gets
    ~``test_share`` test rows (npm uses ``test_share=0.7``)."""
    prefix = F.substring(F.md5(F.col(key).cast("string")), 1, 8)
    return df.withColumn("split", F.when(prefix < F.lit(split_threshold(test_share)), F.lit("test"))
                         .otherwise(F.lit("train")))


def sample_per_group(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """L2: a reproducible sample of ``n`` rows per group (top-n by md5 of the key).
    The filter on ``row_number`` lets Spark run a partial group limit before
    the exchange, so a hot group ships at most n rows per partition."""
    w = Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def slice_rows(df: DataFrame, order: str, skip: int, take: int) -> DataFrame:
    """L1: rows ``skip+1 .. skip+take`` in a total order."""
    return df.orderBy(order).offset(skip).limit(take)


def label_counts(df: DataFrame) -> DataFrame:
    """A21."""
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- metrics ------------------------------------------------------------------
def weighted_metrics(pred: DataFrame, label: str = "label", prediction: str = "pred") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 from the
    confusion counts (precision of a never-predicted class is 0)."""
    conf = pred.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("c"))
    true_n = conf.groupBy(F.col(label).alias("cls")).agg(F.sum("c").alias("support"))
    pred_n = conf.groupBy(F.col(prediction).alias("cls")).agg(F.sum("c").alias("predicted"))
    tp = conf.where(F.col(label) == F.col(prediction)).select(F.col(label).alias("cls"), F.col("c").alias("tp"))
    per = (true_n.join(pred_n, "cls", "full").join(tp, "cls", "left")
           .select("cls", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("support", "predicted", "tp")]))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.select("*", p.alias("p"), r.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0))
    total = F.sum("support")
    return per.select("*", f1.alias("f1")).agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("p") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"))


# --- normalisation -------------------------------------------------------------
def minmax_long(rows: DataFrame, idx: str = "i", value: str = "value") -> DataFrame:
    """A18 on a long matrix ``(row, i, value)``: scale each column to [0, 1], but
    only when every column varies; otherwise return the values unchanged.
    Column statistics are one small aggregate (one row per column)."""
    stats = rows.groupBy(idx).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    every_varies = stats.select(F.min((F.col("_hi") != F.col("_lo")).cast("int")) == 1).scalar()
    # one row per feature column: bounded by the vector width
    out = rows.join(F.broadcast(stats.withColumn("_all", every_varies)), idx)
    scaled = F.when(F.col("_all"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col(value))
    return out.withColumn(value, scaled).drop("_lo", "_hi", "_all")


# --- forest ---------------------------------------------------------------------
def assemble(df: DataFrame, features: str = "features") -> DataFrame:
    """M1: ``array<double>`` -> ML vector."""
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("fv", array_to_vector(F.col(features)))


def fit_forest(train: DataFrame, features: str = "features", label: str = "label",
               num_trees: int = 100, max_depth: int = 15, seed: int = 0):
    """M2: a 100-tree Gini forest with sqrt feature sampling. Spark caps depth
    and bins features, so results match an unbounded forest only in tolerance."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer
    idx = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc").fit(train)
    # cacheNodeIds keeps each row's node id on the executors (checkpointed to
    # the shared checkpoint dir) instead of shipping the growing trees every
    # level. Every task of a pass holds the statistics of that pass's nodes: more of them
    # mean fewer passes, but an executor needs them once per core.
    rf = RandomForestClassifier(featuresCol="fv", labelCol="label_idx", numTrees=num_trees, impurity="gini",
                                featureSubsetStrategy="sqrt", maxDepth=max_depth, maxBins=128, seed=seed,
                                cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=FIT_MB)
    back = IndexToString(inputCol="prediction", outputCol="pred", labels=idx.labels)
    return Pipeline(stages=[idx, rf, back]).fit(assemble(train, features))


@dataclass(frozen=True)
class Forest:
    """A stored forest: pipelines of some of its trees each, in their order, and its importances."""

    spark: SparkSession
    parts: list[str]
    labels: list[str]
    weights: list[float]

    def load(self):
        """The parts, one at a time: the whole forest is nowhere in one piece."""
        from pyspark.ml import PipelineModel
        return map(PipelineModel.load, self.parts)


def save_forest(model, spark: SparkSession, path: str) -> None:
    """Write a fitted pipeline for ``load_forest``, some ``PART_NODES`` nodes at a time (one tree at least)."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassificationModel
    index, rf, back = model.stages
    java, jvm, gateway = rf._java_obj, spark.sparkContext._jvm, spark.sparkContext._gateway
    groups, nodes = [], PART_NODES
    for tree in java.trees():
        if nodes + tree.numNodes() > PART_NODES:
            groups.append([])
            nodes = 0
        groups[-1].append(tree)
        nodes += tree.numNodes()
    for k, trees in enumerate(groups):
        array = gateway.new_array(jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(trees))
        for i, tree in enumerate(trees):
            array[i] = tree
        part = jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
            rf.uid, array, rf.numFeatures, rf.numClasses)
        java.copyValues(part, jvm.org.apache.spark.ml.param.ParamMap())
        part.set(part.getParam("numTrees").w(len(trees)))
        PipelineModel([index, RandomForestClassificationModel(part), back]).write().save(f"{path}/part-{k:05d}")
    weights = [float(w) for w in rf.featureImportances.toArray()]
    spark.createDataFrame([(len(groups), list(back.getLabels()), weights)],
                          "parts int, labels array<string>, weights array<double>").coalesce(1).write.parquet(f"{path}/about")


def load_forest(spark: SparkSession, path: str) -> Forest:
    about = spark.read.parquet(f"{path}/about").first()
    return Forest(spark, [f"{path}/part-{k:05d}" for k in range(about.parts)], about.labels, about.weights)


def score(model, df: DataFrame, features: str = "features") -> DataFrame:
    """M3: predicted label string in ``pred``, by a fitted pipeline or a stored forest.

    A forest of several parts scores part by part; the votes of the parts before are a column of the rows."""
    if isinstance(model, Forest):
        if len(model.parts) > 1:
            return _score_parts(model, df, features)
        model = next(model.load())
    return model.transform(assemble(df, features)).drop("fv", "rawPrediction", "probability", "prediction",
                                                         "label_idx")


def _score_parts(forest: Forest, df: DataFrame, features: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    columns = [F.col(c) for c in df.columns]
    votes = None
    for part in forest.load():
        now = vector_to_array(F.col("rawPrediction"))
        votes = now if votes is None else F.zip_with("_votes", now, lambda a, b: a + b)
        df = cut_lineage(part.stages[1].transform(assemble(df, features)).select(*columns, votes.alias("_votes")))
    # The first of the classes with most votes, as the pipeline has it.
    best = F.array_position("_votes", F.array_max("_votes"))
    return df.select(*columns, F.element_at(F.array(*[F.lit(x) for x in forest.labels]), best.cast("int")).alias("pred"))


def importances(forest: Forest, names: list[str]):
    """M5: (index, name, importance) rows — a driver-side list of the model's
    width, not of the data."""
    return [(i, names[i] if i < len(names) else f"f{i}", v) for i, v in enumerate(forest.weights)]
