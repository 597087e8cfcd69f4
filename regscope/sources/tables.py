"""Readers for the landed tables.

Every reader declares the columns it needs so the parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One landed parquet table; callers select the columns they use."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- S6: domain-rank table --------------------------------------------------
RANK_SCHEMA = T.StructType([T.StructField("domain", T.StringType()),
                            T.StructField("rank", T.LongType())])


def read_domain_rank(spark: SparkSession, path: str) -> DataFrame:
    """CSV ``domain,rank``; the first row for a domain wins (lowest rank kept,
    which is the same row for a file sorted by rank)."""
    df = spark.read.schema(RANK_SCHEMA).option("header", True).csv(path)
    return df.groupBy("domain").agg(F.min("rank").alias("rank"))


def rank_score(rank: Column) -> Column:
    """1 - rank / 1e6 for ranked domains, 0 for unranked ones."""
    from ..constants import RANK_SCALE
    return F.coalesce(F.lit(1.0) - rank / F.lit(RANK_SCALE), F.lit(0.0))


# --- S3: labels -------------------------------------------------------------
def label_text(flag: Column) -> Column:
    """Only a flag equal to 1 means 'abuse'; any other value is 'non-abuse'."""
    return F.when(flag == 1, F.lit("abuse")).otherwise(F.lit("non-abuse"))


def read_labels_csv(spark: SparkSession, path: str, key: str = "package_id") -> DataFrame:
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("label", T.IntegerType())])
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(key, label_text(F.col("label")).alias("label"))


# --- S7: keyword lists ------------------------------------------------------
def read_keyword_json(spark: SparkSession, path: str) -> DataFrame:
    """A ``{kind: [values]}`` JSON file as ``(kind, pos, value)`` rows."""
    raw = spark.read.option("multiLine", True).json(path)
    cols = [F.struct(F.lit(c).alias("kind"), F.col(f"`{c}`").alias("vals")) for c in raw.columns]
    return (raw.select(F.explode(F.array(*cols)).alias("e"))
            .select(F.col("e.kind").alias("kind"), F.posexplode("e.vals").alias("pos", "value")))


# --- S8: word vectors in word2vec text format -------------------------------
def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word v1 .. vn`` lines (first line is a header) -> ``(word, vec array<float>)``."""
    lines = spark.read.text(path)
    parts = F.filter(F.split(F.col("value"), " "), lambda x: x != "")  # trailing blanks
    return (lines.select(parts.alias("p"))
            .where(F.size("p") > 2)  # the "count dim" header line has two fields
            .select(F.col("p")[0].alias("word"),
                    F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.try_cast("float")).alias("vec")))
