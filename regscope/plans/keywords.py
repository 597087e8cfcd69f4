"""Keywords of each registry's scored packages, from their texts, with vector ids.

tokens -> stop words -> counts -> (image, NuGet) nouns and verbs -> top k. The rows
``(package_id, pos, word, vec_id)`` are stored once per input snapshot, like the
packages; the distances and feature matrices read them.

A word's vector is the row of ``embeddings`` whose id is the word's hash (the first 12
hex digits of its md5) modulo the table's size plus ``OUT_OF_VOCABULARY``; the
highest ids have no vector. Platform words and word lists get theirs by the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import text_features as TF
from ..operators.gates import SCORE, gate_npm, gate_nuget, npm_text, nuget_text
from ..profiles import IMAGE, NPM, NUGET, RegistryProfile
from ..sources import fixtures as FX
from ..sources.store import materialized
from ..sources.tables import table

OUT_OF_VOCABULARY = 20
PACKAGE_INPUTS = ["documents", "pages", "labels", "events"]


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon is an input resource: derived once per snapshot and stored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return materialized(spark, "lexicon", sf_dir, ["documents"],
                        lambda: TF.lexicon_from_corpus(TF.token_rows(docs, "doc_id", F.col("text"))))


def vector_id(word: Column, n_vectors: Column) -> Column:
    """The id of a word's vector (beyond the table's ids for a few words)."""
    return F.conv(F.substring(F.md5(word), 1, 12), 16, 10).cast("long") % (n_vectors + OUT_OF_VOCABULARY)


def with_vector_id(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").select(F.count(F.lit(1))).scalar()
    return words.withColumn("_n", n).withColumn("vec_id", vector_id(F.col("word"), F.col("_n"))).drop("_n")


def word_vectors(spark: SparkSession, sf_dir: str, words: list[str]) -> DataFrame:
    """``(word, vec_id, vec)`` of a word list; words without a vector drop out."""
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in words])).alias("word"))
    return with_vector_id(spark, sf_dir, rows).join(FX.vectors(spark, sf_dir), "vec_id")


def platform_vectors(spark: SparkSession, sf_dir: str, profile: RegistryProfile) -> DataFrame:
    return word_vectors(spark, sf_dir, C.PLATFORM_WORDS[profile.platform])


def _scored_texts(spark: SparkSession, sf_dir: str, profile: RegistryProfile) -> DataFrame:
    """``(package_id, text)`` of the packages that pass the registry's gate."""
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    if profile is IMAGE:
        from .image import candidates
        return candidates(spark, sf_dir).select("package_id", "text")
    if profile is NPM:
        rows, text = gate_npm(FX.npm_view(spark, sf_dir)), npm_text(c("name"), c("description"), c("readme"))
    else:
        rows, text = gate_nuget(FX.nuget_view(spark, sf_dir), F.col("description")), nuget_text(F.col("file_name"), F.col("description"))
    return rows.where(F.col("gate") == SCORE).select("package_id", text.alias("text"))


def keywords(spark: SparkSession, sf_dir: str, profile: RegistryProfile) -> DataFrame:
    """``(package_id, pos, word, vec_id)``: the top words of every scored package."""
    def build() -> DataFrame:
        # npm keeps all words; the others keep nouns and verbs.
        tags = None if profile is NPM else lexicon(spark, sf_dir)
        words = TF.keywords(_scored_texts(spark, sf_dir, profile), "package_id", F.col("text"), profile.top_k_words, tags)
        return with_vector_id(spark, sf_dir, words)
    return materialized(spark, f"keywords-{profile.name}", sf_dir, [*PACKAGE_INPUTS, "embeddings"], build)
