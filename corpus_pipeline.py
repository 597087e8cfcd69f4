"""A training corpus from raw documents: five stages, each over all that the last one kept.

toxicity        toxic documents go
ngram_jaccard   one document of each group of near duplicates stays
pii             personal data is masked in the texts
mixing          documents are repeated or dropped to reach the source targets
sentence_pieces texts become token ids

All stages but the last return the columns of ``documents``; each stage's table is
deleted when the next one is written.

Cases: documents without text or words stay through all stages and end as the end
id alone (unless their source's rate draws no copy). Rows that repeat an id are
rows of their own, but for the near duplicates among them. A null id or source is a
value like others. Empty tables give an empty result. The table may have more
columns; the last stage leaves them out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regscope.llm import mixing, ngram_join, pii, sentence_pieces, toxicity
from regscope.llm.common import dropped, small_batches, table, written
from regscope.llm.queries import TOKENIZERS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (end id last) of every row."""
    small_batches(spark)
    model = sentence_pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    encoded = sentence_pieces.encode(docs.select("doc_id", "lang", "source", "text"), model, offsets=False, cache=32 << 20)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentence_pieces", encode_texts),
]

# A trained score, connected components and a tokenizer: SQL can't express the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
