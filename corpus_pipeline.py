"""A corpus from raw documents to token ids: quality, near duplicates, personal data, mixture, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Defined cases, alike in all stages: null and empty texts have no words, so the first stage rejects them, and where a later stage is run on them they are kept (no near duplicates,
no personal data, no tokens); equal rows are judged alike, and of equal rows with words the second stage keeps one; a null id comes last; null languages and sources are
groups of their own; columns that documents has besides its own go along whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postlens.llm import byte_bpe, mixing, ngram_join, pii, quality_rules
from postlens.llm.storage import tables, written

#: Share of the tokens that the mixture is to have; one epoch, as near duplicates have just been removed.
BUDGET_SHARE, MAX_EPOCHS = 0.8, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or a cutoff proven safe for its language; a language with few good labels has no cutoffs, a null one is a language of its own."""
    return quality_rules.passed(docs, tables(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of smallest id; rows without words all stay."""
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in the place of personal data; a null text stays null."""
    return pii.pseudonymised(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings domains, languages and sources to their target weights; texts without words go along with their place in the order. What is left out was clean but over its group's budget, which is the stage's task."""
    return mixing.mixed(docs, budget_share=BUDGET_SHARE, max_epochs=MAX_EPOCHS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left and checks it by decoding: number of ids and digests; a null text has no ids."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality_rules", quality), ("ngram_join", near_duplicates), ("pii", personal_data), ("mixing", mixture), ("byte_bpe", tokens)]

#: Binomial bounds, permutations and encoding are beyond SQL; the whole run is tested against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
