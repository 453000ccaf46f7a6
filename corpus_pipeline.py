"""A corpus pipeline of four operators; each stage reads what the one before has kept.

Counted as part of ``inodelake.llm``. Stages take (spark, docs, sf_dir) and return a DataFrame;
all but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inodelake.llm import langid, mixing, ngram_join, packing
from inodelake.runtime import free_name, table, written

#: Words that a worker remembers for packing: less than alone, as it holds what the other stages remember too.
WORDS = 150_000
#: A label is taken for wrong if another language is found with this score or more.
CONFIDENT = 0.9


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that doesn't contradict their label.

    Texts without a letter go (null, empty and blank ones too), and those whose
    label is a learned language other than the one found with CONFIDENT score or more. Texts of
    any length are read whole. A null label, source or id is no reason to go; repeated rows stay. If no
    language can be learned, the letter alone decides. An empty table gives no
    rows. Columns may have any names beside text, lang and doc_id.
    """
    model = langid.train(docs)
    if model is None:
        return docs.where(langid.lettered(F.col("text")))
    found = free_name("__found", *docs.columns)
    known = docs.withColumn(found, langid.language(docs, model))
    pred, score = F.col(f"{found}.lang_pred"), F.col(f"{found}.score")
    contradicted = F.coalesce(F.col("lang").isin(model.languages) & (F.col("lang") != pred) & (score >= CONFIDENT), F.lit(False))
    return known.where((pred != langid.UNKNOWN) & ~contradicted).drop(found)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), repeated rows included.

    A null, empty or wordless text is no copy of another and stays; one of fewer than five words
    is a copy of those with the same words. Texts of any length are compared whole. An empty
    table gives no rows. Columns may have any names beside text.
    """
    return ngram_join.near_unique(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null, empty and blank texts count no words and are taken at their source's rate like others; null sources are one source;
    repeated rows are documents of their own. The same rows are taken whatever their order. An
    empty table gives no rows. Columns may have any names beside text and source.
    """
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; long texts are cut into pieces; repeated rows and
    rows without an id are packed like others. An empty table gives no rows; columns other than
    doc_id and text are ignored.
    """
    return packing.pack(docs, 2048, memory=WORDS)


STAGES = [
    ("language_id", language_stage),
    ("near_copies", near_copy_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL can't express the learned language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
