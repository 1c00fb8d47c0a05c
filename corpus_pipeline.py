"""A corpus pipeline: quality rules, language identification, near-duplicate removal, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.llm import language, near_dups, packing, pii, quality
from skylane.llm.common import stage, table
from skylane.llm.entries import public_tokenizers

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject; rules are learned from the labels of the documents at hand.

    A null or empty text has too few words and goes; repeated rows are judged alike; an empty table stays empty.
    """
    return quality.judge(docs, table(spark, sf_dir, "labels"), keep=COLUMNS[1:]).filter("kept").select(*COLUMNS)


#: Posterior from which a prediction is held against another recorded language.
SURE = 0.9


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text has no language (und) or none that is likelier than not, and those recorded as of another language than the text surely is of.

    A null language contradicts nothing; the model is learned from the documents at hand. An empty table stays empty.
    """
    judged = language.predict(docs, language.fit(docs), keep=COLUMNS[1:])
    contrary = F.col("lang").isNotNull() & (F.col("lang") != F.col("lang_pred")) & (F.col("score") >= SURE)
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.5) & ~contrary).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of every group of near duplicates, of 5-word shingles alike by 0.8.

    Rows that share a doc_id are one document and stay or go together; a null doc_id stays.
    """
    kept = near_dups.near_duplicates(docs, percent=80).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; every document stays, a null text as an empty one."""
    found = pii.find_pii(docs, keep=COLUMNS[1:])
    clean = found.withColumn("text", pii.redact(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into windows of 4096; one row for each piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("language", keep_languages),
    ("near duplicates", keep_one_of_each),
    ("personal data", hide_personal_data),
    ("packing", pack_windows),
]

#: Learned models and tokenizers can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
