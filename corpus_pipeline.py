"""Documents to token ids, in five stages; each works on all that the one before it kept.

Every stage but the last returns the columns of documents. Stages with nulls, empty tables and
repeated rows behave as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.llm import langid, mixing, ngramjoin, pieces, secrets
from spoorline.llm.common import discard, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in a language that the models know; lang becomes that language.

    Documents without text or without a letter (und) go.
    """
    found = langid.predict(docs.select(*COLUMNS), langid.fit(docs))
    return found.filter(F.col("_lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("_lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Rows without shingles stay; of rows that repeat an id and a text one stays. Different texts
    under one id are documents of their own.
    """
    return ngramjoin.one_of_each_group(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by [secret]; n_chars follows. All documents stay."""
    return secrets.redact(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the mix takes them, up to three times; those it doesn't take go."""
    mixed = mixing.mix(docs, keep=COLUMNS)
    return mixed.filter("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids, their number and digest, and whether decoding gave the text back."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("secret_scans", without_secrets),
    ("source_mixing", mixture),
    ("sentencepiece", token_ids),
]

#: Models, links and searches aren't SQL; the tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before, docs = docs, written(out, f"stage-{name}")
        discard(before)
