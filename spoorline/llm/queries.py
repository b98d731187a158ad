"""The registered queries of the operators in this folder, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from spoorline.llm import langid, merkle, mixing, ngramjoin, pieces, pii, quality, secrets, substrings, urls
from spoorline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


@query
def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fails")
    return quality.quality(table(spark, sf_dir, "documents")).select(*kept)


ORACLES["op1_capped_water_filling"] = mixing.ORACLE
ORACLES["op2_quality_ledger"] = quality.ORACLE
ORACLES["op7_blob_ledger_secrets"] = secrets.ORACLE
ORACLES["op9_ngram_jaccard_join"] = ngramjoin.ORACLE


@query
def op3_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op4_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op6_streaming_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


@query
def op7_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_next(table(spark, sf_dir, "documents"))


@query
def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


@query
def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
