"""Registered queries of the dealt operators and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liftlake.llm import collocations as _collocations
from liftlake.llm import decontaminate as _decontaminate
from liftlake.llm import exact as _exact
from liftlake.llm import jaccard as _jaccard
from liftlake.llm import language as _language
from liftlake.llm import manifest as _manifest
from liftlake.llm import neighbours as _neighbours
from liftlake.llm import oracle as _oracle
from liftlake.llm import personal as _personal
from liftlake.llm import pieces as _pieces
from liftlake.llm import quality as _quality
from liftlake.llm import secrets as _secrets
from liftlake.llm import spans as _spans
from liftlake.llm import toxicity as _toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.jaccard_classes(_table(spark, sf_dir, "documents")).drop("set_key", "kept", "file", "row")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.secret_scan(_table(spark, sf_dir, "documents")).drop("spread")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _language.predict(docs, _language.train(docs))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(_table(spark, sf_dir, "documents")).drop("file", "row")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _quality.score(docs, _quality.train(docs, _table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _toxicity.score(docs, _toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items", "starts", "ends")


def op8_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _personal.personal_data(docs, _personal.train(docs))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces.encode(_table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest.manifest(_table(spark, sf_dir, "documents"))


def op13_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_secret_scan": op2_secret_scan,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_repeat_removal": op8_repeat_removal,
    "op9_personal_data": op9_personal_data,
    "op10_piece_sampling": op10_piece_sampling,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_embedding_neighbours": op13_embedding_neighbours,
}

# The others have no SQL: learned models, sampled segmentations, and two whose
# SQL would compare all pairs or list all 50-byte strings; tests/llm has their
# plain versions.
ORACLE: dict[str, str] = {
    "op2_secret_scan": _oracle.SECRETS,
    "op4_exact_dedup": _oracle.EXACT,
    "op7_benchmark_decontamination": _oracle.CONTAMINATION,
    "op11_phrase_collocations": _oracle.COLLOCATIONS,
    "op12_merkle_manifest": _oracle.MANIFEST,
    "op13_embedding_neighbours": _oracle.NEIGHBOURS,
}
