"""Raw documents to packed training sequences, in five stages. Each works on all that its predecessor kept.

Stages take (spark, docs, sf_dir) and give back the columns of documents, the last one packed pieces. Null and empty
tables, extra columns and repeated rows are handled as the operators' docstrings say.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstream.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from curbstream.llm.common import stage
from curbstream.sources.tables import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Documents whose language is unknown or less sure than this are rejected.
LEAST_SCORE = 0.4


def _keep(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The input rows whose id is in ``ids`` (doc_id), with all their columns."""
    return docs.join(ids.select(F.col("doc_id").alias("_kept")), docs[doc_id].eqNullSafe(F.col("_kept")), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents of the stage's own input; drops rows without letters or without a sure language."""
    if "lang" not in docs.columns:
        raise ValueError("the language stage learns from the column lang")
    net = language_id.fit(docs)
    return language_id.annotate(docs, net).where((F.col("_lang_pred") != language_id.UNKNOWN) & (F.col("_lang_score") >= LEAST_SCORE)).drop("_lang_pred", "_lang_score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays."""
    c = jaccard_join.jaccard_components(docs)
    return _keep(docs, c.where("doc_id <=> component_id").select("doc_id").distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows of copies are repeated, those not taken go."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place; a document taken twice has each piece twice."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mix), ("best-fit packing", pack)]
#: A trained network and a tokenizer have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
