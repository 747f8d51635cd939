"""A corpus pipeline of five operators; each stage's result is written and read again.

The stages see documents (doc_id, text, lang, source, n_chars) and all but the last return
these columns. Mixing takes each document once at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.bpe import bpe_round_trip
from graphloom.llm.common import clear_stored, stored, stored_so_far, table
from graphloom.llm.exact_dedup import drop_exact_copies
from graphloom.llm.mixing import mix
from graphloom.llm.ngram_join import drop_near_copies
from graphloom.llm.queries_corpus import WEIGHTS, vocabulary
from graphloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest doc_id."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens left, at the target weights."""
    return mix(docs, share=(4, 5), max_epochs=1, seed=7, weights=WEIGHTS).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe_round_trip(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("n-gram Jaccard join", ngram_join), ("mixing sources to target weights", mixing), ("BPE encoding and decoding", bpe)]

#: Learned scores can't be expressed in SQL; tests compare run() with its stages, and each operator with brute force or held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage stored is deleted when its result is written, what was stored before the run isn't.

    As the stages' operators define: null texts are empty; rows with a null doc_id, and texts without words, stay until mixing,
    which never takes them; repeated rows are copies; columns beside documents' own go along under their names until the last
    stage; an empty table gives an empty result.
    """
    docs, before = table(spark, sf_dir, "documents"), stored_so_far()
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        clear_stored(spark, docs, before)
    return docs
