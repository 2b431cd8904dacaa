"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and gives the next one's docs; all but
the last return the columns of ``documents``. ``run`` writes each stage's
result as Parquet in the shared folder and reads it again, so the loss of an
executor repeats a part of one stage at most; a folder is deleted as soon as
the next one is written, but for the last, which the result reads.

Defined results, beside those of the operators: null and empty texts don't
pass the first stage; repeated rows are near copies, of which one stays; very
long texts are read whole; an empty table gives no rows; columns of other names
are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import _shared, bpe, langid, mixing, quality, simhash


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled documents vote for; null and empty texts go; a null doc_id stays."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with confidence; texts without letters go."""
    return langid.keep(docs)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; null texts stay."""
    return simhash.keep(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and in the order in which the schedule of sources takes them; a null source counts as ''."""
    return mixing.mix(docs)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, place, n_tokens, token_ids, round_trip): ids of whole texts, and whether they decode to them.

    In the order of ``place`` the documents stand as in the Parquet folder that
    ``docs`` scans, so as the schedule has them; it is null for other inputs.
    """
    name = _shared.fresh(docs.columns, "_place")[0]
    tokens = bpe.encode(_shared.placed(docs, name), place=name, back=True)
    return tokens.select("doc_id", "place", "n_tokens", "token_ids", F.xxhash64("decoded").eqNullSafe(F.col("mark")).alias("round_trip"))


STAGES = [
    ("quality", _quality),
    ("language", _language),
    ("near_copies", _near_copies),
    ("mixing", _mixing),
    ("bpe", _tokens),
]

#: Trained models and tokenizers aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = _shared.written(stage(spark, docs, sf_dir), name)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before is not None:
            _shared.dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
