"""A training corpus from raw documents: five stages, each written as Parquet and reread.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept. All but the last return the columns of ``documents``; the last writes the token store
and returns, read back from it, one row per document of the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boutique.llm import decontaminate, frames, mixing, near_dups, token_store, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject (score below 0.5)."""
    frames.ready(spark)
    return toxicity.clean_documents(docs, frames.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the smallest id."""
    frames.ready(spark)
    return near_dups.first_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth."""
    frames.ready(spark)
    return decontaminate.clean_documents(docs, frames.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    frames.ready(spark)
    return mixing.mix_documents(docs)


def store_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token store of the mix: doc_id, start, n_tokens, ids_crc32, read back."""
    frames.ready(spark)
    return token_store.store_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_ids", store_token_ids),
]

#: Learned scores, sketches and tokenizers aren't SQL: tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread,
    and what the stage has needed for it is deleted (but for the token store, the product)."""
    frames.ready(spark)
    docs = frames.table(spark, sf_dir, "documents")
    mark = frames.scratch_mark()
    for name, stage in STAGES:
        docs = frames.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        frames.drop_since(spark, mark, docs)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
