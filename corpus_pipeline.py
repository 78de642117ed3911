"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
`docs`; the last adds the ids of its texts. Labels come from the folder of the tables.

Defined results: null and empty texts are judged, deduplicated and encoded as texts without words
(the operators' docstrings say how); rows repeated whole are one document after the second
stage; a null doc_id is an id like any other and comes after all others; columns beside
those of `documents` pass through, whatever their names; an empty table stays empty in every
stage. Written stages go when the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import exact_dedup, mixing, near_dedup, pieces, quality_classifier
from touchline.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the first stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of all runs of five words) the first stays."""
    return near_dedup.keep_one(docs, width=5, link=80)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarce domains are repeated until the domains' tokens meet their targets."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts as ids of pieces, in column `piece_ids`, without the texts."""
    return pieces.encode(docs).drop("text")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("pieces", encode_pieces),
]

#: Trained models, registers and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read back before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
