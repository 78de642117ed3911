"""Exact deduplication by a tree of merged digest runs. DataFrame functions only.

Every row becomes a fingerprint (SHA-256 of the normalised text, verified by its length
and a second, independent hash). The fingerprints of a group of input partitions, sorted by
digest and written so, are one run. The 2 ** `ROUNDS` runs are merged in binomial rounds: in
each, a run meets its neighbour, their entries are exchanged by digest, sorted (a merge, as
what arrives are sorted stretches: Spark's sort finds and merges them) and combined by a
streaming pass over the sorted entries, which keeps for each verified digest the smallest
identifier and the number of rows. What is left is one run, spread over the cluster by
digest. A digest that a third of all rows share is reduced to one entry per task before the
first exchange and one entry per run after it, so no task ever meets the group as a whole.

Defined results: null text counts as empty; a null identifier sorts after all others; of
rows with the same identifier and normalised text exactly one stays, the one whose text and
other columns (as JSON) sort first; an empty table gives an empty result; other columns pass
through `keep_first` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import SPACES, first_row, stored, whole_text

ROUNDS = 6
KEY = ["digest", "octets", "check"]


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, digest, octets, check of each row; texts are equal when the last three are."""
    text = F.regexp_replace(whole_text(), SPACES + "+", " ")
    return docs.select("doc_id", text.alias("text"), *carried).select(
        "doc_id", *carried,
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.octet_length("text").alias("octets"),
        F.xxhash64("text").alias("check"),
    )


def numbered(prints: DataFrame) -> DataFrame:
    """Rows get a number, which settles ties, and their first run, and are sorted by digest. Store
    the result: numbers are only stable once written."""
    return prints.select(
        "*",
        F.monotonically_increasing_id().alias("row_no"),
        (F.spark_partition_id() % (2 ** ROUNDS)).alias("run"),
    ).sortWithinPartitions("run", *KEY)


def merge_runs(prints: DataFrame) -> DataFrame:
    """One row per verified digest: its first row (`head`) and its `group_size`."""
    merged = prints.select(
        "run", *KEY,
        F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_no").alias("head"),
        F.lit(1).cast("long").alias("group_size"),
    )
    for level in range(ROUNDS + 1):
        # The smallest of structs has no place in a hash table: Spark sorts and merges.
        merged = merged.groupBy("run", *KEY).agg(
            F.min("head").alias("head"), F.sum("group_size").alias("group_size")
        )
        if level < ROUNDS:
            merged = merged.withColumn("run", F.shiftright("run", 1))
    return merged.drop("run")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    prints = stored(numbered(fingerprints(docs)), "digest-runs")
    winners = stored(merge_runs(prints), "digest-winners")
    return prints.join(winners, KEY).select(
        "doc_id",
        F.col("head.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("head.row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all their columns as they were."""
    prints = stored(numbered(fingerprints(docs)), "digest-runs")
    heads = merge_runs(prints).select(F.col("head.doc_id").alias("keep_id"), *KEY)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    keyed = fingerprints(rows, "row")
    kept = keyed.join(
        heads,
        keyed.doc_id.eqNullSafe(heads.keep_id)
        & (keyed.digest == heads.digest) & (keyed.octets == heads.octets) & (keyed.check == heads.check),
        "left_semi",
    )
    # Rows equal in identifier and text are still there more than once, side by side.
    return kept.groupBy("doc_id", *KEY).agg(first_row(docs).alias("row")).select("row.*")
