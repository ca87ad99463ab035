"""Exact duplicates by progressive refinement.

Documents are grouped by the length of their normalised text, those that share a
length by a hash of their first characters, those that share that too by a
hash of the whole text. Only numbers are shuffled, combined map-side; a document
already alone is not hashed any further. Survivors of a round are recognised in the
next scan by a bitmap of fixed size, so texts never leave their partition.

Defined results: a null text counts as empty; an empty table gives an empty
result; rows with one doc_id are one document, so repeats of a row share its
verdict while each counts in the group's size; a null doc_id never stays in favour of a known
one, and keep_id is null only if all doc_ids of the group are. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import SPACES, Members
from sparkloom.storage import table

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept``, and ``carry``.

    ``carry`` names further expressions over the input, taken along unchanged.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *((carry or {})[k].alias(k) for k in carry or {}))
    base = rows.withColumn("_norm", normalised(F.col("_text"))).withColumn("_len", F.length("_norm").cast("long"))

    by_len = base.groupBy("_len").count().where("count > 1")
    shared_len = Members(by_len, "_len")
    prefixed = shared_len.mark(base, F.col("_len"), "_maybe").withColumn(
        "_prefix", F.when(F.col("_maybe"), F.xxhash64("_len", F.substring("_norm", 1, PREFIX_CHARS)))
    )

    by_prefix = prefixed.where("_prefix is not null").groupBy("_prefix").count().where("count > 1")
    shared_prefix = Members(by_prefix, "_prefix")
    hashed = shared_prefix.mark(prefixed, F.coalesce("_prefix", F.lit(0)), "_again").withColumn(
        "_full", F.when(F.col("_maybe") & F.col("_again"), F.sha2("_norm", 256))
    )
    hashed = table(hashed.select("_id", "_full", *(carry or {})))

    groups = (
        hashed.where("_full is not null")
        .groupBy("_full")
        .agg(F.min("_id").alias("_keep"), F.count("*").alias("_size"))
        .where("_size > 1")
    )
    # written, so that the join's sides are both plain exchanges and a group of copies can be split;
    # documents told apart before the last round have no key and stay out of it
    sure = hashed.where("_full is null").withColumn("_keep", F.col("_id")).withColumn("_size", F.lit(1).cast("long"))
    out = hashed.where("_full is not null").join(table(groups), "_full", "left").unionByName(sure)
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("_id")).alias("kept"),
        *(carry or {}),
    )
