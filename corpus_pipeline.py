"""From raw documents to token ids: five stages, each over all that the one before kept.

1. toxicity: documents predicted toxic go (model fitted on the labelled rows in the stage's input).
2. line dedup: of each group of near-equal lines one occurrence stays; documents stay, if
   need be with an empty text.
3. SimHash near-dedup: of each group of near-equal documents the one with the smallest doc_id stays.
4. mixing: documents as often as their source's target takes them, as repeated rows.
5. SentencePiece: ids of every row.

Stages 1 to 4 return the columns of ``documents``, with ``n_chars`` of the text as it is then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.line_dedup import line_dedup
from sparkloom.llm.mixing import mixed_documents
from sparkloom.llm.pieces import encode
from sparkloom.llm.simhash import keep_one
from sparkloom.llm.toxicity import fit, labelled_sample, without_toxic
from sparkloom.session import read_table
from sparkloom.storage import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return without_toxic(docs, fit(labelled_sample(docs, labels)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup(docs).drop("removed")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", near_stage),
    ("source_mix", mix_stage),
    ("sentencepiece", token_stage),
]

#: The stages train, hash and tokenise in ways SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs)
    return docs
