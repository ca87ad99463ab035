"""An incremental passage index: new documents become chunks and postings as they arrive.

Each micro-batch is written under its own batch id, so a batch replayed after a failure overwrites
itself and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.functions.text import tokens
from sparkloom.operators.chunking import chunk_documents
from sparkloom.sources.corpus import corpus_from_table


def index_stream(docs: DataFrame, folder: str, checkpoint: str, cfg: dict | None = None, once: bool = True) -> StreamingQuery:
    """Start the stream: ``folder/chunks`` and ``folder/postings``, partitioned by ``batch``.

    ``docs`` is a streaming frame of ``doc_id, text, lang, source``. With ``once`` the stream ends when it has
    taken in what is there.
    """
    strategy = cfg or {"strategy": "sentence_window"}

    def put(batch: DataFrame, number: int) -> None:
        chunks = chunk_documents(corpus_from_table(batch), strategy)
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{folder}/chunks/batch={number}")
        terms = stored.select("chunk_id", F.explode(tokens(F.col("text"))).alias("term"))
        terms.groupBy("chunk_id", "term").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")

    writer = docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_index(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """``chunks`` and ``postings`` of all batches."""
    return spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/postings")
