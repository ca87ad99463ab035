"""Chunking strategies: each turns a corpus into ordered chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import PARAGRAPH_BREAK, sentences, strip

# Defaults of the strategies.
WINDOW, STRIDE, SIZE, OVERLAP = 3, 2, 900, 150


def paragraph_texts(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, PARAGRAPH_BREAK), strip), lambda p: p != "")


def _starts(n: Column, step: int, reach: int) -> Column:
    """0, step, 2*step, ... below ``n``, up to the first window that reaches the end."""
    every = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda s: (s == 0) | (s - step + reach < n))


def sentence_window_texts(sents: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """Runs of ``window`` sentences, ``stride`` apart, from an array of sentences."""
    return F.transform(_starts(F.size(sents), stride, window), lambda s: F.array_join(F.slice(sents, s + 1, F.lit(window)), " "))


def fixed_texts(body: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Raw character windows, stripped, without empty ones."""
    step = size - overlap
    if step <= 0:
        raise ValueError(f"chunking overlap ({overlap}) must be smaller than size ({size}), or the window never advances")
    cut = F.transform(_starts(F.length(body), step, size), lambda s: strip(F.substring(body, s + 1, F.lit(size))))
    return F.filter(cut, lambda t: t != "")


def chunk_documents(corpus: DataFrame, cfg: dict) -> DataFrame:
    """``chunk_id, doc_id, doc_title, text, doc_ord, n`` by the strategy in ``cfg``."""
    strategy = cfg["strategy"]
    # an explode of one element keeps a column from being computed anew for every window over it
    if strategy == "paragraph":
        rows = corpus.withColumn("_texts", paragraph_texts(F.col("body")))
    elif strategy == "sentence_window":
        rows = corpus.select("*", F.explode(F.array(sentences(F.col("body")))).alias("_s")).withColumn(
            "_texts", sentence_window_texts(F.col("_s"), cfg.get("window", WINDOW), cfg.get("stride", STRIDE))
        )
    elif strategy == "fixed":
        rows = corpus.select("*", F.explode(F.array("body")).alias("_b")).withColumn(
            "_texts", fixed_texts(F.col("_b"), cfg.get("size", SIZE), cfg.get("overlap", OVERLAP))
        )
    else:
        raise ValueError(f"unknown chunking strategy {strategy!r}")
    rows = rows.select("doc_id", F.col("title").alias("doc_title"), "doc_ord", F.posexplode("_texts").alias("n", "text"))
    return rows.select(F.concat("doc_id", F.lit("#"), F.col("n").cast("string")).alias("chunk_id"), "doc_id", "doc_title", "text", "doc_ord", "n")
