"""Corpora: folders of text files, and plain tables in the same shape.

A corpus frame has ``doc_id, title, doc_type, date, body, path, doc_ord``; ``doc_ord`` is the
corpus order, which ranks and ties follow everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import strip
from sparkloom.operators.ordinals import dense_order

# Kind of a document by the part of its name before the first hyphen.
DOC_TYPES = {
    "svc": "service",
    "inc": "incident",
    "bug": "bug",
    "pol": "policy",
    "run": "runbook",
    "team": "team",
    "person": "person",
    "vendor": "vendor",
    "arch": "reference",
    "ref": "reference",
}
DATE_MARK = "Last updated:"


def doc_type(doc_id: Column) -> Column:
    """Kind of a document; an unknown prefix is an error that names it."""
    known = F.create_map(*(F.lit(x) for kv in DOC_TYPES.items() for x in kv))
    prefix = F.split(doc_id, "-", 2)[0]
    problem = F.concat(doc_id, F.lit(": unknown prefix '"), prefix, F.lit(f"'. Known: {', '.join(sorted(DOC_TYPES))}"))
    return F.coalesce(F.try_element_at(known, prefix), F.raise_error(problem).cast("string"))


def parse_documents(files: DataFrame) -> DataFrame:
    """Corpus rows from ``path, value``: a header up to the first blank line, then the body.

    The title is the header's first line; the last ``Last updated:`` line gives the date.
    """
    text = F.regexp_replace("value", r"\r\n?", "\n")
    cut = F.locate("\n\n", text)
    header = F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text)
    body = F.when(cut > 0, F.substring(text, cut + 2, F.length(text))).otherwise(F.lit(""))
    lines = F.split(header, "\n")
    dates = F.filter(lines, lambda x: x.startswith(DATE_MARK))
    stamp = strip(F.substring(F.element_at(dates, -1), F.lit(len(DATE_MARK) + 1), F.lit(1 << 20)))
    doc_id = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    rows = files.select(
        doc_id.alias("doc_id"),
        strip(lines[0]).alias("title"),
        F.when(F.size(dates) > 0, F.to_date(stamp, "yyyy-MM-dd")).alias("date"),
        strip(body).alias("body"),
        "path",
    )
    rows = rows.withColumn("doc_type", doc_type(F.col("doc_id")))
    ordered = dense_order(rows, "doc_ord", "path")
    return ordered.select("doc_id", "title", "doc_type", "date", "body", "path", "doc_ord")


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.txt`` files of a folder, in path order."""
    files = spark.read.text(f"{folder.rstrip('/')}/*.txt", wholetext=True)
    return parse_documents(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def corpus_from_table(docs: DataFrame) -> DataFrame:
    """``documents(doc_id, text, lang, source, n_chars)`` as a corpus: the first line is the title."""
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        strip(F.get(F.split("text", "\n", 2), F.lit(0))).alias("title"),
        F.col("lang").alias("doc_type"),
        F.lit(None).cast("date").alias("date"),
        strip(F.coalesce("text", F.lit(""))).alias("body"),
        F.col("source").alias("path"),
        F.col("doc_id").cast("long").alias("doc_ord"),
    )
