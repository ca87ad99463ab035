"""Answers from ranked passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ranking import ALPHA, BM25, THRESHOLD, TOP_K, confidence, cosine_topk, fuse
from sparkloom.plans.answers import envelope
from sparkloom.plans.generate import Extractive
from sparkloom.storage import table

MODES = ("semantic", "lexical", "hybrid")


def answer(
    questions: DataFrame, chunks: DataFrame, question_vectors: DataFrame, vectors: DataFrame, index: BM25 | None = None, llm=None,
    mode: str = "semantic", k: int = TOP_K, alpha: float = ALPHA, threshold: float = THRESHOLD, key: str = "q_id",
) -> DataFrame:
    """The envelope for each question of ``questions(q_id, question)``.

    ``chunks(chunk_id, doc_id, text, doc_ord)``; vectors are ``(q_id, embedding)`` and ``(chunk_id, embedding)``, and with
    ``doc_ord`` they are ranked as they are. Both retrievers run; confidence is always read from the best cosine.
    """
    if mode not in MODES:
        raise ValueError(f"unknown rag mode {mode!r}")
    placed = vectors if "doc_ord" in vectors.columns else vectors.join(chunks.select("chunk_id", "doc_ord"), "chunk_id")
    ordered = placed.select("chunk_id", F.struct("doc_ord", "chunk_id").alias("_ord"), "embedding")
    semantic = table(cosine_topk(question_vectors, ordered, key, "chunk_id", k, order="_ord"))
    lexical = table((index or BM25(chunks)).search(questions, key, "question", k))
    chosen = {"semantic": semantic, "lexical": lexical}.get(mode)
    if chosen is None:
        chosen = fuse(semantic, lexical, key, "chunk_id", alpha)
    hits = chosen.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
    packed = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("h"))
    rows = questions.join(packed, key, "left").join(confidence(questions, semantic, key, threshold), key)
    rows = rows.withColumn("h", F.coalesce("h", F.array().cast(packed.schema["h"].dataType)))
    rows = rows.withColumn("evidence", F.transform("h", lambda x: F.struct(x["doc_id"].alias("citation"), x["text"].alias("text"))))
    rows = (llm or Extractive()).generate(rows)
    shown = F.format_string("%.2f", F.col("top_score"))
    doubt = F.concat(
        F.lit("The best chunk scored "), shown,
        F.lit(f", below the {threshold} threshold. Vector search always returns something, so these chunks may have nothing to do with the question."),
    )
    note = F.concat_ws(" ", F.when(~F.col("confident"), doubt), F.col("generation_note"))
    citations = F.array_distinct(F.transform("h", lambda x: x["doc_id"]))
    trace = F.array(
        F.lit("Embedded the question into the same vector space as the chunks."),
        F.lit(f"Scored every chunk by cosine similarity and kept the top {k}."),
        F.lit("Ran BM25 over the same query so the two rankings can be compared."),
        F.concat(F.lit(f"Answered from the {mode} ranking: "), F.size("h").cast("string"), F.lit(" chunk(s) from "), F.size(citations).cast("string"), F.lit(" document(s).")),
    )
    size = F.aggregate(F.col("h"), F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"]))
    detail = F.to_json(F.struct(F.lit(mode).alias("mode"), F.lit(k).alias("top_k"), F.round("top_score", 4).alias("top_score"), F.lit(threshold).alias("threshold")))
    rows = rows.withColumns(
        {"citations": citations, "trace": trace, "detail": detail, "tokens_est": F.floor(size / 4).cast("long"), "note": F.when(note != "", note)}
    )
    return envelope(rows, "rag", key)
