"""The envelope every approach answers in, and what compares approaches."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of an answer, in order.
ENVELOPE = ("approach", "label", "answer", "evidence", "citations", "trace", "detail", "ms", "tokens_est", "confident", "note")
LABELS = {"rag": "RAG", "kg": "Knowledge graph", "wiki": "LLM wiki"}


def envelope(rows: DataFrame, approach: str, *keep: str, ms: dict[str, float] | None = None) -> DataFrame:
    """``keep`` and the eleven fields; an answer that is not confident must say why.

    ``rows`` has answer, evidence, citations, trace, detail, tokens_est, confident, note.
    """
    times = F.create_map(*(F.lit(x) for kv in (ms or {"total": 0.0}).items() for x in kv))
    problem = F.raise_error(F.lit(f"{approach}: confident=false requires a note explaining why")).cast("string")
    note = F.when(~F.col("confident") & F.col("note").isNull(), problem).otherwise(F.col("note"))
    made = rows.withColumns({"approach": F.lit(approach), "label": F.lit(LABELS[approach]), "ms": times, "note": note})
    return made.select(*keep, *ENVELOPE)


def scoreboard(answers: DataFrame, *keep: str) -> DataFrame:
    """One comparison row for each answer."""
    return answers.select(
        *keep,
        "approach",
        "label",
        F.coalesce(F.try_element_at("ms", F.lit("total")), F.lit(0.0)).alias("latency_ms"),
        F.col("tokens_est").alias("evidence_tokens"),
        F.size(F.array_distinct("citations")).alias("documents_touched"),
        F.coalesce(F.length(F.get_json_object("detail", "$.path.render")) > 0, F.lit(False)).alias("derivation_shown"),
        (~F.col("confident")).alias("admitted_ignorance"),
    )


def failed(questions: DataFrame, approach: str, problem: str, *keep: str) -> DataFrame:
    """The envelope of an approach that broke, so that the others still stand."""
    text = f"This approach failed: {problem}"
    rows = questions.select(
        *keep,
        F.lit(text).alias("answer"),
        F.array().cast("array<struct<citation:string,text:string>>").alias("evidence"),
        F.array().cast("array<string>").alias("citations"),
        F.array(F.lit(text)).alias("trace"),
        F.lit("{}").alias("detail"),
        F.lit(0).cast("long").alias("tokens_est"),
        F.lit(False).alias("confident"),
        F.lit(text).alias("note"),
    )
    return envelope(rows, approach, *keep)


class PhaseTimer:
    """Wall-clock milliseconds by phase, and in total since it was made."""

    def __init__(self) -> None:
        self._began = time.perf_counter()
        self._phases: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self._phases[name] = self._phases.get(name, 0.0) + 1000 * (time.perf_counter() - began)

    def ms(self) -> dict[str, float]:
        rounded = {k: round(v, 1) for k, v in self._phases.items()}
        return rounded | {"total": round(1000 * (time.perf_counter() - self._began), 1)}


def ordered_distinct(arrays: Column) -> Column:
    """An array of arrays as one, first occurrences in order."""
    return F.array_distinct(F.flatten(arrays))
