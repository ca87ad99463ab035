"""Substring deduplication by hashing lines, their clauses, or paragraphs.

With ``unit="passage"``, as the query runs, a line is cut after ``. ! ? , ; :`` into clauses, of which those
of fewer than ``MIN_CLAUSE`` words join what follows on the line. Clauses are normalised (lower case, no punctuation at the ends
of words, single spaces) and their digests grouped over all documents; the occurrence first in order of doc_id and
offset stays, the others are repeats. Repeats that follow each other on ``MIN_WORDS`` words or
more are a passage and are removed, so a passage is found wherever in a line it begins and ends; single repeated phrases stay. A whole line of
so many words is a unit as well: it is found even if its clauses are too short to tell anything.
With ``unit="line"`` or ``"paragraph"`` each repeated unit of ``min_words`` words goes.

Only digests, ids and offsets are shuffled until the last join, which fetches the documents with
passages; a digest's first occurrence is a minimum combined map-side, so a passage shared by a third of
all documents is no hot group, and the join with it is one that the adaptive planner can split.

Defined results: a null text stays null and has no units; an empty one stays empty; of equal units in one document
the first stays; rows equal in doc_id and text are one document, so repeats of a row do not remove each other's
text; a null doc_id ranks last; an empty table gives an empty result; ``removed`` holds the original code point
offsets (null where nothing goes) and replaces a column of that name; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow
from sparkloom.llm.text_units import Spans, cut, in_order, keyed_texts
from sparkloom.storage import table

#: Words that a removed passage has at least, and that a clause has unless its line ends.
MIN_WORDS, MIN_CLAUSE = 40, 3
_BREAK = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}
_CLAUSE_END = re.compile(r"(?<=[.!?,;:])[^\S\n]+")
_MARKS = ".,;:!?\"'()[]{}<>«»“”„‘’…-–—"

Unit = tuple[int, int, int, bytes]


def spans_of(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """Offsets of the lines or paragraphs of a text."""
    start = 0
    for gap in _BREAK[unit].finditer(text):
        yield start, gap.start()
        start = gap.end()
    yield start, len(text)


def _normal(piece: str) -> list[str]:
    return [w for w in (x.strip(_MARKS) for x in piece.lower().split()) if w]


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


def whole_units(text: str | None, unit: str) -> Iterator[Unit]:
    """``start, end, words, digest`` of each line or paragraph with words."""
    if text is None:
        return
    for start, end in spans_of(text, unit):
        if words := _normal(text[start:end]):
            yield start, end, len(words), _digest(words)


def clauses(text: str | None) -> Iterator[Unit]:
    """``start, end, words, digest`` of the clauses of each line, in order."""
    if text is None:
        return
    for first, last in spans_of(text, "line"):
        start, at, words = first, first, []
        for gap in [*(m.span() for m in _CLAUSE_END.finditer(text, first, last)), (last, last)]:
            words += _normal(text[at : gap[0]])
            at = gap[1]
            if len(words) >= MIN_CLAUSE or words and at == last:
                yield start, gap[0], len(words), _digest(words)
                words = []
            if not words:
                start = at


def units_of(text: str | None, unit: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """``mark, words, digest`` of each unit; a mark is twice the offset, plus one for a whole line or paragraph."""
    if unit == "passage":
        alone = set()
        for start, end, n, digest in clauses(text):
            alone.add((start, end))
            yield 2 * start, n, digest
        for start, end, n, digest in whole_units(text, "line"):
            if n >= min_words and (start, end) not in alone:  # a line of one clause is there already
                yield 2 * start + 1, n, digest
    else:
        for start, _, n, digest in whole_units(text, unit):
            if n >= min_words:
                yield 2 * start + 1, n, digest


def _joined(spans: Spans) -> Spans:
    """Ascending spans; those that overlap become one."""
    out: Spans = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeats_in(text: str, marks: list[int], unit: str = "passage", min_words: int = MIN_WORDS) -> Spans:
    """The spans to remove from a text whose repeated units are ``marks``."""
    told = set(marks)
    if unit != "passage":
        return [(s, e) for s, e in spans_of(text, unit) if 2 * s + 1 in told]
    spans = [(s, e) for s, e in spans_of(text, "line") if 2 * s + 1 in told]
    first, last, n = 0, 0, 0
    for start, end, size, _ in [*clauses(text), (len(text) + 1, 0, 0, b"")]:
        if 2 * start in told:
            first, last = first if n else start, end
            n += size
        else:
            if n >= min_words:
                spans.append((first, last))
            n = 0
    return _joined(spans)


def repeated_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 1) -> DataFrame:
    """Documents with units that repeat an earlier one: ``doc, text_key, marks``, and ``words`` in all of these."""
    if unit not in (*_BREAK, "passage"):
        raise ValueError(f"unknown unit {unit!r}; known: {', '.join(_BREAK)}, passage")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            rows = [
                (doc, key, *found)
                for doc, key, text in zip(*(c.to_pylist() for c in batch.columns))
                for found in units_of(text, unit, min_words)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc", "text_key", "mark", "words", "digest"]
                )

    found = table(arrow(keyed_texts(df, id_col, text_col), run, "doc long, text_key long, mark long, words int, digest binary"))
    firsts = found.groupBy("digest").agg(F.min(in_order("mark", "text_key")).alias("first"), F.count("*").alias("n"))
    firsts = table(firsts.where("n > 1").select("digest", "first"))
    same = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("mark") == F.col("first.mark")) & (F.col("text_key") == F.col("first.text_key"))
    later = found.join(firsts, "digest").where(~same)
    return later.groupBy("doc", "text_key").agg(F.collect_set("mark").alias("marks"), F.sum("words").alias("words"))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int | None = None) -> DataFrame:
    """``df`` with repeated units or passages cut from the text, and ``removed``: their spans in the original."""
    least = min_words if min_words is not None else MIN_WORDS if unit == "passage" else 1
    marks = repeated_units(df, id_col, text_col, unit, least).where(F.col("words") >= least)
    return cut(df, marks, id_col, text_col, partial(repeats_in, unit=unit, min_words=least))
