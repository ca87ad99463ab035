"""Parts of texts as units: what line and substring deduplication share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Members, arrow
from sparkloom.storage import table

Spans = list[tuple[int, int]]
REMOVED = "array<struct<start:int,end:int>>"


def document_keys(id_col: str, text_col: str) -> list[Column]:
    """What identifies a row: its doc_id and a hash of its text.

    Rows alike in both are one document; a repeated doc_id with another text is another one.
    """
    return [
        F.col(f"`{id_col}`").cast("long").alias("doc"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("text_key"),
    ]


def keyed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, text_key, _text`` of each row."""
    return df.select(*document_keys(id_col, text_col), F.col(f"`{text_col}`").cast("string").alias("_text"))


def in_order(*columns: str) -> Column:
    """Rank of an occurrence: doc_id with null last, then ``columns``."""
    return F.struct(F.col("doc").isNull().alias("unknown"), F.col("doc").alias("doc"), *(F.col(c).alias(c) for c in columns))


def cut(df: DataFrame, marks: DataFrame, id_col: str, text_col: str, spans_of: Callable[[str, list], Spans], out: str = "removed") -> DataFrame:
    """``df`` without the spans that ``spans_of(text, marks)`` finds in the documents of ``marks(doc, text_key, marks)``.

    ``out`` gets the removed spans, ascending, as code point offsets into the original text, or null where there
    are none. A column of that name in ``df`` is replaced; all others pass through, whatever their names.
    Only rows that may have marks, told by a bitmap of fixed size, are shuffled to meet them.
    """
    columns = [c for c in df.columns if c.lower() != out.lower()]
    plain = df.select(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(columns)), *document_keys(id_col, text_col))
    at, kept = columns.index(text_col), [f"_{k}" for k in range(len(columns))]
    marks = table(marks.select("doc", "text_key", "marks"))
    place = F.xxhash64("doc", "text_key")
    told = Members(marks.select(place.alias("_key")), "_key").mark(plain, place, "_maybe")
    named = marks.select(F.col("doc").alias("_doc"), F.col("text_key").alias("_text_key"), "marks")
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text_key"))
    met = told.where("_maybe").join(named, same, "left").select(*kept, "marks")
    fields = [f for f in plain.schema.fields if f.name in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), [None] * batch.num_rows
            marked = batch.column(batch.num_columns - 1)
            for i in marked.is_valid().to_numpy(zero_copy_only=False).nonzero()[0]:
                if texts[i] is not None and (spans := spans_of(texts[i], marked[i].as_py())):
                    texts[i] = without(texts[i], spans)
                    found[i] = [{"start": s, "end": e} for s, e in spans]
            arrays = list(batch.columns)
            arrays[at], arrays[-1] = pa.array(texts, batch.schema.field(at).type), pa.array(found, kind)
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "_spans"])

    changed = arrow(met, run, f"{schema}, _spans {REMOVED}")
    rest = told.where("not _maybe").select(*kept, F.lit(None).cast(REMOVED).alias("_spans"))
    whole = rest.unionByName(changed)
    return whole.select(*(F.col(k).alias(c) for k, c in zip(kept, columns)), F.col("_spans").alias(out))


def without(text: str, spans: Spans) -> str:
    """``text`` without ascending ``spans``, and without one break or space after each where the cut would leave two."""
    kept, last = [], 0
    for start, end in spans:
        kept.append(text[last:start])
        before = text[start - 1] if start else "\n"
        after = text[end] if end < len(text) else ""
        last = end + (after.isspace() and (before == "\n" or before.isspace() and after != "\n"))
    kept.append(text[last:])
    joined = "".join(kept)
    return joined[:-1] if spans[-1][1] == len(text) and joined.endswith("\n") else joined
