"""Shared pieces of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import table

#: White space of all text contracts here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; null has none. Built-ins only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of an Arrow batch, unless the session asks for another number: texts may be long.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def trim() -> None:
    """Give memory that a task no longer needs back to the system; the worker process lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded size, whose memory is returned after each task."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, "10000") == "10000":
        conf.set(_BATCH_CONF, str(BATCH_ROWS))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(trimmed, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` for each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return arrow(df, run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """``starts, ends, columns``: sorted batches cut so that rows alike in the first ``keys`` columns come together.

    A group may run on over batches; what is held is one batch and one group.
    """
    held: list[np.ndarray] | None = None

    def groups(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        n = len(columns[0])
        new = np.zeros(n, bool)
        new[:1] = True
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        return starts, np.append(starts[1:], n), columns

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        last = int(groups(held)[0][-1])
        if last:
            yield groups([c[:last] for c in held])
            held = [c[last:] for c in held]
    if held is not None:
        yield groups(held)


class Members:
    """A set of 64-bit keys as a bitmap of fixed size, to thin a scan before a join.

    The bitmap has ``2 ** bits`` places whatever the number of keys, so sending
    it to every executor has a proven bound (8 MB for 26 bits). Where it fills up
    it lets more rows through; the exact join behind it decides, so no row is lost
    or gained. Built-ins only.
    """

    def __init__(self, keys: DataFrame, key: str, bits: int = 26) -> None:
        self.places = 1 << bits
        place = F.pmod(F.col(key), F.lit(self.places))
        self.bitmap = table(
            keys.select(place.alias("_place"))
            .groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
        )

    def mark(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with a boolean column: false only where ``key`` is surely no member."""
        place = F.pmod(key, F.lit(self.places))
        marked = df.withColumn("_place", place).withColumn("_bucket", F.bitmap_bucket_number("_place"))
        marked = marked.join(F.broadcast(self.bitmap), "_bucket", "left")
        position = F.bitmap_bit_position("_place")
        byte = F.conv(F.hex(F.substring("_bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10)
        bit = F.getbit(F.coalesce(byte.cast("long"), F.lit(0)), (position % 8).cast("int"))
        return marked.withColumn(name, bit == 1).drop("_place", "_bucket", "_bits")
