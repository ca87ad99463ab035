"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. There is a table for each segment in which every distinct fingerprint
stands once, under its value of the segment; and every fingerprint probes the table with all values in
a small Hamming ball around its own. Of two fingerprints within ``distance``, at least one segment differs by no more than its
radius: with ``distance = a * segments + b`` the first ``b + 1`` segments have radius ``a`` and the others ``a - 1``
(none at all below zero). What a probe meets is verified by the complete distance.

Entries and probes of one table place are compared in one task, and places with more than ``PART`` entries
are dealt out as a grid of parts. Only links that join something not yet joined leave it, so a group of near
copies gives one link a fingerprint, not one a pair. Equal fingerprints collapse
before all this. Linked fingerprints become components (:mod:`sparkloom.operators.components`).

Defined results: a null or empty text has fingerprint zero and is linked like any other;
rows with one doc_id are fingerprinted each on their own; a null doc_id is
never the component's id unless all its doc_ids are null; an empty table gives an empty
result; other columns are ignored by ``simhash_dedup`` and passed through by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow, map_arrow, whole_groups
from sparkloom.operators.components import connected_components
from sparkloom.storage import table

SEED = 42
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_BLOCK = 1 << 16
#: Entries of one table place that are compared in one task.
PART = 4096


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of ``hashes`` (uint64)."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a whole text: lower-case A-Z, word shingles, XXH64 with seed 42."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < shingle:
        return majority(np.array([_hash(b" ".join(w))], np.uint64))
    rows = zip(*(w[k:] for k in range(shingle)))
    return majority(np.fromiter(map(_hash, map(b" ".join, rows)), np.uint64, len(w) - shingle + 1))


def fingerprints(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """``keep`` columns and ``fp``: the fingerprint as a signed 64-bit number."""
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)], np.uint64)
        arrays = [*batch.columns[:-1], pa.array(fps.view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=[*keep, "fp"])

    return map_arrow(source, run, f"{fields}, fp long")


def layout(segments: int, distance: int) -> list[tuple[int, int, int]]:
    """``first bit, width, radius`` of each segment that is probed."""
    near, more = divmod(distance, segments)
    edges = [64 * k // segments for k in range(segments + 1)]
    radii = [near if k <= more else near - 1 for k in range(segments)]
    return [(edges[k], edges[k + 1] - edges[k], radii[k]) for k in range(segments) if radii[k] >= 0]


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` bits among ``width``."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def _value(fp: Column, first: int, width: int) -> Column:
    value = F.shiftrightunsigned(fp, first)
    return value if width == 64 else value.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def entries(fps: DataFrame, places: list[tuple[int, int, int]]) -> DataFrame:
    """``segment, value, fp``: each fingerprint once in the table of each segment."""
    rows = [F.struct(F.lit(k).alias("segment"), _value(F.col("fp"), first, width).alias("value")) for k, (first, width, _) in enumerate(places)]
    return fps.select("fp", F.explode(F.array(*rows)).alias("_at")).select("_at.segment", "_at.value", "fp")


def probes(fps: DataFrame, places: list[tuple[int, int, int]]) -> DataFrame:
    """``segment, value, fp, own``: where each fingerprint looks; ``own`` marks its entry, the centre of the ball."""

    def around(k: int, first: int, width: int, radius: int) -> Column:
        value = _value(F.col("fp"), first, width)
        masks = F.array(*(F.lit(_signed(m)).cast("long") for m in ball(width, radius)))
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("segment"), value.bitwiseXOR(m).alias("value"), (m == 0).alias("own")))

    balls = [around(k, *place) for k, place in enumerate(places)]
    return fps.select("fp", F.explode(F.concat(*balls)).alias("_at")).select("_at.segment", "_at.value", "fp", "_at.own")


def dealt(fps: DataFrame, places: list[tuple[int, int, int]], part: int) -> DataFrame:
    """The probes with the cell ``p, q`` that they go to, and whether they are an entry and a probe there."""
    counts = entries(fps, places).groupBy("segment", "value").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    long_lists = table(counts.where("parts > 1"))
    rows = probes(fps, places).join(long_lists, ["segment", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda p, q, entry, probe: F.struct(p.alias("p"), q.alias("q"), entry.alias("entry"), probe.alias("probe"))
    as_probe = F.transform(every, lambda i: cell(i, own, F.col("own") & (i == own), F.lit(True)))
    as_entry = F.transform(F.filter(every, lambda i: F.col("own") & (i != own)), lambda i: cell(own, i, F.lit(True), F.lit(False)))
    return rows.withColumn("_cell", F.explode(F.concat(as_probe, as_entry))).select("segment", "value", "_cell.*", "fp")


def place_links(entry: np.ndarray, probe: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Verified links between entries and probes (uint64) that join something not yet joined."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for a in entry:
        near = probe[np.bitwise_count(probe ^ a) <= distance]
        for b in near.tolist():
            x, y = top(int(a)), top(b)
            if x != y:
                root[x] = y
                out.append((int(a), b))
    return out


def near_links(fps: DataFrame, distance: int = 2, segments: int = 2, part: int = PART) -> DataFrame:
    """Links ``(a, b)`` whose closure is that of all pairs at most ``distance`` apart.

    ``fps``: one row per distinct fingerprint, column ``fp``.
    """
    if not (0 <= distance < 64 and 1 <= segments <= 64):
        raise ValueError(f"distance {distance} of 64 bits in {segments} segments")
    rows = dealt(fps, layout(segments, distance), part)
    at = ["segment", "value", "p", "q"]
    rows = rows.repartition(*at).sortWithinPartitions(*at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, ends, (*_, entry, probe, fp) in whole_groups(batches, len(at)):
            entry, probe, fp, out = entry.astype(bool), probe.astype(bool), fp.view(np.uint64), []
            filled = np.add.reduceat(entry.astype(np.int64), starts)
            for i in np.flatnonzero((ends - starts > 1) & (filled > 0)):
                here = slice(starts[i], ends[i])
                out += place_links(fp[here][entry[here]], fp[here][probe[here]], distance)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return arrow(rows, run, "a long, b long").where("a != b").distinct()


def near_components(rows: DataFrame, id_col: str = "doc_id", distance: int = 2) -> DataFrame:
    """``fp, component_id`` for each distinct fingerprint of ``rows(id, fp)``."""
    firsts = table(rows.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    labels = connected_components(near_links(firsts.select("fp"), distance))
    joined = firsts.join(labels, firsts.fp == labels.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("label")
    )
    joined = table(joined)
    smallest = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return joined.join(smallest, "label").select("fp", "component_id")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``."""
    rows = table(fingerprints(df, text_col, (id_col,), shingle))
    return rows.join(near_components(rows, id_col, distance), "fp").select(id_col, "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """``df`` with one document of each group: the rows of its smallest doc_id.

    A group without any doc_id keeps all its rows. Repeats of the kept row are one
    document and stay together.
    """
    verdicts = simhash_dedup(df, id_col, text_col, shingle, distance)
    kept = verdicts.where(F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias("__kept_id")).distinct()
    return df.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col("__kept_id")), "left_semi")
