"""Fuzzy line deduplication.

Lines are normalised (lower case, digits as 0, no ASCII punctuation, single spaces) and equal ones
collapse by digest. Each distinct line of ``MIN_WORDS`` words or more gets a SimHash over its words, weighed by their lengths, and a few keys. Lines
that share a key and whose fingerprints differ in at most ``WIDE`` bits are verified by the edit similarity of
the normalised lines, at least ``SIMILARITY``. Of each connected group of lines the occurrence first in
order of doc_id and offset stays.

A pigeonhole over blocks of the fingerprint itself cannot give right results: lines of edit similarity 0.8
lie up to 16 of 64 bits apart, which leaves blocks of three bits. The keys are therefore pigeonholes over the words: the
least of ``ROUNDS`` hashes of three-word shingles, one of which survives the edits; and for lines of up to ``SHORT`` words
the bag of words, whole and without each one of them, where any fingerprint is a partner. Lines edited in
most of their words can still miss each other.

Lines under one key are compared in one task (large keys in several), never again where they are connected
already, and a pair with several keys in common only under the first of these that compares it: no link that would connect more is lost,
and a group of near copies yields one link a line. Only digests, fingerprints, keys and offsets are shuffled before the
verification, packed into one block for each place that a task deals to; lines and keys too frequent for one task go on as plain rows.
The verification fetches the text of candidate lines alone, picked in the scan by a bitmap of fixed size.

Defined results: a null text stays null and has no lines; blank lines stay, and shorter lines go only as exact
repeats; rows equal in doc_id and text are one document, so repeats of a row do not remove each other's
lines; a null doc_id ranks last; an empty table gives an empty result; ``removed`` holds the original code point offsets
(null where nothing goes) and replaces a column of that name; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Members, arrow, whole_groups
from sparkloom.llm.text_units import REMOVED, cut, in_order, keyed_texts
from sparkloom.operators.components import connected_components
from sparkloom.storage import table

SIMILARITY = 0.8
#: Words of a line that is compared by similarity, words up to which its bag counts, minhashes, and bits of difference.
MIN_WORDS, SHORT, ROUNDS, WIDE = 3, 9, 5, 16
#: Weight of a word is its length in bytes, up to this.
HEAVIEST = 40
#: For each byte, its lower and its upper four bits as four counters of sixteen bits, which hold ``_PIECE`` words.
_SPREAD = [np.array([sum((x >> shift + k & 1) << 16 * k for k in range(4)) for x in range(256)], np.uint64) for shift in (0, 4)]
_PIECE = 65535 // HEAVIEST
#: Word hashes, or lines, held at once by a task.
_HELD = 100_000
#: Runs of keys that a task gathers before it sends them on, and records it holds of one place before it looks for frequent ones.
_FLUSH, _ROOM = 20, 1_000_000
#: Pairs of lines verified together.
_TOGETHER = 10_000
#: Lines under one key that a task compares; larger keys are dealt out as pairs of parts.
_PART = 8192
#: Words looked ahead for the end of a gap between two lines.
_AHEAD = 8
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_ODD = np.random.default_rng(7).integers(1 << 62, size=ROUNDS + 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def flatten(text: str) -> bytes:
    """Lower case, digits as 0, without ASCII punctuation, in UTF-8; line breaks stay where they are in number."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_DIGITS, _MARKS)


def normalise(line: str) -> list[bytes]:
    """Words of the normalised line, in UTF-8."""
    return flatten(line).split()


def fingerprints(hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of consecutive runs of ``hashes`` (uint64): bits set in over half of a run's weight."""
    first = np.cumsum(sizes) - sizes
    starts = np.unique(np.concatenate([first, *(np.arange(a, a + n, _PIECE) for a, n in zip(first, sizes) if n > _PIECE)]))
    octets, heavy = hashes.view(np.uint8).reshape(-1, 8), weights.astype(np.uint64)
    sums = [np.add.reduceat(half[octets[:, k]] * heavy, starts).view(np.uint16).reshape(-1, 4) for k in range(8) for half in _SPREAD]
    ones = np.concatenate(sums, axis=1).astype(np.int32)
    if len(starts) > len(first):
        ones = np.add.reduceat(ones, np.searchsorted(starts, first), axis=0)
    whole = np.add.reduceat(weights, first)
    return np.packbits(2 * ones > whole[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def line_keys(hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of consecutive runs of word hashes, of three or more each, and the run of each key; odd ones are those of bags.

    The least of a shingle's hashes is taken over its weight, so that shingles of long words, which
    are rare and make most of the line, count for more than those of short ones, which any line may have.
    """
    ends = np.cumsum(sizes)
    h = hashes * _ODD[0]
    h ^= h >> np.uint64(29)
    shingles = h[:-2] * _ODD[0] + h[1:-1] * _ODD[1] + h[2:] * _ODD[2]
    shingles ^= shingles >> np.uint64(31)
    heavy = 1.0 / (weights[:-2] + weights[1:-1] + weights[2:])
    edges = np.stack([ends - sizes, ends - 2], axis=1).ravel()[:-1]  # shingles across two lines fall between
    out, mixed = [], np.empty_like(shingles)
    for k in range(ROUNDS):
        np.multiply(shingles, _ODD[3 + k], out=mixed)
        mixed ^= mixed >> np.uint64(32)
        mixed >>= np.uint64(12)
        mixed |= np.uint64(0x3FF0000000000000)  # a number from 1 to 2
        late = mixed.view(np.float64) - 1.0
        late *= heavy
        out.append(np.minimum.reduceat(late, edges)[::2].view(np.uint64) * _ODD[k] & ~np.uint64(1))
    owners = [np.arange(len(sizes))] * ROUNDS
    for i in np.flatnonzero(sizes <= SHORT).tolist():
        bag = hashes[ends[i] - sizes[i] : ends[i]]
        total = bag.sum(dtype=np.uint64)
        left = np.append(total - bag, total) * np.uint64(0x9E3779B97F4A7C15)
        left ^= left >> np.uint64(32)
        out.append(left | np.uint64(1))
        owners.append(np.full(len(left), i))
    return np.concatenate(out).view(np.int64), np.concatenate(owners)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most + 1`` if it is larger (Myers' bit-parallel rows)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b, n = a[i:], b[i:], n - i
    j = 0
    while j < n and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return min(len(b), most + 1)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << k)
    full, top, up, down, found = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        eq = places.get(c, 0)
        cross = eq | down
        level = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(level | up)), up & level
        found += bool(rise & top) - bool(fall & top)
        if found - left > most:
            return most + 1
        rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(cross | rise)), rise & cross
    return min(found, most + 1)


def edits_allowed(a: str, b: str, similarity: float) -> int:
    """The largest distance at which 1 - distance / longer length reaches ``similarity``."""
    return int((1 - similarity) * max(len(a), len(b)) + 1e-9)


def aligned(a: str, b: str, most: int) -> bool:
    """Whether a plain alignment of words shows a distance of ``most`` or less; if not, the distance may still be.

    Equal words stand against each other; where they part, the next pair of two equal words in a row ends the
    gap. Edits inside the gaps, each by itself, are enough to make one text of the other.
    """
    x, y = a.split(" "), b.split(" ")
    i, j, n, m, total, gaps = 0, 0, len(x), len(y), 0, []
    x += [None, None]
    y += [None, None]
    while i < n or j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p, q = next(
            ((i + k, j + t - k) for t in range(1, 2 * _AHEAD) for k in range(max(0, t - _AHEAD), min(t, _AHEAD) + 1)
             if i + k <= n and j + t - k <= m and x[i + k] == y[j + t - k] and x[i + k + 1] == y[j + t - k + 1]),
            (n, m),
        )
        one, other = " ".join(x[i:p]), " ".join(y[j:q])
        gaps.append((one, other))
        total += max(len(one), len(other)) + (p == i or q == j)
        if total > 2 * most + 16:
            return False
        i, j = p, q
    for one, other in gaps:
        if total <= most:
            break
        if one and other:
            longer = max(len(one), len(other))
            total += edit_distance(one, other, longer) - longer
    return total <= most


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length reaches ``similarity``."""
    most = edits_allowed(a, b, similarity)
    return abs(len(a) - len(b)) <= most and (aligned(a, b, most) or edit_distance(a, b, most) <= most)


#: What the blocks hold: an occurrence of a line, a key of a line, and the id of a line that may have a link.
_AT = np.dtype([("hi", "<u8"), ("lo", "<i8"), ("doc", "<i8"), ("text_key", "<i8"), ("start", "<i4"), ("end", "<i4"), ("unknown", "<i4")])
_KEY = np.dtype([("key", "<i8"), ("id", "<i8"), ("fp", "<i8")])
_MET = np.dtype([("lo", "<i8")])
_KINDS = {0: _MET, 1: _AT, 2: _KEY}
_BLOCKS = "kind int, place int, block binary"


def _places(df: DataFrame) -> int:
    """Into how many places the blocks are dealt: one for four MB of input, as far as its size is known."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size >> 22, 1 << 16) if size < 1 << 60 else 0)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])


def _blocks(kind: int, records: np.ndarray, places: int) -> pa.RecordBatch:
    """``records`` sorted into places by their first code, each place's as one row."""
    code = records["key" if kind == 2 else "lo"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    place = ((code >> np.uint64(32)) % np.uint64(places)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    named, first = np.unique(place[order], return_index=True)
    block = _strings(records[order], np.append(first, len(order)) * records.itemsize)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(named), kind, np.int32)), pa.array(named), block], names=["kind", "place", "block"])


def _lines(source: DataFrame, places: int) -> DataFrame:
    """Blocks of the occurrences of all lines with words, and of the keys of each line, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, digests, seen, hashes, weights, sizes, owners, posted = [], [], set(), [], [], [], [], []

        def keyed() -> None:
            if sizes:
                h = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64)
                w, n = np.minimum(np.array(weights, np.int32), HEAVIEST), np.array(sizes)
                keys, at = line_keys(h, w, n)
                records = np.empty(len(keys), _KEY)
                records["key"] = keys
                records["id"] = np.frombuffer(b"".join(owners), "<i8")[1::2][at]
                records["fp"] = fingerprints(h, w, n).view(np.int64)[at]
                posted.append(records)
            for held in (seen, hashes, weights, sizes, owners):
                held.clear()

        def found() -> Iterator[pa.RecordBatch]:
            keyed()
            records = np.empty(len(rows), _AT)
            records[["hi", "lo"]] = np.frombuffer(b"".join(digests), np.dtype([("hi", "<u8"), ("lo", "<i8")]))
            for name, column in zip(("unknown", "doc", "text_key", "start", "end"), zip(*rows)):
                records[name] = column
            yield _blocks(1, records, places)
            if posted:
                yield _blocks(2, np.concatenate(posted), places)
            for held in (rows, digests, posted):
                held.clear()

        for batch in batches:
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                start, text, unknown, doc = 0, text or "", doc is None, doc or 0
                for line, flat in zip(text.split("\n"), flatten(text).split(b"\n")):
                    end = start + len(line)
                    if words := flat.split():
                        digest = xxhash.xxh3_128_digest(b" ".join(words))
                        if digest not in seen:
                            seen.add(digest)
                            if len(words) >= MIN_WORDS:
                                owners.append(digest)
                                sizes.append(len(words))
                                hashes += map(xxhash.xxh64_digest, words)
                                weights += map(len, words)
                        rows.append((unknown, doc, key, start, end))
                        digests.append(digest)
                    start = end + 1
                    if len(hashes) > _HELD:
                        keyed()
                    if len(rows) > _HELD or len(posted) > _FLUSH:
                        yield from found()
        if rows:
            yield from found()

    return arrow(source, run, _BLOCKS)


def _by_place(blocks: DataFrame, code: str, run: Callable[[bool, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``run(often, records, met)`` on the records of each place, which all hold in one task.

    Records whose ``code`` stands too often for that go out with ``often`` set as soon as the task holds
    too many, and are not held; what is done with them is up to plain rows.
    """
    part = _PART

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, met, size, room, often = None, [], [], 0, _ROOM, np.empty(0, np.int64)

        def split(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, room, often
            records = np.concatenate(held) if held else np.empty(0, _AT)
            codes, counts = np.unique(records[code], return_counts=True) if held else (often, often)
            often = np.union1d(often, codes[counts > part])
            marks, out = np.unique(np.concatenate(met)["lo"]) if met else np.empty(0, np.int64), None
            if len(often) and len(records):
                out = np.isin(records[code], often)
                if out.any():
                    yield run(True, records[out], marks)
                records = records[~out]
            if last and len(records):
                yield run(False, records, marks)
            held, size, room = [records], len(records), max(_ROOM, 2 * len(records))

        for batch in batches:
            for kind, place, block in zip(*(c.to_pylist() for c in batch.columns)):
                if place != now:
                    yield from split(True)
                    now, held, met, size, room, often = place, [], [], 0, _ROOM, often[:0]
                records = np.frombuffer(block, _KINDS[kind])
                if kind:
                    held.append(records)
                    size += len(records)
                    if size > room:
                        yield from split(False)
                else:
                    met.append(records)
        yield from split(True)

    rows = blocks.select("kind", "place", "block").repartition("place").sortWithinPartitions("place", "kind")
    return arrow(rows, grouped, schema)


def _dealt(rows: DataFrame, by: Column, *columns: str) -> DataFrame:
    """``rows(key, parts, ...)`` sorted by ``key, p, q``: a key of several parts goes out as all pairs of its parts."""
    own = F.pmod(F.xxhash64(by), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, own).alias("p"), F.greatest(p, own).alias("q")))
    dealt = rows.withColumn("_cell", F.explode(cells)).select("key", "_cell.p", "_cell.q", *columns)
    return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def with_partner(fps: np.ndarray, most: int) -> np.ndarray:
    """Which of ``fps`` have another one within ``most`` bits."""
    out, left = np.zeros(len(fps), bool), np.arange(len(fps))
    while len(left):
        i, left = left[0], left[1:]
        near = np.bitwise_count(fps ^ fps[i]) <= most
        near[i] = False
        if near.any():
            near[i] = True
            out |= near  # partners of this one have a partner
            left = left[~out[left]]
    return out


def _near(blocks: DataFrame) -> DataFrame:
    """``key, parts, id, fp``: lines that share a key with another line near enough, from blocks of their keys."""

    def met(often: bool, records: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
        records = records[np.lexsort((records["id"], records["key"]))]
        key, ids = records["key"], records["id"]
        new = np.append(True, key[1:] != key[:-1])
        once = new | np.append(True, ids[1:] != ids[:-1])
        records, new = records[once], new[once]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(records))
        picked = np.full(len(records), often)
        if not often:
            bits, odd, n = records["fp"].view(np.uint64), records["key"][starts] & 1 == 1, ends - starts
            two = starts[n == 2]
            picked[two] = picked[two + 1] = odd[n == 2] | (np.bitwise_count(bits[two] ^ bits[two + 1]) <= WIDE)
            for s, e, whole in zip(starts[n > 2].tolist(), ends[n > 2].tolist(), odd[n > 2].tolist()):
                picked[s:e] = True if whole else with_partner(bits[s:e], WIDE)
        columns = [pa.array(np.ascontiguousarray(records[c][picked])) for c in ("key", "id", "fp")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), often))], names=["key", "id", "fp", "often"])

    found = table(_by_place(blocks, "key", met, "key long, id long, fp long, often boolean"))
    frequent = table(found.where("often").select("key", "id", "fp").distinct())
    parts = frequent.groupBy("key").agg(F.ceil(F.count("*") / _PART).cast("int").alias("parts"))
    rows = _dealt(frequent.join(parts, "key"), F.col("id"), "parts", "id", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, ends, (key, _, _, parts, ids, fps) in whole_groups(batches, 3):
            bits, picked = fps.view(np.uint64), np.zeros(len(ids), bool)
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s > 1:
                    picked[s:e] = True if key[s] & 1 else with_partner(bits[s:e], WIDE)
            yield pa.RecordBatch.from_arrays([pa.array(c[picked]) for c in (key, parts, ids, fps)], names=["key", "parts", "id", "fp"])

    plain = found.where("not often").select("key", F.lit(1).alias("parts"), "id", "fp")
    return plain.unionByName(arrow(rows, run, "key long, parts int, id long, fp long").distinct())


def suspects(distinct: DataFrame) -> DataFrame:
    """``key, parts, id, fp``: lines of ``distinct(id, fp, keys)`` that share a key with another line near enough."""
    places = _places(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2)
            each, flat = np.diff(keys.offsets.to_numpy()), keys.flatten().to_numpy()
            records = np.empty(len(flat), _KEY)
            records["key"] = flat
            for k, name in enumerate(("id", "fp")):
                records[name] = np.repeat(batch.column(k).to_numpy(), each)
            yield _blocks(2, records, places)

    return _near(arrow(distinct.select("id", "fp", "keys"), run, _BLOCKS))


def _occurrences(blocks: DataFrame, near: DataFrame, places: int) -> DataFrame:
    """``line, doc, text_key, start, end, met, best``: lines that occur again or are in ``near``; ``best`` is the line's first."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy() for b in batches]
        if held and len(ids := np.unique(np.concatenate(held))):
            yield _blocks(0, ids.view(_MET), places)

    def kept(often: bool, records: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        met = np.isin(records["lo"], ids)
        code, count = np.unique(records["lo"], return_counts=True)
        again = met | np.isin(records["lo"], code[count > 1]) | often
        records, met = records[again], met[again]
        order = np.lexsort([records[c] for c in ("end", "text_key", "start", "doc", "unknown", "lo", "hi")])
        records, met = records[order], met[order]
        new = np.append(True, (records["hi"][1:] != records["hi"][:-1]) | (records["lo"][1:] != records["lo"][:-1]))[: len(records)]
        best = records[np.flatnonzero(new)][np.cumsum(new) - 1]
        lines = np.ascontiguousarray(records[["hi", "lo"]]).astype(np.dtype([("hi", "<u8"), ("lo", "<i8")]))
        arrays = [_strings(lines, 16 * np.arange(len(records) + 1))]
        for x in (records, best):
            arrays += [pa.array(x["doc"], mask=x["unknown"] == 1), *(pa.array(np.ascontiguousarray(x[c])) for c in ("text_key", "start", "end"))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(met), pa.array(np.full(len(records), often))], names=names)

    kinds = {"doc": "long", "text_key": "long", "start": "int", "end": "int"}
    schema = {"line": "binary", **kinds, **{f"best_{c}": k for c, k in kinds.items()}, "met": "boolean", "often": "boolean"}
    names = list(schema)
    both = blocks.where("kind = 1").unionByName(arrow(near.select("id"), marks, _BLOCKS))
    found = table(_by_place(both, "lo", kept, ", ".join(f"{c} {k}" for c, k in schema.items())))
    first = F.struct(F.col("best_doc").isNull().alias("unknown"), *(F.col(f"best_{c}").alias(c) for c in ("doc", "start", "text_key", "end"))).alias("best")
    own = ["line", "doc", "text_key", "start", "end", "met"]
    frequent = found.where("often").select(*own)
    bests = frequent.groupBy("line").agg(F.min(in_order("start", "text_key", "end")).alias("best"))
    return found.where("not often").select(*own, first).unionByName(frequent.join(bests, "line").select(*own, "best"))


def _texts(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``line, id, norm`` for the lines whose first occurrence is in ``wanted(line, doc, text_key, start, end)``."""
    place = F.xxhash64("doc", "text_key")
    docs = keyed_texts(df, id_col, text_col)
    hit = Members(wanted.select(place.alias("_place_key")), "_place_key").mark(docs, place, "_maybe").where("_maybe").drop("_maybe")
    at = wanted.withColumnRenamed("doc", "_doc").withColumnRenamed("text_key", "_key")
    joined = hit.join(at, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")))
    cutout = joined.select("line", F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start")).alias("raw")).dropDuplicates(["line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = pa.array([b" ".join(normalise(t)).decode("utf-8", "replace") for t in batch.column(1).to_pylist()], pa.string())
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")[1::2]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids), norm], names=["line", "id", "norm"])

    return arrow(cutout, run, "line binary, id long, norm string")


def within(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Which pairs have a Levenshtein distance of ``most`` or less each: all pairs at once along the antidiagonals.

    Cells further off the main diagonal than the largest ``most`` cannot matter. A pair leaves when two
    antidiagonals in a row, one of which any path meets, are above its ``most``.
    """
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    flat = np.frombuffer("".join(a + b for a, b in pairs).encode("utf-32-le", "surrogatepass"), np.int32)
    found, left, e, longest = np.zeros(len(pairs), bool), np.arange(len(pairs)), int(most.max()), int(max(n.max(), m.max()))
    pad, rows, at = e + 3, e + 1, 0
    kind, beyond = (np.int16, 32000) if flat.max() < 32000 else (np.int32, 1 << 21)
    a = np.full((longest + 2 * pad, len(pairs)), beyond, kind)
    b = np.full_like(a, beyond + 1)
    for k, (x, y) in enumerate(zip(n.tolist(), m.tolist())):
        a[pad : pad + x, k] = flat[at : at + x]
        b[pad + longest - y : pad + longest, k] = flat[at + x : at + x + y][::-1]
        at += x + y
    kind = kind if longest < 8000 else np.int32
    last, now = np.full((rows, len(pairs)), 1 << 14 if kind is np.int16 else 1 << 29, kind), None
    now = last.copy()
    now[e // 2] = 0
    ends, still = n + m, np.abs(n - m) <= most
    ending = set(ends.tolist())
    for s in range(1, int(ends.max()) + 1):
        c = (s + e) % 2  # row u holds the cell with i - j = 2 u + c - e
        i, j = (s - e + c) // 2, (s + e - c) // 2
        step = np.empty_like(now)
        if c:
            np.minimum(now[:-1], now[1:], out=step[:-1])
            step[-1] = now[-1]
        else:
            np.minimum(now[:-1], now[1:], out=step[1:])
            step[0] = now[0]
        step += 1
        unlike = a[pad + i - 1 : pad + i - 1 + rows] ^ b[pad + longest - j : pad + longest - j + rows]
        last += np.minimum(unlike, 1, out=unlike)
        np.minimum(step, last, out=step)
        last, now = now, step
        if s in ending:
            for k in np.flatnonzero(still & (ends[left] == s)).tolist():
                x = left[k]
                found[x], still[k] = now[(n[x] - m[x] + e - c) // 2, k] <= most[x], False
        if s % 32 == 0:
            still &= np.minimum(now, last).min(0) <= most[left]
            if not still.any():
                break
            if 4 * still.sum() < 3 * len(left):
                left, last, now, a, b = left[still], *(np.ascontiguousarray(x[:, still]) for x in (last, now, a, b))
                still = still[still]
    return found


#: Cells of an antidiagonal, over all pairs, that are worked on at once.
_CELLS = 65536


def all_within(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """:func:`within` in parts of pairs alike in length."""
    found, order, at = np.zeros(len(pairs), bool), np.argsort(most, kind="stable"), 0
    limits = most[order]
    while at < len(order):
        widest = int(limits[at]) * 9 // 8 + 4
        some = order[at : min(at + max(1, _CELLS // widest), int(np.searchsorted(limits, widest, "right")))]
        found[some] = within([pairs[k] for k in some.tolist()], most[some])
        at += len(some)
    return found


def letter_counts(norms: list[str]) -> np.ndarray:
    """How often the characters of each of 64 classes stand in each text; one edit changes one count by one, or two."""
    return np.array([np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64) for x in norms], np.int32)


def first_key(common: set[int], unlike: int) -> int:
    """The first key under which a pair is compared; lines whose fingerprints are far apart meet under keys of bags alone."""
    return min(common if unlike.bit_count() <= WIDE else (k for k in common if k & 1))


class Group:
    """Lines under one key, and the verified links that connect whatever all verified links among them connect.

    Lines already connected are not compared again, so a group of near copies costs one
    verification a line instead of one a pair, and gives one link a line. A pair is left to the first key under which it is compared.
    Lines with many others near come first: copies are alike to their original more often than to each other.
    What no alignment of words tells stays ``open``, to be verified together with the pairs of other groups.
    """

    def __init__(self, key: int, fps: np.ndarray, lines: list[bytes], norms: list[str], keys: list[set[int]], similarity: float) -> None:
        self.lines, self.norms, self.links, self.open = lines, norms, [], []
        self.root = list(range(len(lines)))
        most, bits = 64 if key & 1 else WIDE, fps.view(np.uint64)
        order = list(self.root)
        if len(order) > 2:
            around = np.array([np.count_nonzero(np.bitwise_count(bits ^ x) <= most) for x in bits])
            order = np.lexsort((fps, -around)).tolist()
            bits = bits[order]
        letters, sizes = None, np.array([len(norms[x]) for x in order])
        for i in range(1, len(order)):
            near = np.flatnonzero(np.bitwise_count(bits[:i] ^ bits[i]) <= most)
            if len(near) > 2:  # edits are at least the letters that one has more of
                letters = letter_counts([norms[x] for x in order]) if letters is None else letters
                more = letters[near] - letters[i]
                edits = np.maximum(np.where(more > 0, more, 0).sum(1), np.where(more < 0, -more, 0).sum(1))
                near = near[edits <= (1 - similarity) * np.maximum(sizes[near], sizes[i]) + 1e-9]
            for j in near.tolist():
                x, y = order[i], order[j]
                if self.apart(x, y) and first_key(keys[x] & keys[y], int(bits[i] ^ bits[j])) == key:
                    allowed = edits_allowed(norms[x], norms[y], similarity)
                    if abs(len(norms[x]) - len(norms[y])) <= allowed:
                        if aligned(norms[x], norms[y], allowed):
                            self.link(x, y)
                        else:
                            self.open.append((x, y, allowed))

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def apart(self, x: int, y: int) -> bool:
        return self.top(x) != self.top(y)

    def link(self, x: int, y: int) -> None:
        self.root[self.top(x)] = self.top(y)
        self.links.append((self.lines[x], self.lines[y]))


def settle(groups: list[Group]) -> list[tuple[bytes, bytes]]:
    """All links of ``groups``, whose open pairs are verified, many at once, as long as they are not connected."""
    waiting = [(g, *p) for g in groups for p in g.open]
    for at in range(0, len(waiting), _TOGETHER):
        some = [w for w in waiting[at : at + _TOGETHER] if w[0].apart(w[1], w[2])]
        if some:
            texts = [(g.norms[x], g.norms[y]) for g, x, y, _ in some]
            for k in np.flatnonzero(all_within(texts, np.array([w[3] for w in some]))).tolist():
                g, x, y, _ = some[k]
                if g.apart(x, y):
                    g.link(x, y)
    return [link for g in groups for link in g.links]


def key_links(
    key: int, fps: np.ndarray, lines: list[bytes], norms: list[str], keys: list[set[int]], similarity: float
) -> list[tuple[bytes, bytes]]:
    """Links of one :class:`Group`."""
    return settle([Group(key, fps, lines, norms, keys, similarity)])


def _links(entries: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` between lines of ``entries(key, parts, line, fp, norm, mates)`` that share a key."""
    rows = _dealt(entries, F.col("line"), "line", "fp", "norm", "mates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, waiting = [], 0

        def links() -> pa.RecordBatch:
            nonlocal groups, waiting
            found, groups, waiting = settle(groups), [], 0
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for starts, ends, (key, _, _, line, fps, norm, mates) in whole_groups(batches, 3):
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s > 1:
                    sets = [set(m.tolist()) for m in mates[s:e]]
                    group = Group(int(key[s]), fps[s:e], line[s:e].tolist(), norm[s:e].tolist(), sets, similarity)
                    if group.links or group.open:
                        groups.append(group)
                        waiting += len(group.open) + 1
                        if waiting > _TOGETHER:
                            yield links()
        yield links()

    return arrow(rows, run, "a binary, b binary")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Each line that is not the first of its group: ``doc, text_key, start, end, first_doc, first_start``."""
    places = _places(df)
    blocks = table(_lines(keyed_texts(df, id_col, text_col), places))
    near = table(_near(blocks.where("kind = 2")))
    again = _occurrences(blocks, near, places)

    same = F.col("doc").eqNullSafe(F.col("best.doc")) & (F.col("start") == F.col("best.start")) & (F.col("text_key") == F.col("best.text_key"))
    firsts = table(again.where("met").where(same).select("line", "best").distinct())
    texts = table(_texts(df, firsts.select("line", "best.doc", "best.text_key", "best.start", "best.end"), id_col, text_col))
    mates = near.groupBy("id", "fp").agg(F.collect_list(F.struct("key", "parts")).alias("at"))
    entries = mates.join(texts, "id").select("line", "fp", "norm", F.col("at.key").alias("mates"), F.explode("at").alias("_at"))
    labels = table(connected_components(_links(entries.select("_at.key", "_at.parts", "line", "fp", "norm", "mates"), similarity).distinct()))

    grouped = firsts.join(labels, F.col("line") == F.col("node")).select("line", "best", "component")
    best = grouped.groupBy("component").agg(F.min("best").alias("whole"))
    verdict = table(grouped.join(best, "component").select(F.col("line").alias("_line"), "whole"))
    told = again.join(verdict, F.col("line") == F.col("_line"), "left").withColumn("best", F.coalesce("whole", "best"))
    return told.where(~same).select("doc", "text_key", "start", "end", F.col("best.doc").alias("first_doc"), F.col("best.start").alias("first_start"))


def _as_found(text: str, marks: list[dict]) -> list[tuple[int, int]]:
    return [(m["start"], m["end"]) for m in marks]


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one occurrence of each group of lines, and ``removed``: the spans cut from the original."""
    later = repeated_lines(df, id_col, text_col, similarity)
    marks = later.groupBy("doc", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).cast(REMOVED).alias("marks"))
    return cut(df, marks, id_col, text_col, _as_found)
