"""SentencePiece encoding and decoding by a max-plus scan.

A byte-fallback BPE model encodes a text as the one sequence of pieces in which each piece, and each
pair of neighbours, is what the merges make of that stretch on its own: merges run in one global order, so the first
merge across a border would also happen with the two pieces alone. Encoding is therefore a best path in the max-plus semiring with
weight 0 for a pair that holds and minus infinity for one that does not, with the last piece as state.

A document of up to ``CHUNK`` characters is one chunk, its path found depth first, longest piece first, never
entering a state twice; stretches between reset points (before a space mark, around a line break), where only
one state is possible, are remembered by their text. A giant document is cut into chunks anywhere, even within a word:
each chunk yields the transfer matrix between its boundary states (pieces across the cuts), matrices
of a document are combined associatively in groups of ``FAN`` until one is left, the states at the cuts come down the same
tree, and each chunk is traced on its own. No task holds more than one chunk or ``FAN`` matrices.

The model file is read on the driver; executors get its pieces. It must be a BPE model with byte fallback, a space
mark in front and no other normalisation, as checked on loading.

Defined results: a null or empty text has no ids; a character the model lacks becomes its bytes; decoding turns
every space mark into a space, so a text that itself holds U+2581 does not come back; repeated rows
are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow
from sparkloom.storage import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16
FAN = 32
MARK = "▁"
_REMEMBERED = 250_000
_BATCH = 256
_ONE_OR_TWO = (2, 1)
#: Longer stretches are traced without keeping their prefixes.
_SHORT = 64


def load(path: str = MODEL) -> dict:
    """Pieces and scores of a model file, as plain data for the executors."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    usual = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in usual}
    scores = {p: s for p, (_, s) in pieces.items()}
    pairs = {x for p in pieces for x in zip(p, p[1:])}
    apart = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    mixed = {x for a, b in pairs for x, y in ((a, b), (b, a)) if y in apart and x not in apart and x != MARK}
    whole = {p: merged(p, scores) == [p] for p in pieces}
    if sp.normalize("a  b\t") != f"{MARK}a{MARK}{MARK}b\t" or sum(map(sp.is_byte, ids)) != 256:
        raise ValueError(f"{path}: a model with byte fallback and no normalisation is needed")
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError(f"{path}: a piece crosses a space mark")
    return {"pieces": pieces, "bytes": [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], "size": len(ids), "whole": {p for p, fine in whole.items() if fine}, "apart": apart, "mixed": "".join(sorted(mixed))}


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """What the merges make of a short text: best score first, leftmost among equals."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            s = scores.get(parts[k] + parts[k + 1])
            if s is not None and (best is None or s > best):
                best, at = s, k
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Codec:
    """Encoder and decoder over one model; remembers pairs and stretches it has seen."""

    def __init__(self, model: dict) -> None:
        self.ids = {p: i for p, (i, _) in model["pieces"].items() if p in model["whole"] or len(p) == 1}
        self.scores = {p: s for p, (_, s) in model["pieces"].items()}
        self.longest = max(map(len, self.ids))
        self.bytes = model["bytes"]
        #: Stretches between reset points: no piece reaches over the border of two. Marks of
        #: punctuation share pieces with their like alone, but for texts with a ``mixed`` character.
        apart, self.coarse = re.escape(model["apart"]), re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.fine = re.compile(f"{MARK}*[^{MARK}\n{apart}]+|{MARK}*[{apart}]+|{MARK}+|\n")
        self.mixed = re.compile(f"[{re.escape(model['mixed'])}]" if model["mixed"] else r"(?!)")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.steps: dict[int, bool] = {}
        self.survivors: dict[str, tuple[int, int]] = {}
        #: Lengths of the pieces by their last three characters; shorter ones are always tried.
        self.ending: dict[str, list[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                self.ending.setdefault(p[-3:], []).append(len(p))
        self.ending = {k: [*sorted(set(v), reverse=True), 2, 1] for k, v in self.ending.items()}
        #: Lengths of the pieces by their first two characters, longest first, the single character last.
        self.lengths: dict[str, list[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                self.lengths.setdefault(p[:2], []).append(len(p))
        self.lengths = {k: sorted({*v, 1}, reverse=True) for k, v in self.lengths.items()}
        codec = self

        class Stretches(dict):
            old: dict[str, tuple[int, ...]] = {}

            def __missing__(self, stretch: str) -> tuple[int, ...]:
                if len(self) > _REMEMBERED:  # what is used again moves over from the old half
                    self.old = dict(self)
                    self.clear()
                found = self.old.get(stretch)
                if found is None:
                    found = codec.ahead(stretch) if len(stretch) <= _SHORT else codec.ids_of(codec.trace(stretch, 0, len(stretch)))
                self[stretch] = found
                return found

        self.stretches = Stretches()
        self.shown = [b""] * model["size"]
        for p, i in self.ids.items():
            self.shown[i] = p.replace(MARK, " ").encode("utf-8")
        for b, i in enumerate(self.bytes):
            self.shown[i] = bytes([b])

    # the lattice

    def fits(self, a: str, b: str) -> bool:
        """Whether piece ``b`` may follow piece ``a``: weight 0 in place of minus infinity."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * _REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = merged(a + b, self.scores) == [a, b]
        return known

    def starting(self, text: str, at: int) -> Iterator[int]:
        """Ends of the pieces that start at ``at``, longest first; a character always is one."""
        ids, most = self.ids, len(text) - at
        for n in self.lengths.get(text[at : at + 2], (1,)):
            if n == 1 or (n <= most and text[at : at + n] in ids):
                yield at + n

    # one chunk

    def ahead(self, text: str) -> tuple[int, ...]:
        """Ids of a short text by the forward pass: one surviving state for each prefix.

        The encoding of a prefix is that of a shorter one and a piece that fits its
        last piece, so a prefix has a single last piece of weight 0. Survivors are kept by prefix, as
        most stretches share their beginning with one seen before.
        """
        known, ids, scores, steps, ending = self.survivors, self.ids, self.scores, self.steps, self.ending
        if len(known) > 3 * _REMEMBERED:
            known.clear()
        end = len(text)
        done = end
        while done and text[:done] not in known:
            done -= 1
        for e in range(done + 1, end + 1):
            for n in ending.get(text[e - 3 : e], _ONE_OR_TWO) if e > 2 else _ONE_OR_TWO:
                start = e - n
                if start < 0:
                    continue
                piece = text[start:e]
                i = ids.get(piece, -1)
                if i < 0:
                    if n > 1:
                        continue
                elif start:
                    last, m = known[text[:start]]
                    if last >= 0:
                        key = last << 20 | i
                        fine = steps.get(key)
                        if fine is None:
                            if len(steps) > 4 * _REMEMBERED:
                                steps.clear()
                            before = text[start - m : start]
                            fine = steps[key] = merged(before + piece, scores) == [before, piece]
                        if not fine:
                            continue
                known[text[:e]] = (i, n)
                break
            else:
                raise ValueError(f"no piece ends {text[:e]!r}")
        out: list[int] = []
        while end:
            i, n = known[text[:end]]
            if i < 0:
                out += [self.bytes[b] for b in reversed(text[end - 1].encode("utf-8", "replace"))]
            else:
                out.append(i)
            end -= n
        return tuple(reversed(out))

    def trace(self, text: str, start: int, end: int, before: str | None = None, after: str | None = None) -> list[str]:
        """The pieces of ``text[start:end]`` between the neighbours ``before`` and ``after``."""
        if start == end:
            return []
        path: list[str] = []
        dead: set[tuple[int, int]] = set()
        todo = [(start, before, self.starting(text, start))]
        while todo:
            at, last, ends = todo[-1]
            for e in ends:
                piece = text[at:e]
                if e > end or (e, at) in dead or (last is not None and not self.fits(last, piece)):
                    continue
                if e == end:
                    if after is None or self.fits(piece, after):
                        return [*path, piece]
                    continue
                path.append(piece)
                todo.append((e, piece, self.starting(text, e)))
                break
            else:
                todo.pop()
                if path:
                    dead.add((at, at - len(path.pop())))
        raise ValueError("no path: the model lacks a piece for a character")

    def ids_of(self, pieces: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            else:
                out.append(i)
        return tuple(out)

    def encode(self, text: str | None) -> Iterator[int]:
        """Ids of a text of one chunk."""
        if not text:
            return iter(())
        borders = self.coarse if self.mixed.search(text) else self.fine
        return chain.from_iterable(map(self.stretches.__getitem__, borders.findall(MARK + text.replace(" ", MARK))))

    def decode(self, ids) -> str:
        """Text of ids; the mark in front goes, broken bytes become U+FFFD."""
        shown = self.shown
        text = b"".join(map(shown.__getitem__, ids))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")

    # many chunks

    def covering(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Boundary states at a cut: pieces (start, end) with start < cut <= end."""
        found = []
        for start in range(max(0, cut - self.longest), cut):
            found += [(start, e) for e in self.starting(text, start) if e >= cut]
        return found

    def matrix(self, text: str, left: int, right: int, first: bool, last: bool) -> list[tuple[int, int, int, int]]:
        """Pairs of boundary states at the two cuts with weight 0; the others weigh minus infinity.

        One pass for all states before the chunk: each piece carries the set of those it can be reached from.
        """
        inside = [(left, left)] if first else self.covering(text, left)
        nodes: dict[int, dict[int, int]] = {}
        for k, (s, e) in enumerate(inside):
            nodes.setdefault(e, {})[s] = nodes.get(e, {}).get(s, 0) | 1 << k
        for at in range(left, right):
            here = nodes.pop(at, None)
            if not here:
                continue
            ends = list(self.starting(text, at))
            for start, reached in here.items():
                before = text[start:at]
                for e in ends:
                    if (not before or self.fits(before, text[at:e])) and not (last and e > right):
                        there = nodes.setdefault(e, {})
                        there[at] = there.get(at, 0) | reached
        return [
            (*inside[k], s, e)
            for e, row in nodes.items()
            if e >= right
            for s, reached in row.items()
            for k in range(len(inside))
            if reached >> k & 1
        ]


_codecs: dict[int, Codec] = {}


def _codec(model: dict) -> Codec:
    """One codec per worker process and model, so what it remembers outlives a task."""
    key = hash((model["size"], len(model["pieces"]), tuple(list(model["pieces"])[:50])))
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def product(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Max-plus product of two transfer matrices given by their pairs of weight 0."""
    onward: dict[tuple, list[tuple]] = {}
    for s in b:
        onward.setdefault(s[:2], []).append(s[2:])
    return sorted({(*s[:2], *t) for s in a for t in onward.get(s[2:], ())})


def states_within(parts: list[list[tuple]], start: tuple, end: tuple) -> list[tuple]:
    """The states at the cuts between matrices on the path from ``start`` to ``end``."""
    ahead = [{start}]
    for m in parts:
        ahead.append({s[2:] for s in m if s[:2] in ahead[-1]})
    back = {end}
    out = [end]
    for m, reached in zip(reversed(parts), reversed(ahead[:-1])):
        back = {s[:2] for s in m if s[2:] in back} & reached
        out.append(min(back))
    return out[::-1]


def _chunks(giants: DataFrame, size: int, margin: int) -> DataFrame:
    """``doc, text_key, no, last, at, left, right, piece``: each chunk with ``margin`` characters on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = MARK + text.replace(" ", MARK)
                for no, left in enumerate(range(0, len(text), size)):
                    right, at = min(left + size, len(text)), max(0, left - margin)
                    row = (doc, key, no, right == len(text), at, left - at, right - at, text[at : right + margin])
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=kinds)

    names = ["doc", "text_key", "no", "last", "at", "left", "right", "piece"]
    kinds = pa.schema(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]))
    return arrow(giants, run, "doc long, text_key long, no long, last boolean, at long, left long, right long, piece string")


def _spread(rows: DataFrame) -> DataFrame:
    """Chunks over all cores, each on its own: a few giants would else lie in one small file, in one task."""
    return rows.repartition(2 * max(2, rows.sparkSession.sparkContext.defaultParallelism), "doc", "text_key", "no")


_MATRIX = "doc long, text_key long, no long, m array<array<long>>"


def _encode_giants(giants: DataFrame, model, size: int, fan: int) -> DataFrame:
    """``doc, text_key, ids`` for distinct rows ``doc, text_key, text``."""
    chunks = table(_chunks(giants, size, 64))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            for r in batch.to_pylist():
                m = codec.matrix(r["piece"], r["left"], r["right"], r["no"] == 0, r["last"])
                shifted = [[x + r["at"] for x in s] for s in m]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k]], pa.int64()) for k in ("doc", "text_key", "no")] + [pa.array([shifted], pa.list_(pa.list_(pa.int64())))],
                    names=["doc", "text_key", "no", "m"],
                )

    levels = [table(arrow(_spread(chunks), matrices, _MATRIX))]
    group = ["doc", "text_key", (F.floor(F.col("no") / fan)).cast("long").alias("up")]

    def combine(key, pdf):
        import pandas as pd

        m = None
        for part in pdf.sort_values("no")["m"]:
            part = [tuple(map(int, s)) for s in part]
            m = part if m is None else product(m, part)
        return pd.DataFrame({"doc": pd.array([pdf["doc"].iloc[0]], "Int64"), "text_key": [key[1]], "no": [key[2]], "m": [[list(s) for s in m]]})

    while levels[-1].where("no > 0").limit(1).count():
        levels.append(table(levels[-1].groupBy(*group).applyInPandas(combine, _MATRIX)))

    ends = levels[-1].select("doc", "text_key", "no", F.col("m")[0].alias("ends"))

    def spread(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("no")
        parts = [[tuple(map(int, s)) for s in m] for m in pdf["m"]]
        a = [int(x) for x in pdf["ends"].iloc[0]]
        states = states_within(parts, tuple(a[:2]), tuple(a[2:]))
        found = [[*s, *t] for s, t in zip(states, states[1:])]
        return pd.DataFrame({"doc": pd.array(pdf["doc"], "Int64"), "text_key": pdf["text_key"].tolist(), "no": pdf["no"].tolist(), "ends": found})

    for level in reversed(levels[:-1]):
        above = ends.select(F.col("doc").alias("_doc"), F.col("text_key").alias("_key"), F.col("no").alias("_up"), "ends")
        up = F.floor(F.col("no") / fan).cast("long")
        same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")) & (up == F.col("_up"))
        below = level.join(above, same).select("doc", "text_key", "no", "m", "ends")
        ends = table(below.groupBy(*group).applyInPandas(spread, "doc long, text_key long, no long, ends array<long>"))

    at = ends.select(F.col("doc").alias("_doc"), F.col("text_key").alias("_key"), F.col("no").alias("_no"), "ends")
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")) & (F.col("no") == F.col("_no"))
    placed = chunks.join(at, same).select("doc", "text_key", "no", "at", "piece", "ends")

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            for r in batch.to_pylist():
                s0, e0, s1, e1 = (x - r["at"] for x in r["ends"])
                text = r["piece"]
                if (s0, e0) == (s1, e1):
                    ids = ()
                else:
                    final = text[s1:e1]
                    ids = codec.ids_of([*codec.trace(text, e0, s1, text[s0:e0] or None, final), final])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k]], pa.int64()) for k in ("doc", "text_key", "no")] + [pa.array([list(ids)], pa.list_(pa.int32()))],
                    names=["doc", "text_key", "no", "ids"],
                )

    traced = arrow(_spread(placed), backtrace, "doc long, text_key long, no long, ids array<int>")
    ordered = traced.groupBy("doc", "text_key").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    return ordered.select("doc", "text_key", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, chunk: int = CHUNK, fan: int = FAN
) -> DataFrame:
    """One row per input row: ``doc_id, ids, n_tokens, round_trip`` (whether decoding gives the text back)."""
    model = df.sparkSession.sparkContext.broadcast(load(model_path))  # a vocabulary: bounded by the model
    source = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    giant = F.length("_text") >= chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                texts = batch.column(1).to_pylist()
                found = [np.fromiter(codec.encode(t), np.int32) for t in texts]
                fine = [codec.decode(ids.tolist()) == t for ids, t in zip(found, texts)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(fine)], names=["_id", "ids", "round_trip"])

    small = arrow(source.where(~giant), run, f"_id {kind}, ids array<int>, round_trip boolean")
    rows = source.where(giant).select("_id", F.col("_id").cast("long").alias("doc"), F.xxhash64("_text").alias("text_key"), "_text")
    rows = table(rows)
    parts = [small]
    if rows.limit(1).count():
        done = table(_encode_giants(rows.dropDuplicates(["doc", "text_key"]).select("doc", "text_key", "_text"), model, chunk, fan))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(model.value)
            for batch in batches:
                fine = [codec.decode(ids) == t for ids, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fine, pa.bool_())], names=["_id", "ids", "round_trip"])

        have = done.withColumnRenamed("doc", "_doc").withColumnRenamed("text_key", "_key")
        joined = rows.join(have, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))).select("_id", "ids", "_text")
        parts.append(arrow(joined, check, f"_id {kind}, ids array<int>, round_trip boolean"))
    found = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return found.select(F.col("_id").alias(id_col), "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


def decode(df: DataFrame, ids_col: str = "ids", out: str = "text", model_path: str = MODEL) -> DataFrame:
    """``df`` with the decoded text of an array of ids; a null array gives a null text."""
    model = df.sparkSession.sparkContext.broadcast(load(model_path))
    schema = df.withColumn(out, F.lit("")).schema
    at, names = df.columns.index(ids_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(at).to_pylist()]
            kept = [c for c, n in zip(batch.columns, batch.schema.names) if n != out]
            where = names.index(out)
            kept.insert(where, pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(kept, names=names)

    schema[out].nullable = True
    return arrow(df, run, schema)
