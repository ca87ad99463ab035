"""Toxicity by compression distance.

zstandard dictionaries are trained on toxic and on ordinary text, and a document is read in overlapping windows of
a few words. A window's advantage is by how many bytes shorter it gets with a toxic dictionary than with the ordinary one.
A toxic dictionary is the ordinary one with toxic text behind it, so ordinary windows gain
nothing from it, and gains show what only toxic text holds.

Most of a toxic document is ordinary prose, and its names and phrases recur in copies of itself. So toxic documents are dealt
into groups, one dictionary is trained on each, and a window's advantage is the least
that all of them give: what is toxic recurs in all groups, chance likenesses and copies do not. Each
group's text is refined in rounds to those windows on which the dictionaries of the other groups agree, at a
threshold that ordinary windows hardly ever reach. Two views, each with its own width of window, are taken.
A document's largest advantages and the number of windows at each threshold are calibrated by a logistic
model on labelled rows that no dictionary has seen.

Training uses a bounded sample of labelled rows: at most ``MAX_TOXIC`` and ``MAX_ORDINARY`` documents, those
of the smallest hashes, none longer than ``MAX_CHARS``. Every row is scored by its whole text.

Defined results: an empty or null text has no windows and gets the calibration's score for
none; a document labelled twice counts as toxic if any label says so; without
labels of both kinds every score is the share of toxic labels (0 if there are none); a row without doc_id is
scored and not held out; repeated rows are scored alike; an empty table gives an empty result; ``toxicity`` ignores other
columns, ``without_toxic`` passes them through, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow, trim

MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 4000, 6000, 16_000
THRESHOLD = 0.3
#: Words in a window, windows in a stretch, groups of toxic documents, bytes of ordinary and of toxic text in a dictionary.
VIEWS = ((5, 7, 12, 256 * 1024, 64 * 1024), (2, 7, 5, 64 * 1024, 16 * 1024))
#: Rounds of refinement; the share of ordinary windows below its threshold, and how many of them are looked at.
ROUNDS, QUANTILE, LOOKED_AT = 3, 0.998, 40_000
LEVEL = 3
STEPS = (1, 2, 3, 5)
_MARKS = b".,;:!?\"'()*#$%&|[]{}<>-"


def held_out(doc_id) -> bool:
    """Rows that no training may use."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def _words(text: str | None) -> list[bytes]:
    return [x for x in (w.strip(_MARKS) for w in (text or "").lower().encode("utf-8", "surrogatepass").split()) if x]


def windows(words: list[bytes], width: int) -> Iterator[bytes]:
    """Each run of ``width`` words with its borders; a shorter text is one window."""
    joined, edges = b" " + b" ".join(words) + b" ", [0, *accumulate(len(w) + 1 for w in words)]
    for k in range(max(1, len(words) - width + 1) if words else 0):
        yield joined[edges[k] : edges[min(k + width, len(words))] + 1]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    given = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    given.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """At most ``size`` bytes that serve the samples best: all of them if they fit."""
    if sum(map(len, samples)) <= size:
        return b"".join(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):  # samples too few or too short to train on
        return b"".join(samples)[:size]


class View:
    """Advantages of windows of one width.

    Stretches of ``stretch`` windows are compressed first, and only those on whose
    advantage all toxic dictionaries agree are looked at window by window.
    """

    def __init__(self, width: int, stretch: int, ordinary: bytes, toxic: list[bytes]) -> None:
        self.width, self.stretch = width, stretch
        self.ordinary = _compressor(ordinary).compress
        self.toxic = [_compressor(ordinary + t).compress for t in toxic]

    def least(self, text: bytes, toxic: list) -> int:
        """By how much every one of ``toxic`` makes ``text`` shorter; not above zero as soon as one does not."""
        usual, out = len(self.ordinary(text)), 99
        for compress in toxic:
            gain = usual - len(compress(text))
            if gain < out:
                if gain <= 0:
                    return gain
                out = gain
        return out

    def advantages(self, words: list[bytes], but: int = -1) -> list[tuple[bytes, int]]:
        """Windows that every toxic dictionary (leaving out number ``but``) makes shorter, and by how much at least."""
        toxic, width, last = [t for k, t in enumerate(self.toxic) if k != but], self.width, len(words)
        joined, edges = b" " + b" ".join(words) + b" ", [0, *accumulate(len(w) + 1 for w in words)]
        out = []
        for k in range(0, max(1, last - width + 1) if words else 0, self.stretch):
            end = min(k + width + self.stretch - 1, last)
            if self.least(joined[edges[k] : edges[end] + 1], toxic) > 0:
                for i in range(k, max(k + 1, end - width + 1)):
                    window = joined[edges[i] : edges[min(i + width, last)] + 1]
                    if (gain := self.least(window, toxic)) > 0:
                        out.append((window, gain))
        return out

    def features(self, words: list[bytes]) -> list[float]:
        found = sorted((a for _, a in self.advantages(words)), reverse=True) if self.toxic else []
        counts = [sum(a >= t for a in found) for t in STEPS]
        top = [*found[:3], 0, 0, 0][:3]
        return [*(x / 4 for x in top), *np.log1p(counts), np.log1p(1000 * counts[1] / (len(words) + 20))]


def _samples(windows: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """Windows in random order, eight to a sample."""
    order = rng.permutation(len(windows))
    return [b"".join(windows[i] for i in order[k : k + 8]) for k in range(0, len(order), 8)]


def _view(
    width: int, stretch: int, groups: int, base: int, size: int, toxic: list[str], ordinary: list[str]
) -> tuple[int, int, bytes, list[bytes]]:
    """Train one view from the texts of toxic and of ordinary documents; their words are split anew each time, for the driver's memory."""
    rng = np.random.default_rng(11)
    groups = max(1, min(groups, len(toxic) // 4))
    plain = _dictionary([b" ".join(_words(t)) + b" " for t in ordinary], base)
    dealt = [toxic[k::groups] for k in range(groups)]
    kept = [[x for t in group for x in windows(_words(t), width)] for group in dealt]
    for round_ in range(ROUNDS + 1):
        view = View(width, 1, plain, contents := [_dictionary(_samples(k, rng), size) for k in kept])
        if groups == 1 or round_ == ROUNDS:
            break
        refined = []
        for k, group in enumerate(dealt):
            gains, seen = [], 0
            for t in ordinary[k::groups]:
                words = _words(t)
                seen += max(1, len(words) - width + 1)
                gains += [a for _, a in view.advantages(words, k)]
                if seen > LOOKED_AT:
                    break
            gains = sorted(gains, reverse=True)
            rare = int((1 - QUANTILE) * seen)
            least = 1 + (gains[rare] if rare < len(gains) else 0)
            refined.append([x for t in group for x, a in view.advantages(_words(t), k) if a >= least])
        if min(map(len, refined)) < 5:
            break
        kept = refined
    return width, stretch, plain, contents


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-1, rounds: int = 60) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Views and calibration as they run in a task; built from what :func:`fit` returns."""

    def __init__(self, model: dict) -> None:
        self.share = model.get("share", 0.0)
        self.views = [View(*v) for v in model.get("views", ())]
        self.weights = np.array(model.get("weights", [0.0]))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.views:
            return np.full(len(texts), float(self.share))
        x = np.array([document_features(self.views, t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def document_features(views: list[View], text: str | None) -> list[float]:
    words = _words(text)
    return [x for v in views for x in v.features(words)]


def fit(rows: list[tuple[object, str | None, int]]) -> dict:
    """A model from (doc_id, text, toxic) rows: two thirds for the dictionaries, one for calibration."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[1] or "", r[2]))
    parts: list[list] = [[], []]
    for i, r in enumerate(rows):
        parts[i % 3 == 2].append(r)
    share = sum(r[2] for r in rows) / len(rows) if rows else 0.0
    if not all(len({r[2] for r in p}) == 2 for p in parts):
        return {"share": share}
    toxic, ordinary = (list(dict.fromkeys(r[1] or "" for r in parts[0] if r[2] == k)) for k in (1, 0))
    views = [_view(*v, toxic, ordinary) for v in VIEWS]
    ready = [View(*v) for v in views]
    x = np.array([document_features(ready, r[1]) for r in parts[1]])
    weights = _logistic(x, np.array([r[2] for r in parts[1]], float)).tolist()
    del ready
    trim()
    return {"share": share, "views": views, "weights": weights}


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """Training rows, at most ``MAX_TOXIC + MAX_ORDINARY`` of at most ``MAX_CHARS`` characters, never held-out ones."""
    labels = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    usable = labels.where(F.col("_id").isNotNull() & F.col("_toxic").isNotNull() & (F.crc32(F.col("_id").cast("string")) % 4 != 2))
    each = usable.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    order = (F.xxhash64("_id"), F.col("_id"))
    ids = each.where("_toxic = 1").orderBy(*order).limit(MAX_TOXIC).union(each.where("_toxic = 0").orderBy(*order).limit(MAX_ORDINARY))
    # at most MAX_TOXIC + MAX_ORDINARY ids: a proven bound
    texts = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    found = texts.where(F.length(F.coalesce("_text", F.lit(""))) <= MAX_CHARS).join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    found = found.groupBy("_doc").agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic"))
    return [(r[0], r[1], r[2]) for r in found.collect()]


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``df``."""
    source = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model(model)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ready.scores(batch.column(1).to_pylist()))], names=["_id", "score"])

    scored = arrow(source, run, f"_id {kind}, score double")
    return scored.select(
        F.col("_id").alias(id_col),
        F.coalesce(F.crc32(F.col("_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, fit(labelled_sample(docs, labels, id_col, text_col)), id_col, text_col)


def without_toxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; one pass, whole rows through the scorer."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model(model)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(ready.scores(batch.column(at).to_pylist()) < THRESHOLD))

    return arrow(docs, run, schema)
