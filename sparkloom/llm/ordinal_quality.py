"""Quality by ordinal cumulative-link regression.

A document has one latent quality: shared weights over hashed text features, the mean over its words and a part for the whole text. Ordered
thresholds cut it into grades, P(grade > k) = sigmoid(quality - threshold k), so one set of weights serves
all grades. Fitted by gradient steps on labelled rows; the result is the expected grade and
the probability of reaching the selection grade.

Grades here: 0 for low quality, 1 for good but toxic, 2 for good. Training uses a bounded sample
of labelled rows, ``MAX_ROWS`` of the smallest hashes and none of the held-out ones; scoring covers all rows.

Features of the text: its length and its shares of distinct words and pairs. Features of a word: itself, its shape (letters, digits, marks, case) and its last three characters, hashed into
``BUCKETS`` weights; a word's sum is remembered.

Defined results: an empty or null text has the latent quality of no features (the intercept);
documents labelled twice take their lowest grade; without labels of two grades the expected grade is
the mean of the labels (0 without any) and the probability that share; repeated rows are scored alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow

MAX_ROWS, MAX_CHARS = 10_000, 16_000
BUCKETS = 1 << 18
GRADES = 3
SELECT_GRADE = 2
SELECT_AT = 0.5
#: Weight of a feature of the whole text beside the mean over its words.
WHOLE = 0.1
_MEMO = 300_000
_SHAPES = ((re.compile(r"[a-zß-ɏ]+"), "a"), (re.compile(r"[A-ZÀ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "0"))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def shape(word: str) -> str:
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return word[:12]


def _bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "replace")) % BUCKETS


def word_features(word: str) -> tuple[int, int, int]:
    return _bucket("w", word.lower()), _bucket("s", shape(word)), _bucket("e", word[-3:].lower())


def text_features(words: list[str]) -> list[int]:
    """Buckets for the text as a whole: its length, and how many of its words and pairs are distinct."""
    n = len(words)
    size = n.bit_length()
    distinct = int(10 * len(set(words)) / n) if n else 10
    pairs = int(10 * len(set(zip(words, words[1:]))) / (n - 1)) if n > 1 else 10
    return [_bucket("n", str(size)), _bucket("d", f"{distinct}/{size}"), _bucket("p", f"{pairs}/{size}")]


def _rows(text: str | None, memo: dict[str, tuple[int, int, int]]) -> np.ndarray:
    """Buckets of all features of a text, repeats included."""
    words = (text or "").split()
    out = []
    for w in words:
        f = memo.get(w)
        if f is None:
            if len(memo) > _MEMO:
                memo.clear()
            f = memo[w] = word_features(w)
        out += f
    return np.array(out, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[object, str | None, int]], grades: int = GRADES, epochs: int = 12, rate: float = 0.5) -> dict:
    """A model from (doc_id, text, grade) rows; the order of rows does not matter."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[1] or "", r[2]))
    counts = np.bincount([r[2] for r in rows], minlength=grades) if rows else np.zeros(grades)
    if (counts > 0).sum() < 2:
        return {"mean": float(np.mean([r[2] for r in rows])) if rows else 0.0, "tail": float(np.mean([r[2] >= SELECT_GRADE for r in rows])) if rows else 0.0}
    memo: dict = {}
    data = []
    for r in rows:
        k, n = np.unique(_rows(r[1], memo), return_counts=True)
        whole = text_features((r[1] or "").split())
        data.append((np.concatenate([k, whole]).astype(np.int64), np.concatenate([n / max(1.0, n.sum()), [WHOLE] * len(whole)])))
    y = [r[2] for r in rows]
    above = np.clip([1 - counts[: k + 1].sum() / counts.sum() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    first = -np.log(above / (1 - above))  # thresholds start at the grades' shares
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    low = first[0]
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    rng = np.random.default_rng(5)
    low_seen, gaps_seen = 1e-4, np.full(len(gaps), 1e-4)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            k, x = data[i]
            cuts = low + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            score = 100.0 * float(w[k] @ x)
            # P(grade = y) is the difference of two neighbouring tails
            tails = np.concatenate([[1.0], _sigmoid(score - cuts), [0.0]])
            slopes = tails * (1 - tails)
            p = max(tails[y[i]] - tails[y[i] + 1], 1e-6)
            to_score = (slopes[y[i]] - slopes[y[i] + 1]) / p
            g = -to_score * 100.0 * x
            seen[k] += g * g
            w[k] -= rate * 0.05 * g / np.sqrt(seen[k])
            to_cuts = np.zeros(grades + 1)
            to_cuts[y[i]] -= slopes[y[i]] / p
            to_cuts[y[i] + 1] += slopes[y[i] + 1] / p
            to_cuts = -to_cuts[1:-1]
            low_g, gap_g = to_cuts.sum(), np.array([to_cuts[j + 1 :].sum() * np.exp(gaps[j]) for j in range(len(gaps))])
            low_seen += low_g**2
            gaps_seen = gaps_seen + gap_g**2
            low -= rate * 0.05 * low_g / np.sqrt(low_seen)
            gaps = gaps - rate * 0.05 * gap_g / np.sqrt(gaps_seen)
    cuts = low + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return {"weights": (100.0 * w).astype(np.float32), "cuts": cuts}


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """At most ``MAX_ROWS`` training rows (doc_id, text, grade) of at most ``MAX_CHARS`` characters, never held-out ones."""
    rest = F.crc32(F.col(id_col).cast("string")) % 4
    each = labels.where(F.col(id_col).isNotNull() & (rest != 2)).withColumn("_grade", grade).where("_grade is not null")
    ids = each.groupBy(id_col).agg(F.min("_grade").cast("int").alias("_grade")).orderBy(F.xxhash64(id_col), id_col).limit(MAX_ROWS)
    # at most MAX_ROWS ids: a proven bound
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).where(F.length(F.coalesce("_text", F.lit(""))) <= MAX_CHARS)
    found = texts.join(F.broadcast(ids), id_col)
    found = found.groupBy(id_col).agg(F.min("_text").alias("_text"), F.min("_grade").alias("_grade"))
    return [tuple(r) for r in found.collect()]


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_probability, selected`` for each row."""
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            if "weights" not in model:
                grades, tails = (np.full(batch.num_rows, model[k]) for k in ("mean", "tail"))
            else:
                weights, latent = model["weights"], []
                for t in batch.column(1):
                    total, words = 0.0, (t.as_py() or "").split()
                    for w in words:
                        v = memo.get(w)
                        if v is None:
                            if len(memo) > _MEMO:
                                memo.clear()
                            v = memo[w] = float(weights[list(word_features(w))].sum())
                        total += v
                    latent.append(total / max(1, 3 * len(words)) + WHOLE * float(weights[text_features(words)].sum()))
                above = _sigmoid(np.array(latent)[:, None] - model["cuts"][None, :])
                grades, tails = above.sum(1), above[:, SELECT_GRADE - 1]
            arrays = [batch.column(0), pa.array(np.round(grades, 6)), pa.array(np.round(tails, 6))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "expected_grade", "tail_probability"])

    scored = arrow(source, run, f"_id {kind}, expected_grade double, tail_probability double")
    return scored.select(
        F.col("_id").alias(id_col), "expected_grade", "tail_probability", (F.col("tail_probability") >= SELECT_AT).alias("selected")
    )


def graded(labels: DataFrame) -> Column:
    """Grade of a label row: low quality 0, good but toxic 1, good 2."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def ordinal_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, fit(labelled_sample(docs, labels, graded(labels), id_col, text_col)), id_col, text_col)
