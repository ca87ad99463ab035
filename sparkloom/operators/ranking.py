"""Exact ranking: cosine top k, BM25, and their fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkloom.functions.text import tokens
from sparkloom.storage import table

K1, B, TOP_K, ALPHA, THRESHOLD = 1.5, 0.75, 5, 0.65, 0.25
#: Scores are compared at this many digits, so that equal sums in another order tie.
DIGITS = 9
#: Queries sent to every executor at once; more go through in blocks.
BLOCK = 2000
#: Questions in a block of the lexical search, and cells of a matrix of chunks by terms.
ASKED, _CELLS = 500, 4_000_000


def _top(scored: DataFrame, query: str, order: str, k: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(order))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sortable(value):
    """A value of any type in Spark's order: null first, structs by their fields."""
    if value is None:
        return (0,)
    return (1, tuple(map(_sortable, value.values())) if isinstance(value, dict) else value)


def _places(orders: pa.Array) -> np.ndarray:
    """Numbers in the order of the values."""
    if pa.types.is_integer(orders.type) and not orders.null_count:
        return orders.to_numpy()
    keys = [_sortable(v) for v in orders.to_pylist()]
    out = np.empty(len(keys), np.int64)
    out[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    return out


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length to (places, matrix) of the vectors that have it; those that are null or hold a null have no product and are left out."""
    lengths = pc.list_value_length(vectors)
    flat = vectors.flatten()
    lengths = lengths.fill_null(-1).to_numpy()
    if flat.null_count:
        owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
        broken = np.unique(owner[flat.is_null().to_numpy(zero_copy_only=False)])
    else:
        broken = np.empty(0, np.int64)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    whole = lengths.copy()
    whole[broken] = -1
    out = {}
    for n in np.unique(whole[whole >= 0]):
        at = np.flatnonzero(whole == n)
        same = len(at) == len(lengths)
        out[int(n)] = at, values.reshape(len(at), n) if same else values[starts[at][:, None] + np.arange(n)]
    return out


def _best_of(names: list, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int, query_kind: pa.DataType):
    """For ``mapInArrow`` over (key, order, vector): the best ``k`` of a partition for each query, a run of rows at a time.

    A product of matrices says which pairs may count; these are then summed term by term as ``dot`` does, so scores do not
    depend on how the product is cut. Memory: one run of scores, and ``k`` rows a query.
    """
    slack = 10.0 ** (1 - DIGITS)

    def best(batches):
        floor = np.full(len(names), -np.inf)
        col, score, keys, orders = np.empty(0, np.int64), np.empty(0), None, None
        run = max(k, _CELLS // max(1, len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows if names else 0, run):
                rows = batch.slice(at, run)
                near = np.full((rows.num_rows, len(names)), -np.inf)
                given = _by_length(rows.column(2))
                for n, (r, m) in given.items():
                    if n in asked:
                        c, q = asked[n]
                        near[np.ix_(r, c)] = np.nan_to_num(m @ q.T, nan=np.inf, posinf=np.inf, neginf=-np.inf)
                least = floor
                if rows.num_rows > k:
                    least = np.maximum(floor, np.partition(near, -k, axis=0)[-k])
                r, c = np.nonzero(near >= np.where(least < np.inf, least - slack * (1 + np.abs(np.where(np.isfinite(least), least, 0))), least))
                if not len(r):
                    continue
                exact = np.full(len(r), np.nan)
                null = np.ones(len(r), bool)
                for n, (places, m) in given.items():
                    if n in asked:
                        row_at, col_at = np.full(rows.num_rows, -1), np.full(len(names), -1)
                        row_at[places], col_at[asked[n][0]] = np.arange(len(places)), np.arange(len(asked[n][0]))
                        mine = np.flatnonzero((row_at[r] >= 0) & (col_at[c] >= 0))
                        a, b, total = row_at[r[mine]], col_at[c[mine]], np.zeros(len(mine))
                        for j in range(n):
                            total += m[a, j] * asked[n][1][b, j]
                        exact[mine], null[mine] = total, False
                # a score of null is held as -inf, one of NaN as it is
                exact[null] = -np.inf
                picked = pa.array(r)
                col, score = np.concatenate([col, c]), np.concatenate([score, exact])
                keys = rows.column(0).take(picked) if keys is None else pa.concat_arrays([keys, rows.column(0).take(picked)])
                orders = rows.column(1).take(picked) if orders is None else pa.concat_arrays([orders, rows.column(1).take(picked)])
                shown = np.nan_to_num(np.round(score, DIGITS), nan=np.inf, posinf=np.inf, neginf=-np.inf)
                sort = np.lexsort((_places(orders), -shown, col))
                first = np.searchsorted(col[sort], np.arange(len(names)))
                stays = sort[np.arange(len(sort)) - first[col[sort]] < k]
                col, score, shown, keys, orders = col[stays], score[stays], shown[stays], keys.take(pa.array(stays)), orders.take(pa.array(stays))
                full = np.bincount(col, minlength=len(names)) >= k
                lowest = np.full(len(names), np.inf)
                np.minimum.at(lowest, col, shown)
                floor = np.where(full, lowest, -np.inf)
        if keys is not None:
            shown = pa.array(score, pa.float64(), mask=score == -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in col], query_kind), keys, orders, shown], names=["_q", "_k", "_o", "score"])

    return best


def cosine_topk(
    queries: DataFrame, vectors: DataFrame, query: str, key: str, k: int = TOP_K,
    order: str | None = None, query_vector: str = "embedding", vector: str = "embedding",
) -> DataFrame:
    """``query, key, score, rank``: the ``k`` vectors of largest dot product for each query.

    Exact: a stated set of queries is held against every vector where it lies, as a product of two matrices. Queries are
    sent out in blocks of ``BLOCK``; each partition of vectors keeps its own best ``k`` before anything is shuffled. Ties keep ``order``.
    """
    order = order or key
    asked = table(queries.select(F.col(query).alias("_q"), F.col(query_vector).alias("_qv")))
    rows = vectors.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(vector).alias("_v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    rows = table(rows) if blocks > 1 else rows
    schema = StructType([asked.schema["_q"], rows.schema["_k"], rows.schema["_o"], StructField("score", DoubleType())])
    kind = to_arrow_type(asked.schema["_q"].dataType)
    parts = []
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == i).collect()  # about BLOCK queries
        held = _by_length(pa.array([r["_qv"] for r in block], pa.list_(pa.float64())))
        scored = rows.mapInArrow(_best_of([r["_q"] for r in block], held, k, kind), schema)
        parts.append(_top(scored.withColumn("score", F.round("score", DIGITS)), "_q", "_o", k))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.col("_q").alias(query), F.col("_k").alias(key), "score", "rank")


class BM25:
    """Index over chunks, written once: ``docs(key, order, terms, length)`` and ``idf(term, df, idf)``; ``postings`` on demand."""

    def __init__(self, chunks: DataFrame, key: str = "chunk_id", text: str = "text", order: str = "doc_ord", k1: float = K1, b: float = B) -> None:
        self.key, self.order, self.k1, self.b = key, order, k1, b
        words = chunks.select(F.col(key).alias("_k"), F.col(order).alias("_o"), tokens(F.col(text)).alias("_t"))
        self.docs = table(words.withColumn("length", F.size("_t")))
        self.stats = self.docs.agg(F.count("*").alias("n"), F.avg("length").alias("avg_len"))
        self.idf = self._idf_of()

    def _idf_of(self, terms: DataFrame | None = None) -> DataFrame:
        """``term, df, idf`` of all terms, or of ``terms`` only, without counting the others."""
        each = self.docs.select(F.explode(F.array_distinct("_t")).alias("term"))
        each = each if terms is None else each.join(terms, "term", "left_semi")
        df = each.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(self.stats))
        return df.select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    @property
    def postings(self) -> DataFrame:
        return self.docs.select("_k", F.explode("_t").alias("term")).groupBy("_k", "term").agg(F.count("*").alias("tf"))

    def search(self, queries: DataFrame, query: str = "q", text: str = "text", k: int = TOP_K) -> DataFrame:
        """``query, key, score, rank``: a query's repeats of a term count, chunks without any of its terms score zero.

        Exact: a stated set of queries, in blocks of ``ASKED``, is held against every chunk where it lies. A block's terms by its
        queries make one matrix, a run of chunks by these terms another, and their product
        all scores; each run keeps its own best ``k`` a query before anything is shuffled, and no posting
        list is ever gathered. Zero-score chunks are only brought in for queries
        with fewer than ``k`` hits, from the first ``k`` chunks in order that each query left out.
        """
        asked = table(queries.select(F.col(query).alias("_q"), F.explode(tokens(F.col(text))).alias("term")).groupBy("_q", "term").agg(F.count("*").alias("m")))
        weighed = table(asked.join(self._idf_of(asked.select("term").distinct()), "term").select("_q", "term", "m", "idf"))
        blocks = max(1, -(-queries.count() // ASKED))
        mean = self.stats.first()["avg_len"] or 1.0
        hits = None
        for i in range(blocks):
            block = weighed.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == i).collect()  # the terms of about ASKED queries
            found = self._scored(block, weighed.schema["_q"].dataType, mean, k)
            hits = found if hits is None else hits.union(found)
        top = table(_top(hits, "_q", "_o", k))
        found = top.groupBy("_q").agg(F.count("*").alias("have"))
        short = queries.select(F.col(query).alias("_q")).join(found, "_q", "left").where(F.coalesce("have", F.lit(0)) < k)
        # at most k of a query's hits can stand among the first 2k chunks without filling its list
        first = self.docs.orderBy("_o").limit(2 * k).select("_k", "_o")
        zero = short.select("_q").crossJoin(F.broadcast(first)).join(top.select("_q", "_k"), ["_q", "_k"], "left_anti").withColumn("score", F.lit(0.0))
        return _top(top.drop("rank").unionByName(zero), "_q", "_o", k).select(
            F.col("_q").alias(query), F.col("_k").alias(self.key), "score", "rank"
        )

    def _scored(self, block: list, query_type, mean: float, k: int) -> DataFrame:
        """``_q, _k, _o, score``: the best ``k`` chunks of each run for the queries of a block."""
        names = sorted({r["_q"] for r in block})
        terms = {t: i for i, t in enumerate(sorted({r["term"] for r in block}))}
        place = {q: i for i, q in enumerate(names)}
        asked = np.zeros((len(terms), len(names)))
        for r in block:
            asked[terms[r["term"]], place[r["_q"]]] = r["m"] * r["idf"]
        given = self.docs.sparkSession.sparkContext.broadcast((names, terms, asked))
        k1, b, run = self.k1, self.b, max(1, _CELLS // max(1, len(terms)))

        def best(batches):
            names, terms, asked = given.value
            for batch in batches:
                for at in range(0, batch.num_rows if names else 0, run):
                    rows = batch.slice(at, run)
                    keys, orders, tokens_, lengths = rows.columns
                    weights = np.zeros((rows.num_rows, len(terms)))
                    words = tokens_.flatten()
                    found = pc.index_in(words, value_set=pa.array(list(terms), words.type)).fill_null(-1).to_numpy()
                    owner = np.repeat(np.arange(rows.num_rows), pc.list_value_length(tokens_).to_numpy(zero_copy_only=False))
                    cell, tf = np.unique((owner * len(terms) + found)[found >= 0], return_counts=True)
                    norm = k1 * (1 - b + b * lengths.to_numpy() / mean)
                    weights.ravel()[cell] = tf * (k1 + 1) / (tf + norm[cell // max(1, len(terms))])
                    scores = np.round(weights @ asked, DIGITS)
                    order = np.array(orders.to_pylist(), object)
                    row, col = [], []
                    for q in range(len(names)):
                        s = scores[:, q]
                        least = max(np.partition(s, -k)[-k] if len(s) > k else 0.0, 0.0)
                        near = np.flatnonzero((s >= least) & (s > 0))
                        if len(near) > k:
                            near = near[sorted(range(len(near)), key=lambda j: (-s[near[j]], order[near[j]]))[:k]]
                        row.append(near)
                        col.append(np.full(len(near), q))
                    row, col = np.concatenate(row), np.concatenate(col)
                    picked = [pa.array([names[q] for q in col], query_kind), keys.take(pa.array(row)), orders.take(pa.array(row)), pa.array(scores[row, col])]
                    yield pa.RecordBatch.from_arrays(picked, names=["_q", "_k", "_o", "score"])

        query_kind = to_arrow_type(query_type)
        schema = StructType([StructField("_q", query_type), self.docs.schema["_k"], self.docs.schema["_o"], StructField("score", DoubleType())])
        return self.docs.mapInArrow(best, schema)


def min_max(scored: DataFrame, query: str, out: str) -> DataFrame:
    """Scores of each query scaled to 0..1; all equal gives 0."""
    w = Window.partitionBy(query)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn(out, F.when(high == low, 0.0).otherwise((F.col("score") - low) / (high - low)))


def fuse(semantic: DataFrame, lexical: DataFrame, query: str, key: str, alpha: float = ALPHA) -> DataFrame:
    """Both top lists blended: ``alpha`` times the first plus the rest of the second; a missing side is 0."""
    a = min_max(semantic, query, "_s").select(query, key, "_s")
    b = min_max(lexical, query, "_l").select(query, key, "_l")
    both = a.join(b, [query, key], "full_outer")
    score = alpha * F.coalesce("_s", F.lit(0.0)) + (1 - alpha) * F.coalesce("_l", F.lit(0.0))
    rows = both.select(query, key, F.round(score, DIGITS).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(key))
    return rows.withColumn("rank", F.row_number().over(w))


def confidence(queries: DataFrame, semantic: DataFrame, query: str, threshold: float = THRESHOLD) -> DataFrame:
    """``query, top_score, confident`` from the best cosine, whichever mode answers; nothing found is 0."""
    best = semantic.groupBy(query).agg(F.max("score").alias("_best"))
    top = F.coalesce("_best", F.lit(0.0))
    return queries.select(query).join(best, query, "left").select(query, top.alias("top_score"), (top >= threshold).alias("confident"))


def check_aligned(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> None:
    """An error if chunks and vectors do not name the same keys."""
    lone = chunks.select(key).join(vectors.select(key), key, "left_anti").limit(1).count()
    if lone or vectors.select(key).join(chunks.select(key), key, "left_anti").limit(1).count():
        raise ValueError("chunks and vectors name different keys; the index and the corpus have drifted apart")
