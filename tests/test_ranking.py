import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions.vectors import dot, l2_normalise
from sparkloom.operators import embedding as E
from sparkloom.operators import ranking as R

CHUNKS = [("a#0", "a", "red ember blue", 0), ("b#0", "b", "green", 1), ("c#0", "c", "ember ember", 2)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, text string, doc_ord long")


def test_cosine(spark):
    v = spark.createDataFrame([("c1", 0, [1.0, 0.0]), ("c2", 1, [0.0, 1.0]), ("c3", 2, [0.7071068, 0.7071068])], "id string, ord int, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "q string, embedding array<double>")
    got = [(r.id, round(r.score, 6)) for r in R.cosine_topk(q, v, "q", "id", 2, order="ord").orderBy("rank").collect()]
    assert got == [("c1", 1.0), ("c3", 0.707107)]


def by_pairs(q, v, k, order):
    """The search by its definition: every pair by a cross join."""
    each = q.select("q", F.col("embedding").alias("a")).crossJoin(v)
    scored = each.select("q", "id", order, F.round(dot(F.col("a"), F.col("embedding")), R.DIGITS).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc(order)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "id", "score", "rank")


@pytest.mark.parametrize("order", ["id", "name"])
def test_cosine_equals_all_pairs_with_ties_nulls_and_ragged_vectors(spark, monkeypatch, order):
    dice = random.Random(1)

    def vector():
        n = 4 if dice.random() < 0.9 else dice.choice([None, 0, 3])
        return n if n is None else [None if dice.random() < 0.01 else dice.choice([0.0, 0.5, dice.random()]) for _ in range(n)]

    v = spark.createDataFrame([(i, f"{i % 10}-{i}", vector()) for i in range(600)], "id long, name string, embedding array<float>").repartition(3)
    q = v.where("id % 20 = 0").select(F.col("id").alias("q"), "embedding")
    monkeypatch.setattr(R, "BLOCK", 11)  # several blocks of queries, and runs of rows shorter than a batch
    monkeypatch.setattr(R, "_CELLS", 1000)
    got, want = R.cosine_topk(q, v, "q", "id", 5, order=order), by_pairs(q, v, 5, order)
    assert got.count() == 150 and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_cosine_makes_no_row_for_each_pair(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, embedding array<double>")
    plan = R.cosine_topk(v.withColumnRenamed("id", "q"), v, "q", "id", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_bm25_search_counts_only_the_terms_asked(spark, chunks, monkeypatch):
    weighed = []
    monkeypatch.setattr(R.BM25, "_idf_of", lambda self, terms=None, make=R.BM25._idf_of: weighed.append(terms) or make(self, terms))
    R.BM25(chunks).search(spark.createDataFrame([(1, "ember zzz")], "q int, text string"), k=3).collect()
    assert sorted(r.term for r in weighed[-1].collect()) == ["ember", "zzz"]


def test_bm25_scores_and_zero_fill(spark, chunks):
    q = spark.createDataFrame([(1, "ember EMBER"), (2, "nothing"), (3, "green ember")], "q int, text string")
    got = {}
    for r in R.BM25(chunks).search(q, k=3).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.chunk_id, round(r.score, 6)))
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)

    def w(tf, n):
        return idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2))

    assert got[1] == [("c#0", round(2 * w(2, 2), 6)), ("a#0", round(2 * w(1, 3), 6)), ("b#0", 0.0)]
    assert got[2] == [("a#0", 0.0), ("b#0", 0.0), ("c#0", 0.0)]
    assert len(got[3]) == 3


def hits(spark, rows):
    return spark.createDataFrame([("q", k, s) for k, s in rows], "q string, id string, score double")


@pytest.mark.parametrize("alpha, want", [(1.0, [("a", 1.0), ("b", 0.0)]), (0.0, [("b", 1.0), ("a", 0.0)]), (0.5, [("a", 0.5), ("b", 0.5)])])
def test_fuse(spark, alpha, want):
    got = R.fuse(hits(spark, [("a", 1.0), ("b", 0.0)]), hits(spark, [("a", 0.0), ("b", 4.0)]), "q", "id", alpha)
    assert [(r.id, r.score) for r in got.orderBy("rank").collect()] == want


def test_fuse_keeps_the_union_and_flat_sides_are_zero(spark):
    got = R.fuse(hits(spark, [("a", 3.0)]), hits(spark, [("b", 2.0)]), "q", "id")
    assert [(r.id, r.score) for r in got.orderBy("rank").collect()] == [("a", 0.0), ("b", 0.0)]


def test_confidence(spark):
    q = spark.createDataFrame([("q",), ("r",)], "q string")
    got = {r.q: (r.top_score, r.confident) for r in R.confidence(q, hits(spark, [("a", 0.25)]), "q").collect()}
    assert got == {"q": (0.25, True), "r": (0.0, False)}


def test_drift(spark, chunks):
    R.check_aligned(chunks, chunks)
    with pytest.raises(ValueError, match="drifted"):
        R.check_aligned(chunks, chunks.where("chunk_id != 'a#0'"))


@pytest.mark.parametrize("digest", ["md5", "blake2b"])
def test_hash_embedding(spark, chunks, digest):
    rows = chunks.select("chunk_id", "text").union(spark.createDataFrame([("z", "--")], "chunk_id string, text string"))
    got = {r.chunk_id: r.embedding for r in E.hash_embed(rows, ["chunk_id"], "text", 16, digest).collect()}
    assert all(len(v) == 16 for v in got.values()) and sum(got["z"]) == 0
    assert all(abs(math.sqrt(sum(x * x for x in v)) - 1) < 1e-9 for k, v in got.items() if k != "z")
    assert max(got["c#0"]) == 1.0


def test_a_word_is_hashed_once_a_batch(spark, monkeypatch):
    made = E.blake_buckets(F.col("w"), 16)
    rows = spark.createDataFrame([(["a", "b", "a"],), ([],), (["b"] * 3,)], "w array<string>").coalesce(1)
    want = [int.from_bytes(E.hashlib.blake2b(w, digest_size=8).digest(), "big") % 16 for w in (b"a", b"b")]
    assert [r[0] for r in rows.select(made).collect()] == [[want[0], want[1], want[0]], [], [want[1]] * 3]
    asked = []
    monkeypatch.setattr(E.hashlib, "blake2b", lambda w, digest_size, real=E.hashlib.blake2b: asked.append(w) or real(w, digest_size=digest_size))
    monkeypatch.setattr(E.F, "arrow_udf", lambda kind: lambda f: lambda c: f(c))
    assert E.blake_buckets(pa.array([["a", "b", "a"], ["a"]]), 16).to_pylist() == [[want[0], want[1], want[0]], [want[0]]] and sorted(asked) == [b"a", b"b"]


def test_normalising_computes_the_length_once(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert [r[0] for r in v.select(l2_normalise(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    long = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda x: x.cast("double")).alias("v")).cache()
    long.count()
    began = time.perf_counter()
    long.select(F.sum(F.size(l2_normalise(F.col("v"))))).collect()
    long.agg(F.sum(l2_normalise(F.col("v"))[7])).collect()
    assert time.perf_counter() - began < 5  # 4000 * 4000 steps a row took minutes


def test_svd_matches_numpy_over_the_whole_vocabulary(spark):
    rng = np.random.default_rng(4)
    topics = [[f"t{k}w{i}" for i in range(25)] for k in range(6)]
    docs = [(i, " ".join(rng.choice(topics[i % 6], 30)) + f" only{i}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = E.TfidfSvd(6).fit(df, "doc_id", "text")
    got = {r.doc_id: np.array(r.embedding) for r in model.encode(df, "doc_id", "text").collect()}
    weights, _ = E.tfidf(df, "doc_id", "text")
    rows = weights.collect()
    terms = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    assert model.terms.count() == len(terms) > 200  # no term is left out, however rare
    a = np.zeros((60, len(terms)))
    for r in rows:
        a[r.doc_id, terms[r.term]] = r.weight
    plain = a @ np.linalg.svd(a, full_matrices=False)[2][:6].T
    plain /= np.linalg.norm(plain, axis=1)[:, None]
    mine = np.array([got[i] for i in range(60)])
    assert np.abs(mine @ mine.T - plain @ plain.T).max() < 0.02
    assert not np.any(model.encode(spark.createDataFrame([(1, "zzz")], "doc_id long, text string"), "doc_id", "text").first().embedding)


def test_svd_and_factory(spark, chunks):
    m = E.build_embedder({"backend": "tfidf-svd", "dim": 50}, chunks)
    got = {r.chunk_id: r.embedding for r in m.encode(chunks, "chunk_id", "text").collect()}
    assert m.dim == 2 and set(got) == {"a#0", "b#0", "c#0"} and all(len(v) == 2 for v in got.values())
    with pytest.warns(RuntimeWarning, match="falling back"):
        assert isinstance(E.build_embedder({"backend": "sentence-transformers", "dim": 4}, chunks), E.TfidfSvd)
    with pytest.raises(ValueError, match="unknown embedding backend"):
        E.build_embedder({"backend": "x"})
    with pytest.raises(ValueError, match="fitted on the corpus"):
        E.build_embedder({"backend": "tfidf-svd"})


@pytest.mark.parametrize("held", [5, 1000])
def test_tfidf_by_blocks_with_a_key_met_twice(spark, monkeypatch, held):
    monkeypatch.setattr(E, "HELD", held)
    texts = [(i % 29, f"word{i % 7} the word{i % 3} x only{i} word{i % 7}") for i in range(30)] + [(40, ""), (41, "the of")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    weights, idf = E.tfidf(df, "doc_id", "text")
    bags = {}
    for k, t in texts:
        for w in (w for w in t.split() if len(w) > 1 and w != "the" and w != "of"):
            bags.setdefault(k, {}).setdefault(w, 0)
            bags[k][w] += 1
    count = {}
    for bag in bags.values():
        for w in bag:
            count[w] = count.get(w, 0) + 1
    known = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in count.items()}
    assert {r.term: round(r.idf, 9) for r in idf.collect()} == {w: round(x, 9) for w, x in known.items()}
    want = {}
    for k, bag in bags.items():
        norm = math.sqrt(sum((n * known[w]) ** 2 for w, n in bag.items()))
        want |= {(k, w): round(n * known[w] / norm, 9) for w, n in bag.items()}
    assert {(r.doc_id, r.term): round(r.weight, 9) for r in weights.collect()} == want
    assert "Join" not in weights._jdf.queryExecution().optimizedPlan().toString()  # no row for each word of each document is matched


def test_svd_by_blocks_gives_the_fitted_what_encoding_gives(spark, monkeypatch):
    monkeypatch.setattr(E, "HELD", 60)
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice([f"t{i % 4}w{j}" for j in range(12)], 20)) + f" only{i} shared{i % 9}") for i in range(48)] + [(90, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).cache()
    model = E.TfidfSvd(4).fit(df, "doc_id", "text")
    own = {r.doc_id: np.array(r.embedding) for r in model.encode_fitted().collect()}
    made = {r.doc_id: np.array(r.embedding) for r in model.encode(df, "doc_id", "text").collect()}
    assert own.keys() == made.keys() and max(np.abs(own[k] - made[k]).max() for k in made) < 1e-8 and not own[90].any()
    df.unpersist()
