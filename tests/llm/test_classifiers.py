import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ordinal_quality as O
from sparkloom.llm import toxicity as T


def corpus(n=900):
    rng = random.Random(8)
    syllables = ["ban", "del", "tor", "mi", "lu", "sen", "ka", "ro"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(20, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grumblewort", "sneerface", "blightling", "oafish"]))
        low = i % 5 == 1
        if low:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w), 0 if low else 1, int(toxic)))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t, _, _ in rows] + [(5000, None, "s"), (5001, "", "s"), (None, "ban del", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_toxicity_on_held_out_rows(frames):
    docs, labels, rows = frames
    out = T.toxicity(docs, labels)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows) + 3
    away = [(i, x) for i, _, _, x in rows if T.held_out(i)]
    assert all(got[i].held_out == T.held_out(i) for i, *_ in rows)
    hit = sum(got[i].predicted for i, x in away if x)
    assert hit >= 0.9 * sum(x for _, x in away) and sum(got[i].predicted for i, x in away if not x) <= 0.02 * len(away)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[5000].score == got[5001].score


def test_toxicity_never_trains_on_held_out_rows(frames):
    docs, labels, _ = frames
    assert not any(T.held_out(r[0]) for r in T.labelled_sample(docs, labels))
    kept = T.without_toxic(docs, T.fit(T.labelled_sample(docs, labels)))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_toxicity_without_labels(frames):
    docs, labels, _ = frames
    assert {r.score for r in T.toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert {r.score for r in T.toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert T.toxicity(docs.where("false"), labels).count() == 0


def test_advantages_match_plain_lengths():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5)).encode()
    ordinary, toxic = b" ".join(word() for _ in range(400)), [b" ".join(word() for _ in range(40)) for _ in range(3)]
    words = [rng.choice([*toxic[k % 3].split(), word()]) for k in range(60)]
    for but in (-1, 1):
        want = []
        for k in range(len(words) - 3):
            window = b" " + b" ".join(words[k : k + 4]) + b" "
            size = lambda content: len(T._compressor(content).compress(window))  # noqa: B023, E731
            gain = min(size(ordinary) - size(ordinary + t) for j, t in enumerate(toxic) if j != but)
            if gain > 0:
                want.append((window, gain))
        assert T.View(4, 1, ordinary, toxic).advantages(words, but) == want
        assert set(T.View(4, 5, ordinary, toxic).advantages(words, but)) <= set(want)
    assert list(T.windows([], 3)) == [] and list(T.windows([b"a", b"b", b"c"], 2)) == [b" a b ", b" b c "] and list(T.windows([b"a"], 3)) == [b" a "] and len(list(T.windows([b"a"] * 5, 3))) == 3


def test_classifiers_on_clashing_columns_long_texts_and_repeats(spark, frames):
    docs, labels, _ = frames
    long = "grumblewort ban del tor " * 20_000
    extra = docs.union(spark.createDataFrame([(7000, long, "s"), (7000, long, "s")], docs.schema))
    for name in ("held_out", "_text", "predicted", "_toxic", "removed"):
        extra = extra.withColumn(name, F.lit(1))
    got = [r for r in T.toxicity(extra, labels).collect() if r.doc_id == 7000]
    assert len(got) == 2 and got[0] == got[1]
    kept = T.without_toxic(extra, T.fit(T.labelled_sample(extra, labels)))
    assert kept.columns == extra.columns and kept.count() <= extra.count() - 2
    assert not any(len(r[1] or "") > T.MAX_CHARS for r in T.labelled_sample(extra, labels.union(spark.createDataFrame([(7000, 1, 1)], labels.schema))))
    graded = [r for r in O.ordinal_quality(extra.drop("predicted"), labels).collect() if r.doc_id == 7000]
    assert len(graded) == 2 and graded[0] == graded[1]


def test_toxicity_on_the_labelled_documents(spark):
    """Held-out rows of real size; rows of languages with a handful of toxic labels are the ones that are missed."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    true = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in T.toxicity(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), labels).collect()}
    away = {i for i in got if T.held_out(i)}
    toxic = {i for i in away if true[i]}
    caught = {i for i in away if got[i].predicted}
    assert len(caught & toxic) >= 0.65 * len(toxic) and len(caught & toxic) >= 0.88 * len(caught)


def test_ordinal_grades(frames):
    docs, labels, rows = frames
    got = {r.doc_id: r for r in O.ordinal_quality(docs, labels).collect()}
    away = [(i, q, x) for i, _, q, x in rows if O.held_out(i)]
    mean = lambda pick: np.mean([got[i].expected_grade for i, q, x in away if pick(q, x)])
    assert mean(lambda q, x: q == 0) < mean(lambda q, x: q and x) < mean(lambda q, x: q and not x)
    clean = [got[i].selected for i, q, x in away if q and not x]
    junk = [got[i].selected for i, q, _ in away if q == 0]
    assert np.mean(clean) >= 0.95 and np.mean(junk) <= 0.05
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got.values()) and len(got) == len(rows) + 3


def test_ordinal_tails_are_ordered_and_fit_ignores_row_order(frames):
    _, _, rows = frames
    data = [(i, t, 0 if q == 0 else 1 if x else 2) for i, t, q, x in rows[:200]]
    a, b = O.fit(data), O.fit(data[::-1])
    assert a["cuts"][0] < a["cuts"][1] and np.array_equal(a["weights"], b["weights"])
    assert O.fit([]) == {"mean": 0.0, "tail": 0.0} and O.fit(data[:1])["mean"] == data[0][2]


def test_ordinal_empty(frames):
    docs, labels, _ = frames
    assert O.ordinal_quality(docs.where("false"), labels).count() == 0
    assert {r.expected_grade for r in O.ordinal_quality(docs, labels.where("false")).collect()} == {0.0}
