import random

import pytest

from sparkloom.llm import pieces as P

sentencepiece = pytest.importorskip("sentencepiece")
BITS = ["a", "b", "e", "n", "t", "h", "i", "o", "r", " ", "  ", "   ", "\n", "\t", "é", "中", "文", "①", "𝄞", ".", "the", "ing", "1", "▁", "\x00", " "]


@pytest.fixture(scope="module")
def plain():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


@pytest.fixture(scope="module")
def codec():
    return P.Codec(P.load())


def texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(plain, codec):
    for t in texts(1500, 40, 1):
        ids = list(codec.encode(t))
        assert ids == plain.encode(t)
        assert codec.decode(ids) == plain.decode(ids)


def test_long_stretches(plain, codec):
    rng = random.Random(2)
    for n in (63, 64, 65, 300, 2000):
        t = "".join(rng.choice("etaoinshr") for _ in range(n))
        assert list(codec.encode(t)) == plain.encode(t)


def test_products_are_associative_and_chunks_meet(plain, codec):
    rng = random.Random(3)
    for t in texts(150, 80, 4):
        if not t:
            continue
        s, size = P.MARK + t.replace(" ", P.MARK), rng.choice([3, 9, 20])
        ends = [min(at + size, len(s)) for at in range(0, len(s), size)]
        ms = [codec.matrix(s, at, e, at == 0, e == len(s)) for at, e in zip(range(0, len(s), size), ends)]
        left = right = None
        for m in ms:
            left = m if left is None else P.product(left, m)
        for m in reversed(ms):
            right = m if right is None else P.product(m, right)
        assert left == sorted(right) or sorted(left) == sorted(right)
        assert len(left) == 1
        states, ids = P.states_within(ms, left[0][:2], left[0][2:]), []
        for (s0, e0), (s1, e1) in zip(states, states[1:]):
            if (s0, e0) != (s1, e1):
                ids += codec.ids_of([*codec.trace(s, e0, s1, s[s0:e0] or None, s[s1:e1]), s[s1:e1]])
        assert ids == plain.encode(t)


@pytest.mark.parametrize("fan", [2, 32])
def test_giants_in_spark(spark, plain, fan):
    rows = [(i, t, "x") for i, t in enumerate(texts(60, 120, 5))]
    rows += [(900, None, "x"), (901, "", "x"), (None, "a" * 70 + " the end " * 9, "x"), (3, rows[3][1], "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = P.encode(df, chunk=30, fan=fan)
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
    got = sorted(((r.doc_id, list(r.ids), r.n_tokens, r.round_trip) for r in out.collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = plain.encode(t or "")
        want.append((i, ids, len(ids), plain.decode(ids) == (t or "")))
    assert got == sorted(want, key=str)


def test_decode_frame_and_empty(spark, plain):
    df = spark.createDataFrame([(1, plain.encode("Hello  wörld\n①")), (2, None), (3, [])], "k long, ids array<int>")
    assert {r.k: r.text for r in P.decode(df).collect()} == {1: "Hello  wörld\n①", 2: None, 3: ""}
    assert P.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
