import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import chunking as C
from sparkloom.operators.ordinals import dense_order
from sparkloom.sources.corpus import load_corpus


def one(spark, make, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(make(F.col("t"))).collect()]


def test_sentences(spark):
    got = one(
        spark, T.sentences,
        'Dr. A met\nB. "Hi." Then e.g. this! (Ok.)', "Call Mr. Dr. X. now", "No! yes. tail", "a\n\n \n\nb. c", None, "", "x Inc... y. z", "..Dr. X is. Y",
    )
    assert got == [
        ["Dr. A met B.", '"Hi."', "Then e.g. this!", "(Ok.)"], ["Call Mr. Dr. X.", "now"], ["No! yes.", "tail"], ["a", "b.", "c"], [], [], ["x Inc... y.", "z"],
        ["..Dr. X is.", "Y"],
    ]


def two_passes(text):
    """Sentences as their SQL has them: spaces behind abbreviations are held by two passes, then the others cut."""
    held = F.regexp_replace(F.regexp_replace(T.collapse(text), T.AFTER_SHORT, "$1$2$3\u0002"), T.AFTER_SHORT, "$1$2$3\u0002")
    cut = F.translate(F.regexp_replace(held, T.AFTER_END, "$1\u0001"), "\u0002", " ")
    return F.filter(F.split(cut, "\u0001"), lambda s: s != "")


def test_sentences_are_those_of_the_two_passes(spark):
    dice = random.Random(3)
    parts = [*T.ABBREVIATIONS, ".", ".", "..", "!", "?", " ", " ", " ", '"', ")", "]", "(", "x", "é", "中", "\u0001", "\u0002", "\u0085"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 20))) for _ in range(5000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~T.sentences(F.col("t")).eqNullSafe(two_passes(F.col("t")))).count() == 0


def test_sentences_cost_few_plain_passes(spark):
    df = spark.createDataFrame([("word and word then Word no. " * 800,)], "t string").crossJoin(spark.range(200)).repartition(4).cache()
    df.count()

    def seconds(c):
        began = time.perf_counter()
        df.select(F.sum(F.length(c))).collect()
        return time.perf_counter() - began

    least = lambda c: min(seconds(c) for _ in range(3))
    assert least(F.array_join(T.sentences(F.col("t")), "")) < 4 * least(T.collapse(F.col("t")))
    df.unpersist()


def test_first_sentence_reads_on_only_if_the_first_paragraph_has_none(spark):
    df = spark.createDataFrame([("A b. C.\n\nD.",), ("\u0001\n\nD. E.",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.first_sentence(F.col("t"), F.lit("title"))).collect()] == ["A b.", "D.", "title", "title"]


def test_terms_and_stems(spark):
    assert sorted(one(spark, T.terms, "Who fixed BUG-903 in the service?")[0]) == ["bug-903", "fixed", "service"]
    assert one(spark, lambda c: F.transform(F.split(c, " "), T.stem), "rotation services service policies keys does relations") == [
        ["rotat", "servic", "service", "polic", "keys", "does", "relat"]
    ]
    assert one(spark, T.tokens, "A-b b2, É3", None) == [["a", "b", "b2", "3"], []]


def test_slug_links_readable(spark):
    assert one(spark, T.slug, "  Who Owns: What? ") == ["who-owns-what"]
    assert one(spark, T.links, "[[A]] [[B]] [[A]] [[]]") == [["A", "B"]]
    assert one(spark, T.readable, "- a\n- b", "x\n- b", "") == ["a\n\nb", "x\n- b", ""]
    assert one(spark, lambda c: T.estimate_tokens(F.array(c, c)), "abcdefg") == [3]


def chunks(spark, body, **cfg):
    df = spark.createDataFrame([("d", "T", body, 0)], "doc_id string, title string, body string, doc_ord long")
    return [(r.chunk_id, r.text) for r in C.chunk_documents(df, cfg).orderBy("n").collect()]


def test_chunking(spark):
    assert [t for _, t in chunks(spark, "One.\ntwo.\n\nSecond.\n\n\nThird.", strategy="paragraph")] == ["One.\ntwo.", "Second.", "Third."]
    got = chunks(spark, "One. Two. Three. Four. Five.", strategy="sentence_window")
    assert got == [("d#0", "One. Two. Three."), ("d#1", "Three. Four. Five.")]
    assert [t for _, t in chunks(spark, "abcdefghij", strategy="fixed", size=4, overlap=1)] == ["abcd", "defg", "ghij"]
    assert chunks(spark, "", strategy="sentence_window") == [] == chunks(spark, "", strategy="fixed")
    with pytest.raises(ValueError, match=r"overlap \(4\).*size \(4\)"):
        chunks(spark, "abc", strategy="fixed", size=4, overlap=4)
    with pytest.raises(ValueError, match="unknown chunking strategy 'page'"):
        chunks(spark, "abc", strategy="page")


def test_corpus_files(spark, tmp_path):
    (tmp_path / "svc-x.txt").write_text("X Service\nbanner\nLast updated: 2024-01-02\r\n\r\nFirst line.\nSecond.\n")
    (tmp_path / "arch-a.txt").write_text("Arch\n\n body \n")
    (tmp_path / "bug-1.txt").write_text("Only a header")
    rows = [(r.doc_id, r.title, r.doc_type, str(r.date), r.body, r.doc_ord) for r in load_corpus(spark, str(tmp_path)).orderBy("doc_ord").collect()]
    assert rows == [
        ("arch-a", "Arch", "reference", "None", "body", 0), ("bug-1", "Only a header", "bug", "None", "", 1),
        ("svc-x", "X Service", "service", "2024-01-02", "First line.\nSecond.", 2),
    ]
    (tmp_path / "odd-1.txt").write_text("T\n\nb")
    with pytest.raises(Exception, match="odd-1: unknown prefix 'odd'"):
        load_corpus(spark, str(tmp_path)).collect()


def test_dense_order(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int")
    assert [(r.k, r.n) for r in dense_order(df, "n", "k").collect()] == [(i, i) for i in range(101)] or sorted(
        (r.k, r.n) for r in dense_order(df, "n", "k").collect()
    ) == [(i, i) for i in range(101)]
