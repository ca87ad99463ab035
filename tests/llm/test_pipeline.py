from collections import Counter

import pytest

import corpus_pipeline as C
from sparkloom.llm import simhash as S
from sparkloom.llm import toxicity as T

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = [docs]
    for _, f in C.STAGES:
        found.append(C.table(f(spark, found[-1], sf)))
    return found


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_each_stage_keeps_the_columns(stages):
    assert [name for name, _ in C.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "source_mix", "sentencepiece"]
    for df in stages[:5]:
        assert df.columns == stages[0].columns


def test_toxicity_stage_drops_what_it_predicts(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = T.fit(T.labelled_sample(stages[0], labels))
    gone = {r.doc_id for r in T.score(stages[0], model).collect() if r.predicted}
    assert {r["doc_id"] for r in rows(stages[1])} == {r["doc_id"] for r in rows(stages[0])} - gone


def test_line_stage_keeps_documents(stages):
    before, after = ({r["doc_id"]: r for r in rows(df)} for df in stages[1:3])
    assert before.keys() == after.keys()
    assert all(len(after[i]["text"]) <= len(before[i]["text"]) and after[i]["n_chars"] == len(after[i]["text"]) for i in after)


def test_near_stage_keeps_the_first_of_each_group(stages):
    docs = rows(stages[2])
    fps = {r["doc_id"]: S.fingerprint(r["text"]) for r in docs}
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in sorted(fps):
            least = min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2)
            changed |= least < label[i]
            label[i] = min(least, label[i])
    assert sorted(r["doc_id"] for r in rows(stages[3])) == sorted(i for i in label if label[i] == i)


def test_mix_and_tokens(stages):
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in rows(stages[3])}
    taken = Counter(r["doc_id"] for r in rows(stages[4]))
    assert set(taken) <= {i for i, n in size.items() if n} and max(taken.values()) <= 3
    total = sum(size.values())
    assert abs(sum(size[i] * n for i, n in taken.items()) - total) <= 0.1 * total
    plain = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    texts = {r["doc_id"]: r["text"] for r in rows(stages[4])}
    out = rows(stages[5])
    assert Counter(r["doc_id"] for r in out) == taken
    assert all(list(r["ids"]) == plain.encode(texts[r["doc_id"]]) and r["round_trip"] for r in out)
