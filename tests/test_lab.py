import pytest
from pyspark.sql import functions as F

from sparkloom.plans import kg, lab, planner
from sparkloom.sources.config import load_config, load_ontology, load_questions, read_journal
from sparkloom.sources.corpus import load_corpus
from tests.test_knowledge import DOCS, ONTOLOGY


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lab")
    for doc, title, _, date, body in DOCS:
        stamp = f"\nLast updated: {date}" if date else ""
        (root / f"{doc}.txt").write_text(f"{title}{stamp}\n\n{body}\n")
    (root / "ontology.yaml").write_text(ONTOLOGY)
    (root / "config.yaml").write_text("embedding: {backend: hash, dim: 64}\nrag: {mode: hybrid}\nwiki: {topics: [{title: Left Over, summary: What no page tells., doc_types: [runbook]}]}\n")
    (root / "questions.yaml").write_text("questions:\n  - {q: 'Who fixed the bug in the service that Alder depends on?', expect: kg}\n  - {q: 'zzz'}\n")
    made = lab.Lab(spark, load_corpus(spark, str(root)), load_ontology(str(root / "ontology.yaml")), str(root / "build"), load_config(str(root / "config.yaml")))
    with pytest.raises(lab.ArtefactMissing, match="build it first"):
        made.edges()
    assert made.status() == {"documents": 6, "chunks": 0, "triples": 0, "pages": 0}
    stats = made.build_all("2024-06-01")
    return made, stats, load_questions(spark, str(root / "questions.yaml")), root


def test_builds(spark, built):
    made, stats, _, root = built
    assert [(s.approach, s.count) for s in stats] == [("rag", 7), ("kg", 7), ("wiki", made.status()["pages"])]
    assert lab.summary_table(stats).splitlines()[2].split()[:3] == ["kg", "triples", "7"]
    assert read_journal(spark, made.folder).where(F.col("value").contains("COMPILE")).count() == 1
    made.write_markdown(str(root / "md"))
    assert (root / "md" / "file=alder.md").is_dir()
    assert made.source("bug-7").first().title == "BUG-7: slow"
    assert {r.doc_id for r in made.of_type("bug", "policy").collect()} == {r.doc_id for r in made.corpus.where("doc_type in ('bug', 'policy')").collect()}
    assert made.shown_config()["rag_mode"] == "hybrid" and made.shown_config()["kg_max_hops"] == 4
    assert {r.check for r in made.lint().collect()} <= {"orphan_pages", "broken_links", "stale_pages", "superseded_refs"}


def test_asks_all_three(built):
    made, _, questions, _ = built
    got = {(r.q_id, r.approach): r for r in made.ask_all(questions).collect()}
    assert len(got) == 6 and got[0, "kg"].confident and not got[1, "wiki"].confident
    assert all(r.note for r in got.values() if not r.confident) and all(r.ms["total"] > 0 for r in got.values())


def test_one_broken_approach_leaves_the_others(built, monkeypatch):
    made, _, questions, _ = built

    def boom(_):
        raise ValueError("boom")

    monkeypatch.setattr(made, "ask_rag", boom)
    got = {(r.q_id, r.approach): r for r in made.ask_all(questions).collect()}
    assert "boom" in got[0, "rag"].note and got[0, "kg"].confident


def test_lit_path_is_made_of_real_edges(spark, built):
    made, _, questions, _ = built
    nodes = made.ontology.entity_frame(spark).select("name", "type")
    best = kg.candidates(planner.plan_questions(questions, made.ontology), nodes, made.edges())
    lit = lab.light_path(best.where("rank = 1"))
    assert lit.count() == 3 and lit.join(made.edges(), ["subject", "predicate", "object"], "left_anti").count() == 0


def test_cited_links(spark):
    row = spark.sql("select 'As told (bug-7) and (svc-x) and (bug-7).' p, array('bug-7', 'team-red') s")
    assert row.select(lab.cited_links(F.col("p"), F.col("s"))).first()[0] == ["bug-7"]
