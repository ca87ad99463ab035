"""Extraction, graph, planning, pages and checks on a small invented corpus."""

import pytest

from sparkloom.operators import extraction as X
from sparkloom.operators import graph as G
from sparkloom.operators.ontology import Ontology, mention_spans
from sparkloom.plans import answers, compiler, generate, kg, lint, pages, planner, wiki
from sparkloom.storage import table

ONTOLOGY = """
entity_types: {Service: {}, Person: {}, Team: {}, Bug: {}, Policy: {}}
entities:
  - {name: Alder, type: Service, aliases: [Alder Gateway]}
  - {name: Birch, type: Service, aliases: []}
  - {name: Red Team, type: Team, aliases: []}
  - {name: Ada Quill, type: Person, aliases: [Ada, Dr. Ada Quill]}
  - {name: BUG-7, type: Bug, aliases: []}
  - {name: Rule v1, type: Policy, aliases: [v1]}
  - {name: Rule v2, type: Policy, aliases: [v2]}
  - {name: Cedar, type: Service, aliases: []}
relations:
  owned_by: {label: owned by, inverse_label: owns, domain: [Service], range: [Team], patterns: ["{s} is owned by {o}", "{s} owns {o}||inverse", "The team owns {o}||inverse"]}
  depends_on: {label: depends on, inverse_label: required by, domain: [Service], range: [Service], patterns: ["{s} depends on {o}"]}
  affects: {label: affects, inverse_label: affected by, domain: [Bug], range: [Service], patterns: ["{s} affects {o}"]}
  fixed_by: {label: fixed by, inverse_label: fixed, domain: [Bug], range: [Person], patterns: ["{s} was fixed by {o}"]}
  supersedes: {label: supersedes, inverse_label: superseded by, domain: [Policy], range: [Policy], patterns: ["{s} supersedes {o}"]}
"""
DOCS = [
    ("svc-alder", "Alder Gateway", "service", "2024-05-01", "Alder depends on the Birch. Alder is owned by Red Team.\n\nMore on Alder, by Ada."),
    ("svc-birch", "Birch", "service", "2024-05-02", "Birch is not owned by anyone. BUG-7 affects Birch and Red Team owns Alder."),
    ("team-red", "Red Team", "team", "2023-01-01", "The team owns Birch. The rev2 plan is old."),
    ("bug-7", "BUG-7: slow", "bug", "2024-05-03", "BUG-7 was fixed by Dr. Ada Quill."),
    ("pol-2", "Rule v2", "policy", "2024-05-04", "Rule v2 supersedes v1. BUG-7 supersedes v1."),
    ("run-x", "Steps", "runbook", None, "Nothing here."),
]


@pytest.fixture(scope="module")
def ontology():
    return Ontology.parse(ONTOLOGY)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(*d, f"/{d[0]}.txt", i) for i, d in enumerate(DOCS)]
    df = spark.createDataFrame(rows, "doc_id string, title string, doc_type string, date string, body string, path string, doc_ord long")
    return df.withColumn("date", df.date.cast("date"))


@pytest.fixture(scope="module")
def triples(corpus, ontology):
    return table(X.extract_triples(corpus, ontology))


@pytest.fixture(scope="module")
def edges(triples):
    return table(G.build_edges(triples))


@pytest.fixture(scope="module")
def nodes(spark, ontology):
    return ontology.entity_frame(spark).select("name", "type")


def test_triples(triples):
    got = {(r.subject, r.predicate, r.object, r.doc_id, r.resolved_from_document) for r in triples.collect()}
    assert got == {
        ("Alder", "depends_on", "Birch", "svc-alder", False), ("Alder", "owned_by", "Red Team", "svc-alder", False), ("BUG-7", "affects", "Birch", "svc-birch", False),
        ("Alder", "owned_by", "Red Team", "svc-birch", False), ("Birch", "owned_by", "Red Team", "team-red", True), ("BUG-7", "fixed_by", "Ada Quill", "bug-7", False),
        ("Rule v2", "supersedes", "Rule v1", "pol-2", False),
    }


def test_stats_and_orphans(triples, ontology):
    assert {r.predicate: r.n for r in X.extraction_stats(triples, ontology).collect()} == {"owned_by": 3, "depends_on": 1, "affects": 1, "fixed_by": 1, "supersedes": 1}
    assert [r.name for r in X.orphan_entities(triples, ontology).collect()] == ["Cedar"]


def test_orphans_extract_once(corpus, ontology):
    plan = X.orphan_entities(X.extract_triples(corpus, ontology), ontology)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1


def test_edges_facts_match(spark, edges, ontology):
    owned = G.edge(edges, "Alder", "owned_by", "Red Team").first()
    assert [s.doc_id for s in owned.sources] == ["svc-alder", "svc-birch"]
    facts = {(r.label, r.other) for r in G.facts(edges, ontology.relation_frame(spark)).where("entity = 'Birch'").collect()}
    assert facts == {("required by", "Alder"), ("owned by", "Red Team"), ("affected by", "BUG-7")}
    assert G.match(edges, object="Birch").count() == 2 and G.match(edges, subject="nobody").count() == 0


def test_counting_assertions_gathers_none(triples, edges):
    counted = G.build_edges(triples).select("subject", "predicate", "object", "n_sources")
    assert "collect_list" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert counted.exceptAll(edges.selectExpr("subject", "predicate", "object", "cast(size(sources) as long)")).count() == 0


def test_links_of_a_page_meet_before_the_join(spark):
    rows = [("a", "topic", "See [[b]] and [[c]].", []), ("b", "entity", "", []), ("c", "entity", "[[b]]", []), ("d", "entity", "", [])]
    made = spark.createDataFrame(rows, "title string, page_type string, summary string, sections array<struct<heading:string,body:string>>")
    orphans = lint.orphan_pages(made)
    assert [r.subject for r in orphans.collect()] == ["d"]
    assert "Aggregate [title" in orphans._jdf.queryExecution().optimizedPlan().toString()


def labels(ontology):
    return G.label_map([(r.predicate, r.label) for r in ontology.relations])


def test_neighbours_paths_components(spark, nodes, edges, ontology):
    seed = spark.createDataFrame([("Alder",), ("nobody",)], "start string")
    near = {r.node: r.distance for r in G.neighbors_within(seed, edges, 3).collect()}
    assert near == {"Birch": 1, "Red Team": 1, "BUG-7": 2, "Ada Quill": 3}
    paths = G.simple_paths(seed, edges, 4).where("element_at(nodes, -1) = 'Ada Quill'")
    got = [r[0] for r in paths.orderBy("nodes").select(G.render_path(paths.start, paths.route, labels(ontology))).collect()]
    assert got == [
        "Alder -[depends on]-> Birch <-[affects]- BUG-7 -[fixed by]-> Ada Quill",
        "Alder -[owned by]-> Red Team <-[owned by]- Birch <-[affects]- BUG-7 -[fixed by]-> Ada Quill",
    ]
    sizes = {r.component: r["size"] for r in G.component_sizes(G.components(nodes, edges)).collect()}
    assert sizes == {"Ada Quill": 5, "Rule v1": 2, "Cedar": 1}


def test_self_loops_and_parallel_edges(spark):
    e = spark.createDataFrame([("a", "p", "a"), ("a", "p", "b"), ("a", "q", "b"), ("b", "p", "a")], "subject string, predicate string, object string")
    seed = spark.createDataFrame([("a",)], "start string")
    assert G.simple_paths(seed, e, 2).count() == 3
    assert {r.node: r.degree for r in G.degrees(e).collect()} == {"a": 5, "b": 3}
    assert [(r.a, r.b, r.n) for r in G.parallel_groups(e).where("a != b").collect()] == [("a", "b", 3)]


ASKED = [
    (1, "Who fixed the bug in the service that Alder depends on?"), (2, "Which people are within two hops of BUG-7?"), (3, "What is the revenue?"),
    (4, "Which service does Red Team own?"),
]


@pytest.fixture(scope="module")
def plans(spark, ontology):
    asked = spark.createDataFrame(ASKED, "q_id int, question string")
    return table(planner.plan_questions(asked, ontology))


def test_plans(plans):
    got = {r.q_id: (r.seeds, r.answer_type, r.named_types, r.cues, r.hops) for r in plans.collect()}
    assert got[1] == (["Alder"], "Person", ["Service", "Bug"], ["depends_on", "fixed_by"], None)
    assert got[2] == (["BUG-7"], "Person", ["Person"], [], 2)
    assert got[3] == ([], None, [], [], None)
    assert got[4] == (["Red Team"], "Service", ["Service", "Team"], [], None)


def test_graph_answers(plans, nodes, edges, ontology):
    best = kg.candidates(plans, nodes, edges).where("q_id = 1 and rank = 1").first()
    assert best.entity == "Ada Quill" and best.score == pytest.approx(-0.6 * 3 + 2.5 * 2 + 1.5 * 2)
    got = {r.q_id: r for r in kg.answer(plans, nodes, edges, labels(ontology)).collect()}
    assert got[1].confident and got[1].citations == ["svc-alder", "svc-birch", "bug-7"]
    assert "BUG-7 was fixed by Dr. Ada Quill." in got[1].answer
    assert got[2].confident and got[2].citations == ["bug-7"]
    assert not got[3].confident and "No entity" in got[3].note and got[3].evidence == []
    assert not got[4].confident and "equally good routes, to Alder and Birch" in got[4].note


def test_lookups_and_spans(spark, ontology):
    assert ontology.entity("Alder") == ("Alder", "Service", ("Alder Gateway",)) and ontology.canonical("v1") == ("Rule v1", "Policy")
    assert ontology.by_type()["Service"] == ["Alder", "Birch", "Cedar"] and list(ontology.by_type()) == ["Service", "Person", "Team", "Bug", "Policy"]
    with pytest.raises(KeyError):
        ontology.entity("Nobody")
    text = "Dr. Ada Quill left Alder Gateway; Alders and v1 stay. Ada"
    df = spark.createDataFrame([(text,), (None,), ("none here",)], "t string")
    got = [r[0] for r in df.select(mention_spans(df.t, ontology)).collect()]
    assert [(m.name, m.type, text[m.start : m.end]) for m in got[0]] == [
        ("Ada Quill", "Person", "Dr. Ada Quill"), ("Alder", "Service", "Alder Gateway"), ("Rule v1", "Policy", "v1"), ("Ada Quill", "Person", "Ada"),
    ]
    assert got[1:] == [[], []]


def test_neighbourhood_of_any_range(spark):
    chain = [(f"n{i}", "next", f"n{i + 1}") for i in range(9)]
    edges = spark.createDataFrame([(*e, [("d", "x")]) for e in chain], "subject string, predicate string, object string, sources array<struct<doc_id:string,sentence:string>>")
    nodes = spark.createDataFrame([(f"n{i}", "T") for i in range(10)], "name string, type string")
    plans = spark.createDataFrame([(1, ["n0"], None, 7), (2, ["n0"], None, 50), (3, ["n9"], None, 1)], "q_id int, seeds array<string>, answer_type string, hops int")
    far = {q: [] for q in (1, 2, 3)}
    for r in kg.neighbourhood(plans, nodes, edges).orderBy("q_id", "rank").collect():
        far[r.q_id].append((r.entity, r.distance))
    assert far[1] == [(f"n{i}", i) for i in range(1, 8)] and far[2] == [(f"n{i}", i) for i in range(1, 10)] and far[3] == [("n8", 1)]


def test_envelope_needs_a_note(spark, plans, nodes, edges, ontology):
    board = answers.scoreboard(kg.answer(plans, nodes, edges, labels(ontology)), "q_id")
    got = {r.q_id: (r.documents_touched, r.derivation_shown, r.admitted_ignorance) for r in board.collect()}
    assert got[1] == (3, True, False) and got[2] == (1, False, False) and got[3] == (0, False, True)
    broken = answers.failed(plans, "rag", "boom", "q_id").first()
    assert not broken.confident and "boom" in broken.note
    rows = spark.sql("select 1 q_id, 'a' answer, array() evidence, array() citations, array() trace, '{}' detail, 0L tokens_est, false confident, cast(null as string) note")
    with pytest.raises(Exception, match="requires a note"):
        answers.envelope(rows, "kg", "q_id").collect()


TREES = compiler.Topic(
    "All Trees", "The trees and what leans on what.",
    (compiler.Section("Trees", "kind", "Service"), compiler.Section("Leaning", "edges", "depends_on"), compiler.Section("Empty", "edges", "no_such")), ("team",),
)
LEFTOVER = compiler.Topic.of({"title": "Left Over", "summary": "What no page tells.", "doc_types": ["runbook", "team"]})


@pytest.fixture(scope="module")
def made(corpus, triples, ontology):
    return table(compiler.compile_pages(corpus, triples, ontology, "2024-06-01", (TREES, LEFTOVER)))


def test_topic_pages(made, corpus, triples, ontology):
    got = {r.title: r for r in made.where("page_type = 'topic'").collect()}
    trees = {s.heading: s.body for s in got["All Trees"].sections}
    assert trees == {"Trees": "- [[Alder]] — Alder depends on the Birch.\n- [[Birch]] — Birch is not owned by anyone.\n- [[Cedar]]", "Leaning": "- [[Alder]] depends on [[Birch]]"}
    assert got["All Trees"].summary == TREES.summary and got["All Trees"].sources == ["svc-alder", "svc-birch"]
    assert got["Left Over"].sources == ["run-x"] and got["Left Over"].sections == []
    assert compiler.compile_pages(corpus, triples, ontology, "2024-06-01").where("page_type = 'topic'").count() == 0


def test_pages(made):
    got = {r.title: r for r in made.collect()}
    alder = got["Alder"]
    assert alder.summary == "Alder depends on the Birch." and alder.sources == ["svc-alder", "svc-birch"]
    body = {s.heading: s.body for s in alder.sections}
    assert body["What it is"] == "Alder depends on the [[Birch]]. Alder is owned by [[Red Team]]."
    assert body["Relationships"] == "- depends on [[Birch]]\n- owned by [[Red Team]]"
    assert body["History"] == "- [[BUG-7]] affects [[Birch]] and [[Red Team]] owns Alder. (svc-birch)"
    assert body["Related"] == "[[Birch]] · [[Red Team]]"
    assert "Cedar" not in got and got["Left Over"].page_type == "topic" and "run-x" in got["Left Over"].sources
    cited = {s for r in got.values() for s in r.sources}
    assert cited == {d[0] for d in DOCS}


def test_pages_survive_a_round_trip(made):
    again = pages.parse(made.select(pages.render().alias("value")))
    key = lambda df: sorted((r.title, r.page_type, r.entity_type, tuple(r.sources), str(r.updated), r.summary, tuple(map(tuple, r.sections))) for r in df.collect())
    assert key(again.select(*made.columns)) == key(made)


def test_missing_front_matter_is_an_error(spark):
    with pytest.raises(Exception, match="no frontmatter"):
        pages.parse(spark.createDataFrame([("# hello",)], "value string")).collect()


def test_index_and_lint(spark, made, corpus, ontology):
    text = "# Index\n\n## Service\n\n- [[Alder]] — Alder depends on the Birch.\n- [[Gone]] — x\n- [[Birch]] — other\n\n## Topics\n- [[Vendor Risk]]\n"
    entries = pages.parse_index(spark.createDataFrame([(text,)], "value string"))
    assert [(r.title, r.category) for r in entries.orderBy("entry_ord").collect()] == [("Alder", "Service"), ("Gone", "Service"), ("Birch", "Service"), ("Vendor Risk", "Topics")]
    relations = [(r.predicate, r.label, r.inverse_label) for r in ontology.relations]
    found = lint.lint(made, pages.catalogue(made), corpus, relations)
    got = {(r.check, r.subject) for r in found.collect()}
    assert ("stale_pages", "Rule v1") not in got and not {c for c, _ in got} & {"index_drift", "coverage_gaps", "contradictions"}
    drift = {r.subject: r.detail for r in lint.index_drift(made, entries).collect()}
    assert "no page was written" in drift["Gone"] and "summary" in drift["Birch"] and "does not list" in drift["Red Team"] and "Alder" not in drift
    row = lint.report(found, made).first()
    assert row.page_count == made.count()


def page(title, summary="s", body="", kind="entity", sources=(), heading="Relationships"):
    return (title, kind, "T", list(sources), None, summary, [(heading, body)] if body else [])


def test_each_check(spark, corpus):
    rows = [
        page("A", body="- owned by [[B]]\n- owned by [[C]]\n- bad line", sources=["team-red"]), page("B", body="- owns [[A]]\n- owns [[D]]"), page("C", body="- supersedes [[D]]", sources=["svc-alder", "x"]),
        page("D"), page("E", body="see [[D]] and [[Z]]", heading="Note"), page("F", kind="topic"),
    ]
    df = spark.createDataFrame(rows, pages.PAGE_SCHEMA)
    rel = [("owned_by", "owned by", "owns"), ("supersedes", "supersedes", "superseded by")]
    got = {(r.check, r.subject, r.detail) for r in lint.lint(df, pages.catalogue(df), corpus, rel).where("check != 'coverage_gaps'").collect()}
    assert got == {
        ("contradictions", "A", "owned_by takes one object, but this page says owned by [[B]] and [[C]]"), ("orphan_pages", "E", "no other page links here"),
        ("broken_links", "E", "[[Z]] resolves to no page"), ("superseded_refs", "E", "links to [[D]], which has been superseded, without saying so"),
        ("superseded_refs", "B", "links to [[D]], which has been superseded, without saying so"),
        ("stale_pages", "A", "newest source is 2023-01-01, 489 days behind the corpus (2024-05-04)"),
    }


def test_wiki_answers(spark, made):
    asked = spark.createDataFrame([(1, "Who owns Alder?"), (2, "zzz revenue")], "q_id int, question string")
    got = {r.q_id: r for r in wiki.answer(asked, pages.catalogue(made), made).collect()}
    assert got[1].confident and "Alder" in got[1].answer and "svc-alder" in got[1].citations
    assert not got[2].confident and got[2].note == wiki.NOTHING


def test_extractive_and_backends(spark):
    rows = spark.sql("select 'who fixed it' question, array(struct('d1' citation, 'Ada fixed it. Rain fell.' text), struct('d2' citation, 'It broke.' text)) evidence")
    got = generate.Extractive(2).generate(rows).first()
    assert got.answer == "Ada fixed it. [1] Rain fell. [1]" and got.backend == "extractive"
    none = spark.sql("select 'q' question, cast(array() as array<struct<citation:string,text:string>>) evidence")
    assert generate.build_llm({"backend": "extractive"}).generate(none).first().answer == generate.NO_EVIDENCE
    broken = generate.build_llm({"backend": "ollama", "host": "http://127.0.0.1:9", "model": "m"}).generate(rows).first()
    assert broken.backend == "extractive" and "No reply from ollama" in broken.generation_note and broken.answer.startswith("Ada fixed it.")
    with pytest.raises(ValueError, match="unknown llm backend"):
        generate.build_llm({"backend": "x"})


def test_timer():
    t = answers.PhaseTimer()
    with t.phase("a"):
        pass
    assert set(t.ms()) == {"a", "total"}
