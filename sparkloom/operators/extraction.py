"""Triples from prose: every pattern over every sentence, with where it came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import sentences
from sparkloom.operators.ontology import Ontology, Relation, Rule, mentions, rules


def sentence_rows(corpus: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``sentence_ord`` and ``sentence`` for each sentence of each body."""
    return corpus.select(*keep, F.posexplode(sentences(F.col("body"))).alias("sentence_ord", "sentence"))


def document_entities(corpus: DataFrame, ontology: Ontology) -> DataFrame:
    """``doc_id, entity, type`` of the first mention in each title; none is null."""
    first = F.get(mentions(F.col("title"), ontology), F.lit(0))
    return corpus.select("doc_id", first["name"].alias("entity"), first["type"].alias("type"))


def _triples_of(rule: Rule, relation: Relation, pairs: Column) -> Column:
    """A rule's matches in a sentence as structs, without those whose ends do not fit."""
    domain, reach = F.array(*map(F.lit, relation.domain)), F.array(*map(F.lit, relation.range))
    fit = F.filter(pairs, lambda p: F.array_contains(domain, p["s"]["type"]) & F.array_contains(reach, p["o"]["type"]))

    def row(p: Column, i: Column) -> Column:
        return F.struct(
            F.lit(rule.ordinal).alias("rule"), i.alias("match"), p["s"]["name"].alias("subject"), F.lit(rule.predicate).alias("predicate"),
            p["o"]["name"].alias("object"), F.lit(rule.template).alias("pattern"), F.lit(rule.subject_group is None).alias("from_document"),
        )

    return F.transform(fit, row)


def _ends(rule: Rule, known: Column) -> Callable[[Column], Column]:
    """From a match to its subject and object; a rule without a subject takes the document's entity."""

    def entity(match: Column, group: int) -> Column:
        return F.try_element_at(known, F.regexp_extract(match, rule.regex, group))

    def pair(match: Column) -> Column:
        subject = F.col("_entity") if rule.subject_group is None else entity(match, rule.subject_group)
        return F.struct(subject.alias("s"), entity(match, rule.object_group).alias("o"))

    return pair


def extract_triples(corpus: DataFrame, ontology: Ontology) -> DataFrame:
    """``subject, predicate, object, doc_id, sentence, pattern, resolved_from_document, triple_ord``.

    All rules run in one pass over the sentences, as one array of matches per sentence; a rule without
    a subject takes the document's entity, and without one gives nothing. Ends must fit the relation's
    domain and range. One edge read twice from a sentence keeps its first rule.
    """
    first = F.get(mentions(F.col("title"), ontology), F.lit(0))
    rows = sentence_rows(corpus.withColumn("_entity", first), "doc_id", "doc_ord", "_entity")
    known = ontology.surface_map()
    found = []
    for rule in rules(ontology):
        relation = ontology.relation(rule.predicate)
        # a plain search for the words between the names comes first; the expression runs once a sentence, and its groups over the short matches
        there = F.lit(True)
        for piece in rule.literals:
            there = there & F.contains(F.col("sentence"), F.lit(piece))
        none = F.array().cast("array<string>")
        matches = F.when(there, F.regexp_extract_all("sentence", F.lit(rule.regex), F.lit(0))).otherwise(none)
        pairs = F.transform(matches, _ends(rule, known))
        if rule.inverse:
            pairs = F.transform(pairs, lambda p: F.struct(p["o"].alias("s"), p["s"].alias("o")))
        found.append(_triples_of(rule, relation, pairs))
    each = rows.withColumn("_m", F.explode(F.concat(*found))).select("doc_id", "doc_ord", "sentence_ord", "sentence", "_m.*")
    order = F.struct("sentence_ord", "rule", "match")
    best = each.groupBy("subject", "predicate", "object", "doc_id", "doc_ord", "sentence").agg(
        F.min(F.struct(order.alias("at"), F.col("pattern"), F.col("from_document"))).alias("first")
    )
    return best.select(
        "subject", "predicate", "object", "doc_id", "sentence", F.col("first.pattern").alias("pattern"),
        F.col("first.from_document").alias("resolved_from_document"), F.struct("doc_ord", "first.at").alias("triple_ord"),
    )


def extraction_stats(triples: DataFrame, ontology: Ontology) -> DataFrame:
    """``predicate, n`` for every declared predicate, unused ones included."""
    dim = ontology.relation_frame(triples.sparkSession).select("predicate", "relation_ord")
    counts = triples.groupBy("predicate").agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counts, "predicate", "left").select("predicate", F.coalesce("n", F.lit(0)).alias("n"), "relation_ord")


def orphan_entities(triples: DataFrame, ontology: Ontology) -> DataFrame:
    """``name, type`` of declared entities that no triple links."""
    linked = triples.select(F.explode(F.array("subject", "object")).alias("name")).distinct()  # one pass: a union would extract twice
    return ontology.entity_frame(triples.sparkSession).select("name", "type").join(linked, "name", "left_anti")
