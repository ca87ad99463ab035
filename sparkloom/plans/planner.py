"""Questions to plans: seeds, answer type, named types, cues and hops, one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import question_words
from sparkloom.operators.ontology import Ontology, mentions

# Words that ask for a person, the irregular plural, and numbers.
ASKS_PERSON = ("who", "whom", "whose")
PERSON, PEOPLE = "Person", "people"
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}
HOP_PATTERNS = (
    r"(?i)\bwithin (\d+|one|two|three|four|five) hops?\b",
    r"(?i)\b(\d+|one|two|three|four|five) (?:hops?|degrees) (?:from|of)\b",
)


def _texts(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def named_types(words: Column, types: list[str]) -> Column:
    """Types named in singular or with an s, in ontology order; people last."""
    each = [F.when(F.arrays_overlap(words, _texts((t.lower(), t.lower() + "s"))), F.lit(t)) for t in types]
    named = F.filter(F.array(*each) if each else F.array().cast("array<string>"), lambda t: t.isNotNull())
    people = F.array_contains(words, PEOPLE) & ~F.array_contains(named, PERSON)
    return F.when(people, F.concat(named, F.array(F.lit(PERSON)))).otherwise(named)


def answer_type(words: Column, named: Column, types: list[str]) -> Column:
    """The type right after which or what; else a person for who; else the first type named."""
    surfaces = {PEOPLE: PERSON}
    for t in reversed(types):
        surfaces |= {t.lower(): t, t.lower() + "s": t}
    known = F.create_map(*(F.lit(x) for kv in surfaces.items() for x in kv))
    following = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    after = F.zip_with(words, following, lambda w, n: F.when(w.isin("which", "what"), F.try_element_at(known, n)))
    stated = F.get(F.filter(after, lambda t: t.isNotNull()), F.lit(0))
    person = F.when(F.arrays_overlap(words, _texts(ASKS_PERSON)), F.lit(PERSON))
    return F.coalesce(stated, person, F.get(named, F.lit(0)))


def cues(words: Column, ontology: Ontology) -> Column:
    """Predicates whose name or one of its labels begins with a word of the question."""
    each = []
    for r in ontology.relations:
        leading = sorted({s.replace("_", " ").split()[0] for s in (r.predicate, r.label, r.inverse_label) if s})
        each.append(F.when(F.arrays_overlap(words, _texts(leading)), F.lit(r.predicate)))
    return F.filter(F.array(*each) if each else F.array().cast("array<string>"), lambda p: p.isNotNull())


def hops(question: Column) -> Column:
    """The stated range of a neighbourhood question; null for others."""
    raw = [F.lower(F.regexp_extract(question, p, 1)) for p in HOP_PATTERNS]
    stated = F.coalesce(*(F.when(r != "", r) for r in raw))
    words = reduce(lambda c, kv: c.when(stated == kv[0], kv[1]), list(NUMBERS.items())[1:], F.when(stated == "one", 1))
    return F.coalesce(words, F.expr("cast(null as int)"), stated.try_cast("int"))


def plan_questions(questions: DataFrame, ontology: Ontology, question: str = "question") -> DataFrame:
    """``questions`` with ``seeds, answer_type, named_types, cues, hops``."""
    text = F.col(question)
    rows = questions.withColumn("_words", question_words(text))
    rows = rows.withColumn("seeds", F.array_distinct(F.transform(mentions(text, ontology), lambda m: m["name"])))
    rows = rows.withColumn("named_types", named_types(F.col("_words"), ontology.entity_types))
    rows = rows.withColumn("answer_type", answer_type(F.col("_words"), F.col("named_types"), ontology.entity_types))
    rows = rows.withColumn("cues", cues(F.col("_words"), ontology)).withColumn("hops", hops(text))
    return rows.drop("_words")
