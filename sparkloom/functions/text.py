"""Text primitives as column expressions: built-ins only, safe on null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no subject.
STOPWORDS = tuple(
    """a an and are as at be by did do does for from has have how in into is it its
    of on or that the their there they this to was were what when where which
    who whom whose why will with""".split()
)
# Endings in the order they are tried.
SUFFIXES = ("ations", "ation", "ions", "ing", "ies", "ion", "es", "ed", "s")
# Abbreviations whose period ends no sentence.
ABBREVIATIONS = (
    "Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "St",
    "vs", "etc", "e.g", "i.e", "approx", "No", "Inc", "Ltd", "Co",
)

#: Shortest part a suffix may leave.
STEM_FLOOR = 4
PARAGRAPH_BREAK = r"\n\s*\n"
TOKEN = r"[a-z0-9]+"
TERM = r"[A-Za-z0-9][A-Za-z0-9-]*"
LINK = r"\[\[([^\[\]]+)\]\]"

_SHORT = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
_CLOSERS = r"""["')\]]*"""
#: An abbreviation with its terminator and the space behind it.
AFTER_SHORT = rf"(^\.*|[^A-Za-z.]\.*)({_SHORT})(\.*[.!?]{_CLOSERS}) "
AFTER_END = rf"([.!?]{_CLOSERS}) "
_BACK = "|".join(a[::-1].replace(".", r"\.") for a in ABBREVIATIONS)
#: The space between two sentences in a text read backwards: it starts at a space, so little is looked at, and takes in nothing else, so neighbours do not share it.
CUT_BACK = rf" (?={_CLOSERS}[.!?])(?!{_CLOSERS}[.!?]\.*(?:{_BACK})\.*(?:[^A-Za-z.]|\z))"


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def _of_paragraph(flat: Column) -> Column:
    cut = F.reverse(F.regexp_replace(F.reverse(flat), CUT_BACK, "\u0001"))
    return F.filter(F.split(F.translate(cut, "\u0002", " "), "\u0001"), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Sentences in order. A paragraph always ends one; an abbreviation's mark never does.

    Line breaks inside a paragraph are typesetting. Null has none.
    """
    paragraphs = F.transform(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_BREAK), collapse)
    return F.flatten(F.transform(F.filter(paragraphs, lambda p: p != ""), _of_paragraph))


def tokens(text: Column) -> Column:
    """Lower-case ASCII letters and digits, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def terms(text: Column) -> Column:
    """Distinct lower-case words, hyphens inside kept, without stop words."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), F.lower)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOPWORDS)))


def stem(word: Column) -> Column:
    """The word without the first suffix that leaves at least four characters."""
    tries = ((s, word.rlike(f"^.{{{STEM_FLOOR},}}{s}$")) for s in SUFFIXES)
    cut = [(fits, F.substring(word, F.lit(1), F.length(word) - len(s))) for s, fits in tries]
    first = F.when(*cut[0])
    return reduce(lambda c, x: c.when(*x), cut[1:], first).otherwise(word)


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(terms(text), stem))


def question_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9-]*"), F.lit(0))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def links(text: Column) -> Column:
    """Targets of ``[[...]]`` in order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINK), F.lit(1)))


def estimate_tokens(texts: Column) -> Column:
    """Evidence size of an array of texts: a quarter of its characters."""
    size = F.aggregate(texts, F.lit(0).cast("long"), lambda s, t: s + F.length(t))
    return F.floor(size / 4).cast("long")


def first_sentence(body: Column, title: Column) -> Column:
    """The first of the first paragraph; further ones are only cut up if that has none."""
    lead = F.get(F.split(body, PARAGRAPH_BREAK, 2), F.lit(0))
    return F.coalesce(F.get(sentences(lead), F.lit(0)), F.get(sentences(body), F.lit(0)), title)


def opening(body: Column) -> Column:
    """First paragraph, white space collapsed."""
    return collapse(F.get(F.split(body, "\n\n", 2), F.lit(0)))


def readable(body: Column) -> Column:
    """A section as prose: bullets, if it has nothing else, become paragraphs."""
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), strip), lambda x: x != "")
    bullets = F.array_join(F.transform(lines, lambda x: F.substring(x, F.lit(3), F.length(x))), "\n\n")
    return F.when(F.forall(lines, lambda x: x.startswith("- ")), bullets).otherwise(body)
