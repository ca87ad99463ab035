"""Quality rules: base counts, and divergence from language references.

A document's histogram of character classes and its histogram of common words are
compared with those of its language by Jensen-Shannon distance (base 2, 0 to 1). The
references are the summed histograms of all documents of a language, so they cover
the whole corpus. Short texts give noisy histograms; guards on characters and words keep
the distances from deciding there. Built-ins only: each document is one row from scan to
verdict, the texts are read once, and only histograms are aggregated.

Defined results: a null text has no words; a null language is a language of its
own with the union of the common words; repeated rows are judged alike, each counting in
the reference; an empty table gives an empty result; other columns are ignored. A
language's only document matches its reference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import words
from sparkloom.storage import table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Character classes; what none of them covers is the last class.
CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>@=+/\\_~^{}\[\]`]")

#: Frequent function words of four languages.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "on", "with"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "par"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con"),
}

#: Distances beyond these fail, once a text has that many characters or words.
MAX_CHAR_DISTANCE, MIN_CHARS_FOR_CHARS = 0.25, 200
MAX_WORD_DISTANCE, MIN_WORDS_FOR_WORDS = 0.24, 100


def _pair_up(hashes: str, step: int) -> Column:
    """Each hash combined with the one ``step`` on; the last ``step`` of them mean nothing."""
    h = F.col(hashes)
    return F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))


def _covered(starts: Column) -> Column:
    """Words covered by windows at the ascending ``starts``."""
    steps = F.zip_with(
        F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, F.lit(2), F.size(starts) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))
    )
    return F.when(F.size(starts) == 0, 0).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x))


def repeat_words(df: DataFrame, words_col: str, out: str) -> DataFrame:
    """Adds the number of words that lie in an 8-word window found twice or more.

    Sorting (hash, place) pairs puts equal windows side by side, which costs
    n log n for any text; texts without an equal pair skip it.
    """
    df = df.withColumn("_h", F.when(F.size(words_col) >= WINDOW, F.transform(words_col, lambda x: F.xxhash64(x))))
    for step in (1, 2, 4):  # runs of two, four and eight words, each column computed once
        df = df.withColumn("_h", _pair_up("_h", step))
    df = df.withColumn("_h", F.slice("_h", 1, F.size(words_col) - WINDOW + 1))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn(
        "_s", F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ).drop("_h")
    n = F.size("_s")
    after = F.zip_with("_s", F.slice("_s", F.lit(2), n - 1), lambda a, b: a["h"] == b["h"])
    before = F.concat(F.array(F.lit(False)), F.slice(after, 1, n - 1))
    marks = F.zip_with(before, after, lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    paired = F.zip_with("_s", marks, lambda s, m: F.when(m, s["i"]))
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.array_sort(F.filter(paired, lambda p: p.isNotNull()))))
    df = df.drop("_s")
    return df.withColumn(out, F.coalesce(_covered(F.col("_p")), F.lit(0)).cast("long")).drop("_p")


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and both histograms, one row per document."""
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")
    )
    rows = rows.withColumn("_w", words(F.col("_t")))
    rows = repeat_words(rows, "_w", "n_repeat_words")
    rows = rows.withColumn("_left0", F.col("_t"))
    for k, c in enumerate(CLASSES):  # each class is taken out of what the classes before it left
        rows = rows.withColumn(f"_left{k + 1}", F.regexp_replace(f"_left{k}", f"{c}+", ""))
    counts = [(F.length(f"_left{k}") - F.length(f"_left{k + 1}")).cast("long") for k in range(len(CLASSES))]
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    own = reduce(
        lambda c, kv: c.when(F.col("lang") == kv[0], F.array(*map(F.lit, kv[1]))),
        COMMON_WORDS.items(),
        F.when(F.lit(False), F.array(F.lit(""))),
    ).otherwise(F.array(*map(F.lit, every)))
    rows = rows.select(
        "doc_id",
        "lang",
        F.length("_t").cast("long").alias("n_chars"),
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        "n_repeat_words",
        F.array(*counts).alias("_c"),
        F.filter(
            F.transform("_w", lambda x: F.rtrim(F.lower(x), F.lit(".,"))), lambda x: x.isin(*every)
        ).alias("_f"),
        own.alias("_own"),
    )
    rest_chars = F.col("n_chars") - F.aggregate("_c", F.lit(0).cast("long"), lambda s, x: s + x)
    found = F.transform("_own", lambda o: F.size(F.filter("_f", lambda x: x == o)).cast("long"))
    rows = rows.select(
        *("doc_id", "lang", "n_chars", "n_words", "word_chars", "n_symbols", "n_repeat_words"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.concat("_c", F.array(rest_chars)).alias("char_hist"),
        found.alias("_found"),
    )
    rest_words = F.col("n_words") - F.aggregate("_found", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn("word_hist", F.concat("_found", F.array(rest_words))).drop("_found")


def language_references(feats: DataFrame) -> DataFrame:
    """Summed histograms by language: ``lang, ref_chars, ref_words``."""
    n_chars = len(CLASSES) + 1
    n_common = max(len({w for ws in COMMON_WORDS.values() for w in ws}), *map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get("char_hist", F.lit(i))).alias(f"_c{i}") for i in range(n_chars)]
    sums += [F.sum(F.get("word_hist", F.lit(i))).alias(f"_w{i}") for i in range(n_common)]
    found = feats.groupBy("lang").agg(*sums)
    present = F.filter(F.array(*(f"_w{i}" for i in range(n_common))), lambda x: x.isNotNull())
    return found.select(
        F.col("lang").alias("_lang"), F.array(*(f"_c{i}" for i in range(n_chars))).alias("ref_chars"), present.alias("ref_words")
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; 0 if either is empty."""

    def shares(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
        return F.transform(x, lambda v: F.when(total > 0, v / total).otherwise(0.0))

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(shares(p), shares(q), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    spread = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    empty = (F.aggregate(p, F.lit(0.0), lambda s, v: s + v) == 0) | (F.aggregate(q, F.lit(0.0), lambda s, v: s + v) == 0)
    return F.when(empty, 0.0).otherwise(F.sqrt(F.greatest(spread, F.lit(0.0))))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: base counts, distances, ``base_failed`` and ``kept``."""
    feats = table(features(df, id_col, text_col, lang_col))
    refs = table(language_references(feats))
    rows = feats.join(refs, feats.lang.eqNullSafe(refs._lang), "left")
    rows = rows.withColumn("char_distance", F.round(js_distance(F.col("char_hist"), F.col("ref_chars")), 6))
    rows = rows.withColumn("word_distance", F.round(js_distance(F.col("word_hist"), F.col("ref_words")), 6))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = ((F.col("n_chars") >= MIN_CHARS_FOR_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | (
        (F.col("n_words") >= MIN_WORDS_FOR_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    )
    return rows.select(
        F.col("doc_id").alias(id_col),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance"),
        failed.alias("base_failed"),
        (~failed & ~far).alias("kept"),
    )
