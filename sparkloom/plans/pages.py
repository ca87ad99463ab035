"""Wiki pages as rows: derived parts, Markdown out and in, the catalogue, links.

``pages(title, page_type, entity_type, sources array<string>, updated date, summary, sections array<struct<heading,body>>)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import LINK, readable, slug, strip

PAGE_SCHEMA = (
    "title string, page_type string, entity_type string, sources array<string>, updated date, summary string,"
    " sections array<struct<heading:string,body:string>>"
)
DERIVED = "Sources"
RELATIONSHIPS = "Relationships"
_BULLET = r"^- (.+?) \[\[([^\[\]]+)\]\]\s*$"
_ENTRY = r"^- \[\[([^\[\]]+)\]\](?:\s+—\s+(.*))?$"


def page_links(summary: str = "summary", sections: str = "sections") -> Column:
    """Targets in the summary, then in the sections, without repeats."""
    bodies = F.transform(sections, lambda s: F.regexp_extract_all(s["body"], F.lit(LINK), F.lit(1)))
    return F.array_distinct(F.concat(F.regexp_extract_all(F.col(summary), F.lit(LINK), F.lit(1)), F.flatten(bodies)))


def section(heading: str, sections: str = "sections") -> Column:
    return F.get(F.filter(sections, lambda s: s["heading"] == heading), F.lit(0))["body"]


def relationships(sections: str = "sections") -> Column:
    """``array<struct<label,other>>`` from the well-formed bullets of the first Relationships section."""
    lines = F.split(F.coalesce(section(RELATIONSHIPS, sections), F.lit("")), r"\r?\n")
    good = F.filter(lines, lambda x: x.rlike(_BULLET))
    return F.transform(good, lambda x: F.struct(F.regexp_extract(x, _BULLET, 1).alias("label"), F.regexp_extract(x, _BULLET, 2).alias("other")))


def body(summary: str = "summary", sections: str = "sections") -> Column:
    """What a reader reads: prose without headings, the summary in front unless the prose begins with it."""
    prose = F.transform(F.filter(sections, lambda s: strip(s["body"]) != ""), lambda s: readable(s["body"]))
    led = (F.size(prose) > 0) & F.startswith(F.get(prose, F.lit(0)), F.col(summary))
    return F.array_join(F.when(led, prose).otherwise(F.concat(F.array(summary), prose)), "\n\n")


def _scalar(value: Column) -> Column:
    risky = value.contains(":") | value.rlike(r"^[\[{*&]")
    return F.when(risky, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)


def render() -> Column:
    """A page as Markdown with front matter; the Sources section is derived."""
    meta = F.concat_ws(
        "\n",
        F.concat(F.lit("title: "), _scalar(F.col("title"))),
        F.concat(F.lit("page_type: "), F.col("page_type")),
        F.when(F.coalesce("entity_type", F.lit("")) != "", F.concat(F.lit("entity_type: "), F.col("entity_type"))),
        F.concat(F.lit("sources: ["), F.array_join("sources", ", "), F.lit("]")),
        F.concat(F.lit("updated: "), F.date_format("updated", "yyyy-MM-dd")),
    )
    parts = F.transform("sections", lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), s["body"]))
    cited = F.concat(F.lit(f"## {DERIVED}\n\n"), F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- "), s)), "\n"))
    head = F.array(F.concat(F.lit("---\n"), meta, F.lit("\n---")), F.concat(F.lit("# "), F.col("title")), F.concat(F.lit("> "), F.col("summary")))
    return F.concat(F.array_join(F.concat(head, parts, F.array(cited)), "\n\n"), F.lit("\n"))


def parse(files: DataFrame, text: str = "value") -> DataFrame:
    """Pages from rendered Markdown; a text without front matter is an error."""
    front = r"^---\n([\s\S]*?)\n---\n"
    missing = F.raise_error(F.lit("page has no frontmatter block; it was not written by the compiler")).cast("string")
    meta = F.when(F.col(text).rlike(front), F.regexp_extract(text, front, 1)).otherwise(missing)
    rows = files.withColumn("_meta", meta).withColumn("_rest", F.regexp_replace(text, front, ""))
    field = lambda name: F.regexp_extract("_meta", rf"(?m)^{name}: (.*)$", 1)
    plain = lambda c: F.regexp_replace(c, r'^"(.*)"$', "$1")
    listed = F.regexp_replace(field("sources"), r"^\[|\]$", "")
    parts = F.split("_rest", r"(?:^|(?<=\n))## (?=.)")
    sections = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda p: F.struct(strip(F.get(F.split(p, "\n", 2), F.lit(0))).alias("heading"), strip(F.coalesce(F.get(F.split(p, "\n", 2), F.lit(1)), F.lit(""))).alias("body")),
    )
    return rows.select(
        plain(field("title")).alias("title"),
        field("page_type").alias("page_type"),
        F.when(field("entity_type") != "", field("entity_type")).alias("entity_type"),
        F.when(listed == "", F.array().cast("array<string>")).otherwise(F.split(listed, r",\s*")).alias("sources"),
        F.to_date(field("updated")).alias("updated"),
        strip(F.regexp_extract(parts[0], r"(?m)^> (.*)$", 1)).alias("summary"),
        F.filter(sections, lambda s: s["heading"] != DERIVED).alias("sections"),
    )


def file_names() -> Column:
    return F.concat(slug(F.col("title")), F.lit(".md"))


def catalogue(pages: DataFrame) -> DataFrame:
    """``title, summary, category``: entity pages by type, topic pages under Topics."""
    kind = F.when(F.col("page_type") == "topic", F.lit("Topics")).otherwise(F.col("entity_type"))
    return pages.select("title", "summary", kind.alias("category"))


def parse_index(files: DataFrame, text: str = "value") -> DataFrame:
    """``title, summary, category, entry_ord`` from an index: headings set the category of the entries below."""
    lines = F.split(text, r"\r?\n")
    step = lambda s, x: F.struct(
        F.when(x.rlike(r"^## .+$"), strip(F.regexp_extract(x, r"^## (.+)$", 1))).otherwise(s["category"]).alias("category"),
        F.when(
            x.rlike(_ENTRY),
            F.concat(
                s["out"],
                F.array(
                    F.struct(
                        F.regexp_extract(x, _ENTRY, 1).alias("title"), strip(F.regexp_extract(x, _ENTRY, 2)).alias("summary"), s["category"].alias("category")
                    )
                ),
            ),
        )
        .otherwise(s["out"])
        .alias("out"),
    )
    start = F.struct(F.lit("").alias("category"), F.array().cast("array<struct<title:string,summary:string,category:string>>").alias("out"))
    return files.select(F.posexplode(F.aggregate(lines, start, step)["out"]).alias("entry_ord", "_e")).select("_e.*", "entry_ord")


def link_rows(pages: DataFrame) -> DataFrame:
    """``title, pos, target``: every link once per page, in page order."""
    return pages.select("title", F.posexplode(page_links()).alias("pos", "target"))


def backlinks(pages: DataFrame) -> DataFrame:
    """``target, sources``: pages that link to it, sorted."""
    return link_rows(pages).groupBy("target").agg(F.array_sort(F.collect_set("title")).alias("linked_from"))
