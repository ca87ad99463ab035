"""Seven consistency checks over pages, catalogue and corpus; each gives ``check, severity, subject, detail``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.pages import link_rows, relationships

# Relations with one object, checks in order, and their severity.
FUNCTIONAL = ("owned_by", "led_by", "caused_by", "supersedes")
SEVERITY = {
    "orphan_pages": "warning",
    "broken_links": "error",
    "contradictions": "error",
    "stale_pages": "warning",
    "superseded_refs": "error",
    "coverage_gaps": "warning",
    "index_drift": "error",
}
STALE_DAYS = 180


def _finding(df: DataFrame, check: str, subject: str, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(SEVERITY[check]).alias("severity"), F.col(subject).alias("subject"), detail.alias("detail"))


def orphan_pages(pages: DataFrame) -> DataFrame:
    """Pages other than topics that nothing links to."""
    linked = link_rows(pages).select(F.col("target").alias("title")).distinct()  # many links meet map-side, before the join
    return _finding(pages.where("page_type != 'topic'").join(linked, "title", "left_anti"), "orphan_pages", "title", F.lit("no other page links here"))


def broken_links(pages: DataFrame) -> DataFrame:
    lost = link_rows(pages).join(pages.select(F.col("title").alias("target")), "target", "left_anti")
    return _finding(lost, "broken_links", "title", F.concat(F.lit("[["), F.col("target"), F.lit("]] resolves to no page")))


def contradictions(pages: DataFrame, relations: list[tuple[str, str, str]]) -> DataFrame:
    """Several objects where a relation allows one; only forward labels count. ``relations``: predicate, label, inverse label."""
    labels = {label: p for p, label, _ in relations if p in FUNCTIONAL}
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)) if labels else F.create_map().cast("map<string,string>")
    stated = pages.select("title", F.posexplode(relationships()).alias("pos", "r")).where(F.try_element_at(known, F.col("r.label")).isNotNull())
    each = stated.groupBy("title", F.col("r.label").alias("label"), F.col("r.other").alias("other")).agg(F.min("pos").alias("pos"))
    many = each.groupBy("title", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "other"))).alias("o")).where("size(o) > 1")
    listed = F.array_join(F.transform("o", lambda x: F.concat(F.lit("[["), x["other"], F.lit("]]"))), " and ")
    detail = F.concat(F.element_at(known, F.col("label")), F.lit(" takes one object, but this page says "), F.col("label"), F.lit(" "), listed)
    return _finding(many, "contradictions", "title", detail)


def stale_pages(pages: DataFrame, corpus: DataFrame, days: int = STALE_DAYS, as_of: str | None = None) -> DataFrame:
    """Pages whose newest source lies more than ``days`` behind the corpus; undated sources do not count."""
    dated = corpus.where("date is not null").select("doc_id", "date")
    newest = pages.select("title", F.explode("sources").alias("doc_id")).join(dated, "doc_id").groupBy("title").agg(F.max("date").alias("newest"))
    end = dated.agg(F.coalesce(F.max("date"), F.current_date()).alias("as_of")) if as_of is None else None
    rows = newest.crossJoin(F.broadcast(end)) if end is not None else newest.withColumn("as_of", F.lit(as_of).cast("date"))
    rows = rows.where(F.col("newest") < F.date_sub("as_of", days))
    detail = F.concat(
        F.lit("newest source is "), F.col("newest").cast("string"), F.lit(", "), F.datediff("as_of", "newest").cast("string"),
        F.lit(" days behind the corpus ("), F.col("as_of").cast("string"), F.lit(")"),
    )
    return _finding(rows, "stale_pages", "title", detail)


def superseded_refs(pages: DataFrame, relations: list[tuple[str, str, str]]) -> DataFrame:
    """Pages that link to a superseded page and nowhere say so."""
    found = [(label, inverse) for p, label, inverse in relations if p == "supersedes"]
    if not found:
        return _finding(pages.where("false"), "superseded_refs", "title", F.lit(""))
    label, inverse = found[0]
    said = pages.select("title", F.explode(relationships()).alias("r"))
    old = said.where(F.col("r.label") == label).select(F.col("r.other").alias("target")).union(said.where(F.col("r.label") == inverse).select(F.col("title").alias("target"))).distinct()
    parts = F.concat(F.array("summary"), F.transform("sections", lambda s: F.concat(s["heading"], F.lit("\n"), s["body"])))
    text = F.lower(F.array_join(parts, "\n"))
    silent = pages.where(~(text.contains(label) | text.contains(inverse)))
    refs = link_rows(silent).join(old, "target", "left_semi")
    detail = F.concat(F.lit("links to [["), F.col("target"), F.lit("]], which has been superseded, without saying so"))
    return _finding(refs, "superseded_refs", "title", detail)


def coverage_gaps(pages: DataFrame, corpus: DataFrame) -> DataFrame:
    cited = pages.select(F.explode("sources").alias("doc_id"))
    return _finding(corpus.join(cited, "doc_id", "left_anti"), "coverage_gaps", "doc_id", F.lit("no page cites this document"))


def index_drift(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Catalogue and pages disagreeing, in either direction."""
    p = pages.select("title", F.col("summary").alias("_page"), F.lit(True).alias("_has"))
    e = entries.select("title", F.col("summary").alias("_entry"), F.lit(True).alias("_listed"))
    both = e.join(p, "title", "full_outer")
    what = (
        F.when(F.col("_has").isNull(), F.lit("catalogued in index.md but no page was written"))
        .when(F.col("_listed").isNull(), F.lit("page exists but index.md does not list it"))
        .when(F.col("_page") != F.col("_entry"), F.lit("index.md quotes a summary the page no longer carries"))
    )
    return _finding(both.withColumn("_d", what).where("_d is not null"), "index_drift", "title", F.col("_d"))


def lint(pages: DataFrame, entries: DataFrame, corpus: DataFrame, relations: list[tuple[str, str, str]], days: int = STALE_DAYS, as_of: str | None = None) -> DataFrame:
    """All findings, the order of checks as ``check_ord``."""
    parts = [
        orphan_pages(pages), broken_links(pages), contradictions(pages, relations), stale_pages(pages, corpus, days, as_of),
        superseded_refs(pages, relations), coverage_gaps(pages, corpus), index_drift(pages, entries),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    order = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("check")).cast("int")
    return out.withColumn("check_ord", order)


def report(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: ``page_count, errors, warnings, ok``; ok means no error, which an exit code follows."""
    counted = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return pages.agg(F.count("*").alias("page_count")).crossJoin(counted).withColumn("ok", F.col("errors") == 0)
