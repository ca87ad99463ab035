"""Answers from compiled pages: scan the catalogue, follow links, read whole pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import stems
from sparkloom.plans.answers import envelope, ordered_distinct
from sparkloom.plans.generate import Extractive
from sparkloom.plans.pages import body, link_rows
from sparkloom.storage import table

# Weights of the scan.
TITLE, PHRASE, COMMON = 3.0, 3.0, 0.25
MAX_PAGES, EXPANSION = 6, 1
NOTHING = "No page in this wiki covers that. The index has nothing whose title or summary is specific to the question."


def scan(questions: DataFrame, entries: DataFrame, titles: DataFrame, key: str = "q_id", question: str = "question") -> DataFrame:
    """``key, title, score, hits, rank``: catalogue entries on a distinctive stem of the question.

    Stems are an inverted index: questions meet entries on equal stems, each pair once. A stem is distinctive if at
    most a quarter of the entries hold it.
    """
    each = entries.select("title", stems(F.col("title")).alias("_t"), stems(F.col("summary")).alias("_s"))
    each = each.withColumn("stem", F.explode(F.array_union("_t", "_s")))
    each = each.select("title", "stem", F.array_contains("_t", F.col("stem")).alias("in_title"), F.array_contains("_s", F.col("stem")).alias("in_summary"))
    total = entries.agg(F.greatest(F.count("*"), F.lit(1)).cast("double").alias("total"))
    df = each.groupBy("stem").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    df = df.select("stem", "df", F.log(1 + F.col("total") / F.col("df")).alias("w"), (F.col("df") <= F.greatest(F.lit(1.0), F.col("total") * COMMON)).alias("rare"))
    posted = each.join(titles.select("title"), "title", "left_semi").join(df, "stem")
    asked = questions.select(key, F.lower(question).alias("_q"), F.explode(stems(F.col(question))).alias("stem"))
    met = asked.join(posted, "stem").groupBy(key, "_q", "title").agg(
        F.sum(F.col("w") * (F.when(F.col("in_title"), TITLE).otherwise(0.0) + F.when(F.col("in_summary"), 1.0).otherwise(0.0))).alias("_w"),
        F.array_sort(F.collect_set("stem")).alias("hits"),
        F.max("rare").alias("_rare"),
    )
    whole = F.when(F.col("_q").contains(F.lower("title")), PHRASE).otherwise(0.0)
    rows = met.where("_rare").select(key, "title", F.round(F.col("_w") + whole, 9).alias("score"), "hits")
    w = Window.partitionBy(key).orderBy(F.desc(F.size("hits")), F.desc("score"), F.asc("title"))
    return rows.withColumn("rank", F.row_number().over(w))


def follow(seeds: DataFrame, pages: DataFrame, levels: int = EXPANSION, key: str = "q_id") -> DataFrame:
    """``key, title, level, ord``: pages linked from the seeds, level by level, in link order, each once."""
    links = table(link_rows(pages).join(pages.select(F.col("title").alias("target")), "target", "left_semi"))
    seen = seeds.select(key, "title")
    frontier = seeds.select(key, "title", F.array(F.col("rank").cast("long")).alias("ord"))
    out = None
    for level in range(1, levels + 1):
        reached = frontier.join(links, "title").select(key, F.col("target").alias("title"), F.concat("ord", F.array(F.col("pos").cast("long"))).alias("ord"))
        fresh = reached.join(seen, [key, "title"], "left_anti").groupBy(key, "title").agg(F.min("ord").alias("ord"))
        frontier = table(fresh)
        found = frontier.select(key, "title", F.lit(level).alias("level"), "ord")
        out = found if out is None else out.union(found)
        seen = seen.union(frontier.select(key, "title"))
    if out is None:
        out = seeds.where("false").select(key, "title", F.lit(0).alias("level"), F.array(F.lit(0).cast("long")).alias("ord"))
    return out


def read(matches: DataFrame, pages: DataFrame, max_pages: int = MAX_PAGES, levels: int = EXPANSION, key: str = "q_id") -> DataFrame:
    """``key, title, pos``: the best matches, then what they link to, within the page budget."""
    seeds = table(matches.where(F.col("rank") <= max_pages).select(key, "title", "rank"))
    followed = follow(seeds, pages, levels, key)
    none = F.array().cast("array<bigint>")
    both = seeds.select(key, "title", F.lit(0).alias("level"), F.array(F.col("rank").cast("long")).alias("ord")).union(followed.select(key, "title", "level", F.coalesce("ord", none)))
    w = Window.partitionBy(key).orderBy("level", "ord")
    return both.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max_pages).select(key, "title", "pos")


def answer(questions: DataFrame, entries: DataFrame, pages: DataFrame, llm=None, max_pages: int = MAX_PAGES, levels: int = EXPANSION, key: str = "q_id") -> DataFrame:
    """The envelope for each question of ``questions(q_id, question)``."""
    matches = table(scan(questions, entries, pages, key))
    opened = read(matches, pages, max_pages, levels, key)
    text = pages.select("title", "sources", body().alias("text"))
    packed = opened.join(text, "title").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "title", "sources", "text"))).alias("p"))
    best = matches.groupBy(key).agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.struct("title", "hits"))).alias("best"))
    rows = questions.join(packed, key, "left").join(best, key, "left")
    rows = rows.withColumn("p", F.coalesce("p", F.array().cast(packed.schema["p"].dataType)))
    rows = rows.withColumn("evidence", F.transform("p", lambda x: F.struct(x["title"].alias("citation"), x["text"].alias("text"))))
    rows = (llm or Extractive()).generate(rows)
    some = F.size("p") > 0
    trace = F.array_compact(
        F.array(
            F.lit("Scanned the catalogue: page titles and summaries, no page bodies."),
            F.when(some, F.concat(F.col("n").cast("string"), F.lit(" page(s) matched on a distinctive term."))).otherwise(
                F.lit("No page matched on any term specific enough to open it.")
            ),
            F.when(some, F.concat(F.lit("Best match: "), F.col("best.title"), F.lit(" (on "), F.array_join("best.hits", ", "), F.lit(")."))),
            F.when(some, F.concat(F.lit("Read "), F.size("p").cast("string"), F.lit(" whole page(s) as evidence."))),
        )
    )
    size = F.aggregate(F.col("p"), F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"]))
    detail = F.to_json(F.struct(F.coalesce("n", F.lit(0)).alias("matched"), F.transform("p", lambda x: x["title"]).alias("pages_read"), F.lit(max_pages).alias("max_pages")))
    rows = rows.withColumns(
        {
            "answer": F.when(some, F.col("answer")).otherwise(F.lit(NOTHING)), "citations": ordered_distinct(F.transform("p", lambda x: x["sources"])), "trace": trace,
            "detail": detail, "tokens_est": F.floor(size / 4).cast("long"), "confident": some, "note": F.when(~some, F.lit(NOTHING)),
        }
    )
    return envelope(rows, "wiki", key)
