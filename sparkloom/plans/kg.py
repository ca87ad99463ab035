"""Answers from the graph: plan, walk, and the path that got there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.plans.answers import envelope, ordered_distinct
from sparkloom.plans.generate import Extractive
from sparkloom.storage import table

# Weights of a path's score.
CUE, NAMED, PER_HOP = 2.5, 1.5, -0.6
MAX_HOPS, MAX_ANSWERS = 4, 6


def path_score(route: Column, types_between: Column, cues: Column, named: Column, target: Column) -> Column:
    """A price per hop, and once for each distinct cue used and each distinct named type passed on the way."""
    used = F.size(F.array_intersect(F.array_distinct(F.transform(route, lambda s: s["predicate"])), cues))
    wanted = F.when(target.isNull(), named).otherwise(F.array_remove(named, target))
    passed = F.size(F.array_intersect(F.array_distinct(types_between), wanted))
    return F.lit(PER_HOP) * F.size(route) + F.lit(CUE) * used + F.lit(NAMED) * passed


def _typed_paths(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """Simple paths with the types of their nodes, carried along step by step rather than joined per path."""
    kinds = nodes.select(F.col("name").alias("_name"), F.col("type").alias("_type"))
    walk = G.steps(edges).join(kinds, F.col("target") == F.col("_name")).select("node", "target", "predicate", "forward", "_type")
    walk = table(walk)
    none = F.array().cast("array<struct<target:string,predicate:string,inbound:boolean>>")
    paths = seeds.select("start", F.array("start").alias("nodes"), none.alias("route"), F.array().cast("array<string>").alias("types"))
    out = None
    for _ in range(max_hops):
        longer = paths.join(walk, F.element_at("nodes", -1) == walk.node).where(~F.array_contains("nodes", F.col("target")))
        step = F.struct("target", "predicate", (~F.col("forward")).alias("inbound"))
        paths = longer.select(
            "start", F.concat("nodes", F.array("target")).alias("nodes"), F.concat("route", F.array(step)).alias("route"),
            F.concat("types", F.array("_type")).alias("types"),
        )
        out = paths if out is None else out.union(paths)
    return out


def candidates(
    plans: DataFrame, nodes: DataFrame, edges: DataFrame, key: str = "q_id", max_hops: int = MAX_HOPS, max_answers: int = MAX_ANSWERS
) -> DataFrame:
    """``key, entity, score, start, nodes, route, rank``: for each question its best entities by their best path.

    The paths of a seed are expanded once for all questions. The best path of an entity is the first of the largest
    score in order of seeds, hops and steps; it is picked by an aggregate, combined map-side.
    """
    asked = plans.where("hops is null").select(key, "seeds", "answer_type", "named_types", "cues", F.posexplode("seeds").alias("seed_ord", "start"))
    asked = table(asked)
    paths = _typed_paths(asked.select("start").distinct(), nodes, edges, max_hops)
    rows = asked.join(paths, "start").withColumn("entity", F.element_at("nodes", -1))
    right = F.col("answer_type").isNull() | (F.element_at("types", -1) == F.col("answer_type"))
    rows = rows.where(right & ~F.array_contains("seeds", F.col("entity")))
    between = F.slice("types", F.lit(1), F.size("types") - 1)
    score = path_score(F.col("route"), between, F.col("cues"), F.col("named_types"), F.col("answer_type"))
    first = F.min(F.struct((-score).alias("minus"), "seed_ord", F.size("route").alias("hops"), "route", "start", "nodes"))
    best = rows.groupBy(key, "entity").agg(first.alias("b"))
    best = best.select(key, "entity", (-F.col("b.minus")).alias("score"), "b.start", "b.nodes", "b.route")
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("entity"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_answers)


def neighbourhood(plans: DataFrame, nodes: DataFrame, edges: DataFrame, key: str = "q_id") -> DataFrame:
    """``key, entity, type, distance, start, route, rank`` for questions with hops: nearest wins, first seed on ties."""
    asked = table(plans.where("hops is not null").select(key, "seeds", "answer_type", "hops", F.posexplode("seeds").alias("seed_ord", "start")))
    far = asked.agg(F.max("hops")).first()[0] or 0
    reach = G.neighbors_within(asked.select("start"), edges, far).join(
        nodes.select(F.col("name").alias("node"), "type"), "node"
    )
    rows = asked.join(reach, "start").where((F.col("distance") <= F.col("hops")) & ~F.array_contains("seeds", F.col("node")))
    rows = rows.where(F.col("answer_type").isNull() | (F.col("type") == F.col("answer_type")))
    first = F.min(F.struct("distance", "seed_ord", "start", "route", "type"))
    best = rows.groupBy(key, F.col("node").alias("entity")).agg(first.alias("b")).select(key, "entity", "b.type", "b.distance", "b.start", "b.route")
    w = Window.partitionBy(key).orderBy("distance", "entity")
    return best.withColumn("rank", F.row_number().over(w))


def blocks(found: DataFrame, edges: DataFrame, labels: Column, key: str = "q_id") -> DataFrame:
    """``key, rank, entity, render, doc_ids, text``: a route with the sentences it rests on."""
    walked = found.select(key, "rank", "entity", "start", "route", F.posexplode("route").alias("i", "s"))
    before = F.when(F.col("i") == 0, F.col("start")).otherwise(F.get("route", F.col("i") - 1)["target"])
    ends = walked.select(
        key, "rank", "i",
        F.when(F.col("s.inbound"), F.col("s.target")).otherwise(before).alias("subject"),
        F.col("s.predicate").alias("predicate"),
        F.when(F.col("s.inbound"), before).otherwise(F.col("s.target")).alias("object"),
    )
    first = edges.select("subject", "predicate", "object", F.col("sources")[0].alias("src"))
    hops = ends.join(first, ["subject", "predicate", "object"]).groupBy(key, "rank").agg(F.array_sort(F.collect_list(F.struct("i", "src"))).alias("h"))
    rows = found.join(hops, [key, "rank"])
    render = G.render_path(F.col("start"), F.col("route"), labels)
    rows = rows.withColumn("render", render).withColumn("doc_ids", F.array_distinct(F.transform("h", lambda x: x["src"]["doc_id"])))
    quoted = F.transform("h", lambda x: F.concat(F.lit('"'), x["src"]["sentence"], F.lit('"')))
    return rows.withColumn("text", F.array_join(F.concat(F.array("render"), quoted), "\n")).drop("h")


def _no_path(max_hops: int) -> Column:
    target = F.when(F.col("answer_type").isNull(), F.lit("anything")).otherwise(F.concat(F.lit("any "), F.col("answer_type")))
    nothing = "No entity in this question matches anything in the ontology, so there is nowhere in the graph to start looking."
    lost = F.concat(F.lit(f"No path of {max_hops} hops or fewer connects "), F.array_join("seeds", ", "), F.lit(" to "), target, F.lit(" in the graph."))
    return F.when(F.size("seeds") == 0, F.lit(nothing)).otherwise(lost)


def answer(
    plans: DataFrame, nodes: DataFrame, edges: DataFrame, labels: Column, llm=None, key: str = "q_id",
    max_hops: int = MAX_HOPS, max_answers: int = MAX_ANSWERS,
) -> DataFrame:
    """The envelope for each planned question. Only the best path is evidence; a neighbourhood is shown whole.

    Equal best scores are admitted instead of answered.
    """
    plans = table(plans)
    best = table(candidates(plans, nodes, edges, key, max_hops, max_answers))
    near = neighbourhood(plans, nodes, edges, key)
    top = best.groupBy(key).agg(
        F.count("*").alias("n_found"),
        F.max(F.when(F.col("rank") == 1, F.struct("score", "entity"))).alias("one"),
        F.max(F.when(F.col("rank") == 2, F.struct("score", "entity"))).alias("two"),
    )
    shown = best.where("rank = 1").select(key, "rank", "entity", "start", "route").unionByName(near.select(key, "rank", "entity", "start", "route"))
    made = blocks(shown, edges, labels, key)
    item = F.struct("rank", "render", "doc_ids", "text")
    evidence = made.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("b"))
    rows = plans.join(top, key, "left").join(evidence, key, "left").withColumn("b", F.coalesce("b", F.array().cast(evidence.schema["b"].dataType)))
    rows = rows.withColumn("evidence", F.transform("b", lambda x: F.struct(F.array_join(x["doc_ids"], ", ").alias("citation"), x["text"].alias("text"))))
    rows = (llm or Extractive()).generate(rows)
    tie = F.col("one.score") == F.col("two.score")
    tied = F.concat(
        F.lit("The graph found two equally good routes, to "), F.col("one.entity"), F.lit(" and "), F.col("two.entity"),
        F.lit(". Neither is better supported than the other."),
    )
    empty = F.size("b") == 0
    detail = F.to_json(
        F.struct(
            F.when(F.col("hops").isNull(), F.lit("path")).otherwise(F.lit("neighbourhood")).alias("query"),
            "seeds", "answer_type", "named_types", "cues", F.lit(max_hops).alias("max_hops"), "hops",
            F.col("one.entity").alias("answer_entity"), F.round("one.score", 2).alias("score"),
            F.when(F.col("hops").isNull() & ~empty, F.struct(F.col("b")[0]["render"].alias("render"))).alias("path"),
        )
    )
    none = F.lit("no known entity")
    counted = F.when(F.col("hops").isNull(), F.coalesce("n_found", F.lit(0))).otherwise(F.size("b")).cast("string")
    trace = F.array(
        F.concat(F.lit("Matched the question against the gazetteer: "), F.when(F.size("seeds") > 0, F.array_join("seeds", ", ")).otherwise(none), F.lit(".")),
        F.concat(F.lit("Read the answer type as "), F.coalesce("answer_type", F.lit("unconstrained")), F.lit(".")),
        F.concat(F.lit("Took "), F.when(F.size("cues") > 0, F.array_join("cues", ", ")).otherwise(F.lit("no")), F.lit(" relation(s) as cues from the question's verbs.")),
        F.concat(F.lit("Found "), counted, F.lit(" route(s).")),
    )
    confident = ~empty & ~F.coalesce(tie, F.lit(False))
    note = F.when(empty, _no_path(max_hops)).when(tie, tied).otherwise(F.col("generation_note"))
    size = F.aggregate(F.col("b"), F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"]))
    rows = rows.withColumns(
        {
            "answer": F.when(empty, _no_path(max_hops)).otherwise(F.col("answer")),
            "citations": ordered_distinct(F.transform("b", lambda x: x["doc_ids"])),
            "trace": trace, "detail": detail, "tokens_est": F.floor(size / 4).cast("long"), "confident": confident, "note": note,
        }
    )
    return envelope(rows, "kg", key)
