"""A typed multigraph of triples: edges with their sources, facts, neighbourhoods and simple paths.

``nodes(name, type)``; ``edges(subject, predicate, object, sources, n_sources)`` with ``sources`` an ordered array of
struct(doc_id, sentence), and their number where edges are built here; ``relations(predicate, label, inverse_label)``. Walks ignore direction; rendering keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.components import connected_components
from sparkloom.storage import table

MAX_HOPS = 4


def build_edges(triples: DataFrame, order: str = "triple_ord") -> DataFrame:
    """One edge for each (subject, predicate, object), with every assertion of it in order, and their number.

    A plan that reads the number alone gathers no assertion: they are counted map-side.
    """
    each = F.struct(F.col(order).alias("ord"), "doc_id", "sentence")
    grouped = triples.groupBy("subject", "predicate", "object").agg(F.array_sort(F.collect_list(each)).alias("_s"), F.count("*").alias("n_sources"))
    return grouped.select("subject", "predicate", "object", F.transform("_s", lambda s: F.struct(s["doc_id"], s["sentence"])).alias("sources"), "n_sources")


def doc_ids(sources: Column) -> Column:
    return F.array_distinct(F.transform(sources, lambda s: s["doc_id"]))


def match(edges: DataFrame, subject: str | None = None, predicate: str | None = None, object: str | None = None) -> DataFrame:
    """Edges that fit a pattern; None fits anything."""
    for name, value in (("subject", subject), ("predicate", predicate), ("object", object)):
        if value is not None:
            edges = edges.where(F.col(name) == value)
    return edges


def edge(edges: DataFrame, subject: str, predicate: str, object: str) -> DataFrame:
    return match(edges, subject, predicate, object)


def steps(edges: DataFrame, *keep: str) -> DataFrame:
    """Both directions of every edge: ``node, target, predicate, forward`` and ``keep``. A self-loop has two."""
    out = edges.select(F.col("subject").alias("node"), F.col("object").alias("target"), "predicate", F.lit(True).alias("forward"), *keep)
    back = edges.select(F.col("object").alias("node"), F.col("subject").alias("target"), "predicate", F.lit(False).alias("forward"), *keep)
    return out.union(back)


def facts(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Each edge seen from both ends: ``entity, label, other, outbound, predicate, sources``.

    An inbound edge borrows the inverse label.
    """
    seen = steps(edges, "sources").join(F.broadcast(relations), "predicate")
    label = F.when(F.col("forward"), F.col("label")).otherwise(F.col("inverse_label"))
    return seen.select(F.col("node").alias("entity"), label.alias("label"), F.col("target").alias("other"), F.col("forward").alias("outbound"), "predicate", "sources")


def render_fact() -> Column:
    return F.concat_ws(" ", "entity", "label", "other")


def _step_key() -> Column:
    """Order of a step: target, then predicate, outbound first."""
    return F.struct("target", "predicate", (~F.col("forward")).alias("inbound"))


def neighbors_within(seeds: DataFrame, edges: DataFrame, hops: int, key: str = "start") -> DataFrame:
    """``start, node, distance, route``: all nodes at most ``hops`` away, with their shortest route.

    ``seeds`` has column ``key``. The route is the least of the shortest ones in order of its steps, as a queue over sorted
    steps would find it. One join per level, until one adds no node; visited nodes are dropped before they are walked on. Filter
    types on the result: a walk may cross any type.
    """
    walk = table(steps(edges))
    visited = seeds.select(F.col(key).alias("start")).distinct().join(walk.select("node").distinct(), F.col("start") == F.col("node"), "left_semi")
    none = F.array().cast("array<struct<target:string,predicate:string,inbound:boolean>>")
    visited = table(visited.select("start", F.col("start").alias("node"), F.lit(0).alias("distance"), none.alias("route")))
    frontier = visited
    for level in range(1, hops + 1):
        reached = frontier.select("start", F.col("node").alias("_from"), "route").join(walk, F.col("_from") == walk.node)
        reached = reached.select("start", F.col("target").alias("node"), F.concat("route", F.array(_step_key())).alias("route"))
        fresh = reached.join(visited.select("start", "node"), ["start", "node"], "left_anti")
        frontier = table(fresh.groupBy("start", "node").agg(F.min("route").alias("route")).select("start", "node", F.lit(level).alias("distance"), "route"))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return visited.where("distance > 0")


def simple_paths(seeds: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS, key: str = "start") -> DataFrame:
    """``start, nodes, route``: every path of 1 to ``max_hops`` steps without a repeated node.

    One unrolled join per level, from each seed once; parallel edges give paths of their own. Order by
    (hops, route) to have them as a queue over sorted steps would.
    """
    walk = table(steps(edges))
    none = F.array().cast("array<struct<target:string,predicate:string,inbound:boolean>>")
    paths = seeds.select(F.col(key).alias("start")).distinct().select("start", F.array("start").alias("nodes"), none.alias("route"))
    levels = []
    for _ in range(max_hops):
        longer = paths.join(walk, F.element_at("nodes", -1) == walk.node).where(~F.array_contains("nodes", F.col("target")))
        paths = longer.select("start", F.concat("nodes", F.array("target")).alias("nodes"), F.concat("route", F.array(_step_key())).alias("route"))
        levels.append(paths)
    out = levels[0]
    for p in levels[1:]:
        out = out.union(p)
    return out


def render_path(start: Column, route: Column, labels: Column) -> Column:
    """``A -[label]-> B <-[label]- C``: the arrow turns, never the label. ``labels`` maps predicates to labels."""
    hop = lambda s: F.concat(
        F.when(s["inbound"], F.lit(" <-[")).otherwise(F.lit(" -[")),
        F.element_at(labels, s["predicate"]),
        F.when(s["inbound"], F.lit("]- ")).otherwise(F.lit("]-> ")),
        s["target"],
    )
    return F.concat(start, F.array_join(F.transform(route, hop), ""))


def label_map(relations: list[tuple[str, str]]) -> Column:
    """Map literal from predicate to label."""
    return F.create_map(*(F.lit(x) for kv in relations for x in kv))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component, size``: connected components without direction; lone nodes are their own."""
    labels = connected_components(edges.select("subject", "object"), "subject", "object")
    all_nodes = nodes.select(F.col("name").alias("node"))
    named = all_nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("component").agg(F.count("*").alias("size"))
    return named.join(sizes, "component").select("node", "component", "size")


def component_sizes(labelled: DataFrame) -> DataFrame:
    """``component, size, rank``: largest first."""
    sizes = labelled.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "component")))


def graph_json(nodes: DataFrame, edges: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON for a renderer: nodes with their type, edges with label, first source and all documents."""
    node = nodes.select(F.col("name").alias("id"), "type").select("id", F.to_json(F.struct("id", "type")).alias("json"))
    e = edges.join(F.broadcast(relations), "predicate")
    fields = F.struct(
        F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", "label",
        F.col("sources")[0]["sentence"].alias("sentence"), F.col("sources")[0]["doc_id"].alias("doc_id"), doc_ids(F.col("sources")).alias("doc_ids"),
    )
    return node, e.select("subject", "predicate", "object", F.to_json(fields).alias("json"))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree``: edge ends at each node."""
    return steps(edges).groupBy("node").agg(F.count("*").alias("degree"))


def parallel_groups(edges: DataFrame) -> DataFrame:
    """``a, b, n, predicates``: edges that share an unordered pair."""
    pair = edges.select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"), "predicate")
    return pair.groupBy("a", "b").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("predicate")).alias("predicates"))
