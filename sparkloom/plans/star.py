"""The star schema read as a graph: entities, relations, triples, and pages compiled from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.ontology import Ontology, Relation
from sparkloom.session import read_table

RELATIONS = [
    Relation("located_in", "located in", "contains", ("Nation",), ("Region",)),
    Relation("based_in", "based in", "home of", ("Customer", "Supplier"), ("Nation",)),
    Relation("placed_by", "placed by", "placed", ("Order",), ("Customer",)),
    Relation("includes", "includes", "included in", ("Order",), ("Part",)),
    Relation("supplied_by", "supplied by", "supplies", ("Part",), ("Supplier",)),
]
TYPES = ["Region", "Nation", "Customer", "Supplier", "Part", "Order"]
LABELS = [(r.predicate, r.label) for r in RELATIONS]

#: Planned questions over the geography, asked of the graph.
PLANS = [
    ("k1", ["ASIA"], "Supplier", ["Nation"], ["based_in", "located_in"], None),
    ("k2", ["EUROPE"], "Customer", ["Nation"], ["based_in"], None),
    ("k3", ["NATION_0", "NATION_1"], "Region", [], ["located_in"], None),
    ("k4", ["Supplier#000000001"], "Customer", ["Nation", "Region"], ["located_in"], None),
    ("k5", ["AFRICA"], "Nation", [], [], 2),
    ("k6", [], "Nation", [], [], None),
]
PLAN_SCHEMA = "q_id string, seeds array<string>, answer_type string, named_types array<string>, cues array<string>, hops int"


def order_name(key: str) -> Column:
    return F.concat(F.lit("Order#"), F.col(key).cast("string"))


def part_name(key: str) -> Column:
    return F.concat(F.lit("Part#"), F.col(key).cast("string"))


def supplier_name(key: str) -> Column:
    return F.concat(F.lit("Supplier#"), F.lpad(F.col(key).cast("string"), 9, "0"))


def geography_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read_table(spark, sf_dir, n)
    return (
        t("region").select(F.col("r_name").alias("name"), F.lit("Region").alias("type"))
        .union(t("nation").select("n_name", F.lit("Nation")))
        .union(t("customer").select("c_name", F.lit("Customer")))
        .union(t("supplier").select(supplier_name("s_suppkey"), F.lit("Supplier")))
    )


def _triple(rows: DataFrame, subject: Column, predicate: str, obj: Column, doc: Column) -> DataFrame:
    label = dict(LABELS)[predicate]
    return rows.select(
        subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), doc.alias("doc_id"),
        F.concat(subject, F.lit(f" {label} "), obj, F.lit(".")).alias("sentence"), doc.alias("triple_ord"),
    )


def geography_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read_table(spark, sf_dir, n)
    nation = t("nation")
    region = F.broadcast(t("region"))  # fixed: five rows
    nations = F.broadcast(nation)  # fixed: twenty-five rows
    tag = lambda kind, key: F.concat(F.lit(f"{kind}-"), F.col(key).cast("string"))
    return (
        _triple(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_name"), "located_in", F.col("r_name"), tag("nation", "n_nationkey"))
        .union(_triple(t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_name"), "based_in", F.col("n_name"), tag("customer", "c_custkey")))
        .union(_triple(t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")), supplier_name("s_suppkey"), "based_in", F.col("n_name"), tag("supplier", "s_suppkey")))
    )


def trade_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, parts and suppliers; the line items are the assertions behind an edge."""
    t = lambda n: read_table(spark, sf_dir, n)
    doc = F.concat(F.lit("line-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    placed = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        _triple(placed, order_name("o_orderkey"), "placed_by", F.col("c_name"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")))
        .union(_triple(t("lineitem"), order_name("l_orderkey"), "includes", part_name("l_partkey"), doc))
        .union(_triple(t("lineitem"), part_name("l_partkey"), "supplied_by", supplier_name("l_suppkey"), doc))
    )


def relation_frame(spark: SparkSession) -> DataFrame:
    return Ontology(TYPES, [], RELATIONS).relation_frame(spark).select("predicate", "label", "inverse_label")


def region_ontology(spark: SparkSession, sf_dir: str) -> Ontology:
    """Regions and nations (thirty rows, fixed) as a gazetteer for questions."""
    rows = [(r.r_name, "Region", ()) for r in read_table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    rows += [(r.n_name, "Nation", ()) for r in read_table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    return Ontology(TYPES, rows, RELATIONS)


def supply_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every part and supplier, with what the line items say of them.

    ``owned by`` names each supplier of a part, so parts of several suppliers contradict themselves; a part's sources are
    its orders; pages of suppliers cite nothing and say nothing back.
    """
    lines = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    of = lines.select("l_partkey", "l_suppkey").distinct()
    bullets = of.groupBy(F.col("l_partkey").alias("_p")).agg(F.array_sort(F.collect_list(supplier_name("l_suppkey"))).alias("s"))
    cited = lines.select("l_partkey", "l_orderkey").distinct().groupBy(F.col("l_partkey").alias("_q")).agg(F.array_sort(F.collect_list("l_orderkey")).alias("o"))
    rows = parts.join(bullets, F.col("p_partkey") == F.col("_p"), "left").join(cited, F.col("p_partkey") == F.col("_q"), "left")
    text = F.array_join(F.transform("s", lambda s: F.concat(F.lit("- owned by [["), s, F.lit("]]"))), "\n")
    sections = F.when(F.col("s").isNull(), F.array().cast("array<struct<heading:string,body:string>>")).otherwise(
        F.array(F.struct(F.lit("Relationships").alias("heading"), text.alias("body")))
    )
    page = rows.select(
        part_name("p_partkey").alias("title"), F.lit("entity").alias("page_type"), F.lit("Part").alias("entity_type"),
        F.coalesce(F.transform("o", lambda o: F.concat(F.lit("order-"), o.cast("string"))), F.array().cast("array<string>")).alias("sources"),
        F.lit("2020-01-01").cast("date").alias("updated"),
        F.concat(part_name("p_partkey"), F.lit(" is a "), F.lower("p_type"), F.lit(" part of "), F.col("p_brand"), F.lit(".")).alias("summary"), sections.alias("sections"),
    )
    supplier = read_table(spark, sf_dir, "supplier").where("s_suppkey % 10 != 0")
    plain = supplier.select(
        supplier_name("s_suppkey"), F.when(F.col("s_suppkey") % 7 == 0, F.lit("topic")).otherwise(F.lit("entity")), F.lit("Supplier"), F.array().cast("array<string>"),
        F.lit("2020-01-01").cast("date"), F.concat(supplier_name("s_suppkey"), F.lit(" supplies parts.")), F.array().cast("array<struct<heading:string,body:string>>"),
    )
    return page.union(plain)


def order_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated documents."""
    return read_table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.to_date("o_orderdate").alias("date")
    )


def drifted_catalogue(pages: DataFrame) -> DataFrame:
    """The pages' catalogue with some summaries changed, some entries lost and some left over."""
    n = F.regexp_extract("title", r"(\d+)$", 1).cast("long")
    summary = F.when(n % 11 == 3, F.concat("summary", F.lit(" (old)"))).otherwise(F.col("summary"))
    kept = pages.where(n % 13 != 5).select("title", summary.alias("summary"))
    return kept.union(pages.where(n % 17 == 4).select(F.concat("title", F.lit(" (gone)")), "summary"))
