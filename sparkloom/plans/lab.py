"""One place to build the three structures, store them, and ask them all."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import extraction
from sparkloom.operators import graph as G
from sparkloom.operators.chunking import chunk_documents
from sparkloom.operators.embedding import build_embedder
from sparkloom.operators.ontology import Ontology
from sparkloom.operators.ranking import BM25, check_aligned
from sparkloom.plans import answers, compiler, generate, kg, lint, pages, planner, rag, wiki
from sparkloom.sources.config import journal


class ArtefactMissing(RuntimeError):
    """A structure was asked before it was built."""


@dataclass(frozen=True)
class BuildStats:
    approach: str
    artefact: str
    count: int
    seconds: float
    note: str = ""


def summary_table(stats: list[BuildStats]) -> str:
    """Build results as aligned text."""
    rows = [("approach", "artefact", "count", "seconds", "note")]
    rows += [(s.approach, s.artefact, str(s.count), f"{s.seconds:.1f}", s.note) for s in stats]
    widths = [max(len(r[i]) for r in rows) for i in range(5)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)


class Lab:
    """``folder`` holds Parquet tables: chunks with vectors, triples, pages, catalogue, and the journal."""

    def __init__(self, spark: SparkSession, corpus: DataFrame, ontology: Ontology, folder: str, cfg: dict) -> None:
        self.spark, self.corpus, self.ontology, self.folder, self.cfg = spark, corpus, ontology, folder.rstrip("/"), cfg
        self.llm = generate.build_llm(cfg.get("llm", {"backend": "extractive"}))

    # building

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self._load(name)

    def _load(self, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as problem:
            raise ArtefactMissing(f"no {name} in {self.folder}; build it first with Lab.build_all()") from problem

    def _embedder(self, chunks: DataFrame):
        return build_embedder(self.cfg.get("embedding", {"backend": "hash"}), chunks)

    def build_index(self) -> BuildStats:
        began = time.perf_counter()
        chunks = self._store(chunk_documents(self.corpus, self.cfg.get("chunking", {"strategy": "paragraph"})), "chunks")
        vectors = self._store(self._embedder(chunks).encode(chunks, "chunk_id", "text"), "vectors")
        check_aligned(chunks, vectors)
        return BuildStats("rag", "chunks", chunks.count(), time.perf_counter() - began)

    def build_graph(self) -> BuildStats:
        began = time.perf_counter()
        triples = self._store(extraction.extract_triples(self.corpus, self.ontology), "triples")
        lone = extraction.orphan_entities(triples, self.ontology).count()
        return BuildStats("kg", "triples", triples.count(), time.perf_counter() - began, f"{lone} entities without an edge" if lone else "")

    def build_wiki(self, updated: str) -> BuildStats:
        began = time.perf_counter()
        topics = [compiler.Topic.of(t) for t in self.cfg.get("wiki", {}).get("topics", ())]
        made = self._store(compiler.compile_pages(self.corpus, self._load("triples"), self.ontology, updated, topics), "pages")
        self._store(pages.catalogue(made), "catalogue")
        n = made.count()
        journal(self.spark, self.folder, f"COMPILE {n} pages from {self.corpus.count()} documents")
        return BuildStats("wiki", "pages", n, time.perf_counter() - began)

    def build_all(self, updated: str) -> list[BuildStats]:
        return [self.build_index(), self.build_graph(), self.build_wiki(updated)]

    def write_markdown(self, folder: str) -> None:
        """Pages as Markdown files by slug, for readers outside the engine."""
        named = self._load("pages").select(pages.file_names().alias("file"), pages.render().alias("value"))
        named.write.mode("overwrite").partitionBy("file").text(folder)

    # asking

    def _labels(self) -> Column:
        return G.label_map([(r.predicate, r.label) for r in self.ontology.relations])

    def edges(self) -> DataFrame:
        return G.build_edges(self._load("triples"))

    def ask_rag(self, questions: DataFrame) -> DataFrame:
        chunks = self._load("chunks")
        asked = self._embedder(chunks).encode(questions, "q_id", "question")
        c = self.cfg.get("rag", {})
        return rag.answer(
            questions, chunks, asked, self._load("vectors"), llm=self.llm, mode=c.get("mode", "semantic"), k=c.get("top_k", 5), alpha=c.get("alpha", 0.65),
            threshold=c.get("low_confidence_threshold", 0.25),
        )

    def ask_kg(self, questions: DataFrame) -> DataFrame:
        c = self.cfg.get("kg", {})
        nodes = self.ontology.entity_frame(self.spark).select("name", "type")
        plans = planner.plan_questions(questions, self.ontology)
        return kg.answer(plans, nodes, self.edges(), self._labels(), self.llm, max_hops=c.get("max_hops", 4), max_answers=c.get("max_answers", 6))

    def ask_wiki(self, questions: DataFrame) -> DataFrame:
        c = self.cfg.get("wiki", {})
        return wiki.answer(
            questions, self._load("catalogue"), self._load("pages"), self.llm, max_pages=c.get("max_pages", 6), levels=c.get("backlink_expansion", 1)
        )

    def ask_all(self, questions: DataFrame) -> DataFrame:
        """Every question through every approach; one that breaks leaves an envelope saying so."""
        out = None
        for name, ask in (("rag", self.ask_rag), ("kg", self.ask_kg), ("wiki", self.ask_wiki)):
            began = time.perf_counter()
            try:
                got = self._store(ask(questions), f"answers/{name}")
            except Exception as problem:  # noqa: BLE001 - the others must still answer
                got = answers.failed(questions, name, str(problem).splitlines()[0], "q_id")
            total = round(1000 * (time.perf_counter() - began), 1)
            got = got.withColumn("ms", F.create_map(F.lit("total"), F.lit(total)))
            out = got if out is None else out.unionByName(got)
        return out

    def lint(self) -> DataFrame:
        relations = [(r.predicate, r.label, r.inverse_label) for r in self.ontology.relations]
        days = self.cfg.get("wiki", {}).get("stale_after_days", lint.STALE_DAYS)
        return lint.lint(self._load("pages"), self._load("catalogue"), self.corpus, relations, days)

    def status(self) -> dict[str, int]:
        """Sizes of what there is; a structure not built counts nothing."""
        found = {"documents": self.corpus.count()}
        for name in ("chunks", "triples", "pages"):
            try:
                found[name] = self._load(name).count()
            except ArtefactMissing:
                found[name] = 0
        return found

    def source(self, doc_id: str) -> DataFrame:
        return self.corpus.where(F.col("doc_id") == doc_id)

    def of_type(self, *doc_types: str) -> DataFrame:
        return self.corpus.where(F.col("doc_type").isin(*doc_types))

    def shown_config(self) -> dict:
        """The settings in which the three approaches differ, so that a reader can tell what gave an answer."""
        part = lambda name: self.cfg.get(name) or {}
        return {
            "embedding": part("embedding").get("backend", "hash"), "chunking": part("chunking").get("strategy", "paragraph"),
            "llm": part("llm").get("backend", "extractive"), "rag_mode": part("rag").get("mode", "semantic"), "rag_top_k": part("rag").get("top_k", 5),
            "kg_max_hops": part("kg").get("max_hops", 4), "wiki_max_pages": part("wiki").get("max_pages", 6),
        }


def light_path(found: DataFrame, key: str = "q_id", most: int = 8) -> DataFrame:
    """``key, rank, subject, predicate, object``: the edges that a route walks, in their own direction."""
    walked = found.where(F.col("rank") <= most).select(key, "rank", "start", "route", F.posexplode("route").alias("i", "s"))
    before = F.when(F.col("i") == 0, F.col("start")).otherwise(F.get("route", F.col("i") - 1)["target"])
    ends = F.when(F.col("s.inbound"), F.struct(F.col("s.target").alias("a"), before.alias("b"))).otherwise(F.struct(before.alias("a"), F.col("s.target").alias("b")))
    return walked.select(key, "rank", ends["a"].alias("subject"), F.col("s.predicate").alias("predicate"), ends["b"].alias("object"))


def cited_links(prose: Column, sources: Column) -> Column:
    """Documents named in brackets in a page's prose that the page cites."""
    named = F.regexp_extract_all(prose, F.lit(r"\(([a-z0-9][a-z0-9-]*)\)"), F.lit(1))
    return F.array_intersect(F.array_distinct(named), sources)
