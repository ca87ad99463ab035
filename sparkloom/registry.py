"""Queries over the driver's tables, each with its result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.vectors import dot
from sparkloom.operators import chunking, embedding, extraction, ranking
from sparkloom.operators import graph as G
from sparkloom.operators.ontology import Ontology, Relation, mentions
from sparkloom.plans import answers, compiler, kg, lint, pages, planner, rag, star, wiki
from sparkloom.plans.generate import prompt
from sparkloom.session import read_table
from sparkloom.sources.corpus import corpus_from_table
from sparkloom.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return put


# --- text in SQL ---------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _collapse(c: str) -> str:
    return _strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")


def _sentences(c: str) -> str:
    held = f"regexp_replace(p, {_sql_re(T.AFTER_SHORT)}, '\\1\\2\\3' || chr(2), 'g')"
    held = f"regexp_replace({held}, {_sql_re(T.AFTER_SHORT)}, '\\1\\2\\3' || chr(2), 'g')"
    cut = f"replace(regexp_replace({held}, {_sql_re(T.AFTER_END)}, '\\1' || chr(1), 'g'), chr(2), ' ')"
    paragraphs = f"list_filter(list_transform(string_split_regex(coalesce({c}, ''), '\\n\\s*\\n'), lambda x: {_collapse('x')}), lambda x: x <> '')"
    return f"flatten(list_transform({paragraphs}, lambda p: list_filter(string_split({cut}, chr(1)), lambda s: s <> '')))"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def _terms(c: str) -> str:
    found = f"list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9][A-Za-z0-9-]*'), lambda x: lower(x))"
    return f"list_filter(list_distinct({found}), lambda x: NOT list_contains({_list(T.STOPWORDS)}, x))"


def _stem(c: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({c}, '^.{{4,}}{s}$') THEN left({c}, len({c}) - {len(s)})" for s in T.SUFFIXES)
    return f"CASE {whens} ELSE {c} END"


def _stems(c: str) -> str:
    return f"list_distinct(list_transform({_terms(c)}, lambda w: {_stem('w')}))"


def _paragraphs(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, '\\n\\s*\\n'), lambda x: {_strip('x')}), lambda x: x <> '')"


_BODY = _strip("coalesce(text, '')")
_TITLE = _strip("string_split(text, chr(10))[1]")
_CHUNKS = f"""chunks AS (
  SELECT doc_id || '#' || (i - 1) AS chunk_id, doc_id, ps[i] AS text, doc_id AS doc_ord FROM (
    SELECT doc_id, {_paragraphs(_BODY)} AS ps, unnest(range(1, len({_paragraphs(_BODY)}) + 1)) AS i FROM documents))"""


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from_table(read_table(spark, sf_dir, "documents"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_corpus(spark, sf_dir), {"strategy": "paragraph"})


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


# --- text ----------------------------------------------------------------------


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_TITLE} AS title, lang AS doc_type, len({_BODY}) AS body_chars FROM documents")
def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("doc_id", "title", "doc_type", F.length("body").cast("long").alias("body_chars"))


@query(f"SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents))")
def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, md5(array_to_string({_tokens('text')}, ' ')) AS tokens_md5, len(text) // 4 AS tokens_est FROM documents")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"), T.estimate_tokens(F.array("text")).alias("tokens_est"))


@query(f"SELECT doc_id, array_to_string(list_sort({_terms('text')}), ' ') AS terms FROM documents")
def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.terms(F.col("text"))), " ").alias("terms"))


@query(f"SELECT doc_id, array_to_string(list_sort({_stems('text')}), ' ') AS stems FROM documents")
def doc_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.stems(F.col("text"))), " ").alias("stems"))


@query(
    f"""SELECT doc_id, regexp_replace(regexp_replace(lower({_TITLE}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
    coalesce(({_sentences(_BODY)})[1], {_TITLE}) AS first_sentence, {_collapse(f"string_split({_BODY}, chr(10) || chr(10))[1]")} AS opening FROM documents"""
)
def doc_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return c.select(
        F.col("doc_ord").alias("doc_id"), T.slug(F.col("title")).alias("slug"), T.first_sentence(F.col("body"), F.col("title")).alias("first_sentence"),
        T.opening(F.col("body")).alias("opening"),
    )


@query(f"WITH {_CHUNKS} SELECT chunk_id, text FROM chunks")
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", "text")


@query(
    f"""SELECT doc_id || '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1) AS chunk_id, array_to_string(ss[s + 1:s + 3], ' ') AS text FROM (
      SELECT doc_id, ss, unnest(range(0, len(ss), 2)) AS s FROM (SELECT doc_id, {_sentences(_BODY)} AS ss FROM documents))
    WHERE s = 0 OR s - 2 + 3 < len(ss)"""
)
def chunk_sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_corpus(spark, sf_dir), {"strategy": "sentence_window"}).select("chunk_id", "text")


@query(
    f"""SELECT doc_id || '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1) AS chunk_id, text FROM (
      SELECT doc_id, s, {_strip('b[s + 1:s + 900]')} AS text FROM (
        SELECT doc_id, b, unnest(range(0, len(b), 750)) AS s FROM (SELECT doc_id, {_BODY} AS b FROM documents)) WHERE s = 0 OR s - 750 + 900 < len(b)) WHERE text <> ''"""
)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_corpus(spark, sf_dir), {"strategy": "fixed"}).select("chunk_id", "text")


# --- vectors and ranking -----------------------------------------------------------

_DIM = 64
_BUCKET = f"CAST(('0x' || left(md5(t), 15)) AS BIGINT) % {_DIM}"


def _hashed(src: str, key: str, text: str) -> str:
    return f"""(SELECT {key}, b, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM (
      SELECT {key}, {_BUCKET} AS b, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest({_tokens(text)}) AS t FROM {src}) GROUP BY ALL))"""


@query(f"SELECT doc_id, b AS bucket, round(x, 6) AS weight FROM {_hashed('documents', 'doc_id', 'text')}")
def embed_hash_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = embedding.hash_embed(read_table(spark, sf_dir, "documents"), ["doc_id"], "text", _DIM, "md5")
    each = v.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight > 0")
    return each.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", 6).alias("weight"))


@query()
def embed_hash_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = embedding.hash_embed(read_table(spark, sf_dir, "documents"), ["doc_id"], "text", _DIM)
    each = v.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight > 0")
    return each.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", 6).alias("weight"))


@query()
def embed_lsa_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    v = table(embedding.TfidfSvd(32).fit(docs, "doc_id", "text").encode_fitted())
    first = v.orderBy("doc_id").limit(1).select(F.col("embedding").alias("_first"))  # one row
    return v.crossJoin(F.broadcast(first)).select("doc_id", F.round(dot(F.col("embedding"), F.col("_first")), 3).alias("cosine_to_first"))


@query(
    f"""WITH c AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS t FROM documents)
      WHERE len(t) > 1 AND NOT list_contains({_list(T.STOPWORDS)}, t) GROUP BY ALL),
    i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM c GROUP BY term),
    r AS (SELECT doc_id, term, tf * idf AS raw FROM c JOIN i USING (term))
    SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r"""
)
def embed_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, _ = embedding.tfidf(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    """WITH s AS (SELECT q.vec_id AS q_id, v.vec_id AS vec_id,
      round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS score
      FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT q_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    top = ranking.cosine_topk(q, v, "q_id", "vec_id", 5)
    return top.select("q_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_BM = f"""{_CHUNKS},
p AS (SELECT chunk_id, t AS term, count(*) AS tf FROM (SELECT chunk_id, unnest({_tokens('text')}) AS t FROM chunks) GROUP BY ALL),
l AS (SELECT chunk_id, doc_ord, len({_tokens('text')}) AS length FROM chunks),
st AS (SELECT count(*) AS n, avg(length) AS avg_len FROM l),
idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY term),
q AS (SELECT item_id AS q_id, t AS term, count(*) AS m FROM (SELECT item_id, unnest({_tokens('text')}) AS t FROM benchmark) GROUP BY ALL),
h AS (SELECT q_id, chunk_id, round(sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT avg_len FROM st)))), 9) AS score
  FROM q JOIN idf USING (term) JOIN p USING (term) JOIN l USING (chunk_id) GROUP BY ALL),
a AS (SELECT item_id AS q_id, l.chunk_id, doc_ord, coalesce(score, 0) AS score FROM benchmark CROSS JOIN l LEFT JOIN h ON h.q_id = item_id AND h.chunk_id = l.chunk_id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_ord) AS rank FROM a) WHERE rank <= 5)"""


@query(f"WITH {_BM} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.BM25(_chunks(spark, sf_dir)).idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM} SELECT q_id, chunk_id, round(score, 6) AS score, rank FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.BM25(_chunks(spark, sf_dir)).search(_questions(spark, sf_dir), "q_id", "question")
    return top.select("q_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_SEM = f"""qv AS {_hashed('benchmark', 'item_id', 'text')}, cv AS {_hashed('chunks', 'chunk_id', 'text')},
d AS (SELECT item_id AS q_id, chunk_id, round(sum(qv.x * cv.x), 9) AS score FROM qv JOIN cv USING (b) GROUP BY ALL),
sa AS (SELECT item_id AS q_id, l.chunk_id, doc_ord, coalesce(score, 0) AS score FROM benchmark CROSS JOIN l LEFT JOIN d ON d.q_id = item_id AND d.chunk_id = l.chunk_id),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_ord) AS rank FROM sa) WHERE rank <= 5)"""


def _vectors(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    q = embedding.hash_embed(_questions(spark, sf_dir), ["q_id"], "question", _DIM, "md5")
    return q, embedding.hash_embed(chunks, ["chunk_id", "doc_ord"], "text", _DIM, "md5")


_FUSED = """s2 AS (SELECT q_id, chunk_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS s FROM sem WINDOW w AS (PARTITION BY q_id)),
    l2 AS (SELECT q_id, chunk_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS s FROM lex WINDOW w AS (PARTITION BY q_id)),
    fu AS (SELECT q_id, chunk_id, round(0.65 * coalesce(s2.s, 0) + 0.35 * coalesce(l2.s, 0), 9) AS score FROM s2 FULL JOIN l2 USING (q_id, chunk_id))"""


@query(f"WITH {_BM}, {_SEM}, {_FUSED} SELECT * FROM fu")
def hybrid_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(_chunks(spark, sf_dir))
    q, v = _vectors(spark, sf_dir, chunks)
    semantic = ranking.cosine_topk(q, v, "q_id", "chunk_id", 5, order="doc_ord")
    lexical = ranking.BM25(chunks).search(_questions(spark, sf_dir), "q_id", "question")
    return ranking.fuse(semantic, lexical, "q_id", "chunk_id").select("q_id", "chunk_id", "score")


@query(f"WITH {_BM}, {_SEM} SELECT q_id, round(max(score), 6) AS top_score, max(score) >= 0.25 AS confident FROM sem GROUP BY q_id")
def rag_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir, _chunks(spark, sf_dir))
    found = ranking.confidence(_questions(spark, sf_dir), ranking.cosine_topk(q, v, "q_id", "chunk_id", 5, order="doc_ord"), "q_id")
    return found.select("q_id", F.round("top_score", 6).alias("top_score"), "confident")


def _rag(spark: SparkSession, sf_dir: str, mode: str = "lexical") -> DataFrame:
    chunks = table(_chunks(spark, sf_dir))
    q, v = _vectors(spark, sf_dir, chunks)
    return rag.answer(_questions(spark, sf_dir), chunks, q, v, mode=mode)


def _stitch(ranked: str) -> str:
    return f"e AS (SELECT q_id, rank AS n, doc_id, text FROM {ranked} JOIN chunks USING (chunk_id)), {_QUOTED}"


_QUOTED = f"""ss AS (SELECT q_id, n, unnest(range(1, len(s) + 1)) AS j, s FROM (SELECT q_id, n, {_sentences('text')} AS s FROM e)),
sc AS (SELECT q_id, n, j, s[j] AS s, len(list_intersect({_terms('b.text')}, {_terms('s[j]')})) AS o FROM ss JOIN benchmark b ON b.item_id = q_id),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY o DESC, n, j) AS k FROM sc) WHERE k <= 6)"""


_ANSWER = """SELECT q_id, string_agg(s || ' [' || n || ']', ' ' ORDER BY n, j) AS answer,
      (SELECT string_agg(doc_id, ',' ORDER BY f) FROM (SELECT doc_id, min(n) AS f FROM e WHERE e.q_id = kept.q_id GROUP BY doc_id)) AS citations,
      (SELECT sum(len(text)) FROM e WHERE e.q_id = kept.q_id) // 4 AS tokens_est FROM kept GROUP BY q_id"""


@query(f"WITH {_BM}, {_stitch('lex')} {_ANSWER}")
def rag_answer_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rag(spark, sf_dir).select("q_id", "answer", F.array_join("citations", ",").alias("citations"), "tokens_est")


@query(f"WITH {_BM}, {_SEM}, {_stitch('sem')} {_ANSWER}")
def rag_answer_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rag(spark, sf_dir, "semantic").select("q_id", "answer", F.array_join("citations", ",").alias("citations"), "tokens_est")


@query(
    f"""WITH {_BM}, {_SEM}, {_FUSED},
    fus AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM fu), {_stitch('fus')} {_ANSWER}"""
)
def rag_answer_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rag(spark, sf_dir, "hybrid").select("q_id", "answer", F.array_join("citations", ",").alias("citations"), "tokens_est")


@query(
    f"""WITH {_BM} SELECT q_id, 'Answer the question using only the numbered evidence below.' || chr(10) ||
      'Cite the evidence you use as [1], [2] and so on, directly after the claim it supports.' || chr(10) ||
      'If the evidence does not contain the answer, say so plainly rather than guessing.' || chr(10) || chr(10) || 'Evidence:' || chr(10) ||
      string_agg('[' || rank || '] (' || doc_id || ') ' || c.text, chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(b.text) || chr(10) || chr(10) || 'Answer:' AS prompt
    FROM lex JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = q_id GROUP BY q_id"""
)
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(_chunks(spark, sf_dir))
    hits = ranking.BM25(chunks).search(_questions(spark, sf_dir), "q_id", "question").join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
    ev = hits.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("citation"), "text"))).alias("e"))
    return _questions(spark, sf_dir).join(ev, "q_id").select("q_id", prompt(F.col("question"), F.col("e")).alias("prompt"))


# --- extraction ---------------------------------------------------------------------

#: Words of the documents as a small ontology, with relations between neighbours.
WORDS = Ontology(
    ["Article", "Preposition", "Verb", "Pronoun", "Unused"],
    [("the", "Article", ("The",)), ("a", "Article", ()), ("in", "Preposition", ("In",)), ("on", "Preposition", ()), ("with", "Preposition", ()),
     ("is", "Verb", ("Is",)), ("was", "Verb", ()), ("it", "Pronoun", ("It",)), ("this", "Pronoun", ("This",)), ("zyzzyva", "Unused", ())],
    [Relation("before", "before", "after", ("Preposition", "Verb"), ("Article", "Pronoun", "Preposition"), ("{s} {o}",)),
     Relation("joined_to", "joined to", "joined to", ("Verb",), ("Pronoun",), ("{s} and {o}||inverse", "of {o}",)),
     Relation("never", "never", "never by", ("Unused",), ("Unused",), ("{s} never {o}",))],
)
_WMAP = "MAP {" + ", ".join(f"'{s}': {{'name': '{n}', 'type': '{k}'}}" for s, (n, k) in WORDS.surfaces().items()) + "}"
_FORMS = "|".join(sorted(WORDS.surfaces(), key=len, reverse=True))
_END = r"(?:$|[^\pL\pN_])"


def _doubled(c: str) -> str:
    """Every separator twice, so that neighbouring matches can each have one."""
    return rf"regexp_replace({c}, '([^\pL\pN_])', '\1\1', 'g')"


def _mentions(c: str) -> str:
    return rf"list_transform(regexp_extract_all({_doubled(c)}, '(?:^|[^\pL\pN])({_FORMS}){_END}', 1), lambda s: {_WMAP}[s])"


_COUNTS = f"""mc AS (SELECT m.name AS entity, doc_id, title, count(*) AS n FROM (
  SELECT doc_id, {_TITLE} AS title, unnest({_mentions(f"{_TITLE} || chr(10) || {_BODY}")}) AS m FROM documents) GROUP BY ALL)"""


@query(f"WITH {_COUNTS} SELECT entity, CAST(doc_id AS VARCHAR) AS doc_id, n FROM mc")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.mention_counts(_corpus(spark, sf_dir), WORDS).select("entity", "doc_id", "n")


@query(
    f"""WITH {_COUNTS} SELECT entity, arg_min(CAST(doc_id AS VARCHAR), {{'t': NOT contains(lower(title), lower(entity)), 'n': -n, 'd': CAST(doc_id AS VARCHAR)}}) AS primary_id
    FROM mc GROUP BY entity"""
)
def source_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.primary_sources(compiler.mention_counts(_corpus(spark, sf_dir), WORDS))


_SLOT = f"(?:^|[^A-Za-z0-9])(?:[Tt]he  )?({_FORMS})"
_SLOT2 = f"(?:[Tt]he  )?({_FORMS}){_END}"
_TWICE = _doubled("sentence")
_DOM = "CASE p WHEN 'before' THEN list_contains(['Preposition', 'Verb'], s.type) AND list_contains(['Article', 'Pronoun', 'Preposition'], o.type) ELSE s.type = 'Verb' AND o.type = 'Pronoun' END"
_TRIPLES = f"""sr AS (SELECT doc_id, i AS sord, ss[i] AS sentence, ent FROM (
  SELECT doc_id, ss, ent, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, {_sentences(_BODY)} AS ss, ({_mentions(_TITLE)})[1] AS ent FROM documents))),
raw AS (
  SELECT doc_id, sord, sentence, 0 AS rule, 'before' AS p, '{{s}} {{o}}' AS pattern, false AS fd, {_WMAP}[a] AS s, {_WMAP}[b] AS o FROM (
    SELECT *, unnest(regexp_extract_all({_TWICE}, '{_SLOT}  {_SLOT2}', 1)) AS a, unnest(regexp_extract_all({_TWICE}, '{_SLOT}  {_SLOT2}', 2)) AS b FROM sr)
  UNION ALL
  SELECT doc_id, sord, sentence, 1, 'joined_to', '{{s}} and {{o}}', false, {_WMAP}[b], {_WMAP}[a] FROM (
    SELECT *, unnest(regexp_extract_all({_TWICE}, '{_SLOT}  and  {_SLOT2}', 1)) AS a, unnest(regexp_extract_all({_TWICE}, '{_SLOT}  and  {_SLOT2}', 2)) AS b FROM sr)
  UNION ALL
  SELECT doc_id, sord, sentence, 2, 'joined_to', 'of {{o}}', true, ent, {_WMAP}[b] FROM (
    SELECT *, unnest(regexp_extract_all({_TWICE}, 'of  {_SLOT2}', 1)) AS b FROM sr) WHERE ent IS NOT NULL
),
tr AS (SELECT s.name AS subject, p AS predicate, o.name AS object, doc_id, sentence, arg_min(pattern, {{'a': sord, 'b': rule}}) AS pattern,
  arg_min(fd, {{'a': sord, 'b': rule}}) AS fd FROM raw WHERE {_DOM} GROUP BY ALL)"""


@query(f"WITH {_TRIPLES} SELECT subject, predicate, object, CAST(doc_id AS VARCHAR) AS doc_id, sentence, pattern, fd AS resolved_from_document FROM tr")
def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_triples(_corpus(spark, sf_dir), WORDS).drop("triple_ord")


@query(f"WITH {_TRIPLES} SELECT p.predicate, count(tr.subject) AS n FROM (SELECT unnest(['before', 'joined_to', 'never']) AS predicate) p LEFT JOIN tr USING (predicate) GROUP BY 1")
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extraction_stats(extraction.extract_triples(_corpus(spark, sf_dir), WORDS), WORDS).select("predicate", "n")


@query(f"WITH {_TRIPLES} SELECT e AS name FROM (SELECT unnest({_list(n for n, _, _ in WORDS.entities)}) AS e) WHERE e NOT IN (SELECT subject FROM tr) AND e NOT IN (SELECT object FROM tr)")
def orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.orphan_entities(extraction.extract_triples(_corpus(spark, sf_dir), WORDS), WORDS).select("name")


@query()
def linkify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("doc_id", compiler.linkify(F.col("body"), WORDS, F.lit("the")).alias("linked"))


@query()
def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    edges = table(G.build_edges(extraction.extract_triples(corpus, WORDS)))
    made = compiler.entity_pages(corpus, edges, WORDS, "2020-01-01")
    return made.select("title", F.md5(pages.render()).alias("page_md5"), F.size("sources").alias("n_sources"))


# --- graph -------------------------------------------------------------------------

_GEO = """geo AS (
  SELECT n_name AS subject, 'located_in' AS predicate, r_name AS object, 'nation-' || n_nationkey AS doc FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, 'based_in', n_name, 'customer-' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'based_in', n_name, 'supplier-' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
lab AS (SELECT * FROM (VALUES ('located_in', 'located in', 'contains'), ('based_in', 'based in', 'home of')) t(predicate, label, inverse)),
st AS (SELECT subject AS node, object AS target, predicate, false AS inbound FROM geo UNION ALL SELECT object, subject, predicate, true FROM geo)"""


def _geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build_edges(star.geography_triples(spark, sf_dir))


@query(
    """WITH t AS (SELECT 'Order#' || o_orderkey AS subject, 'placed_by' AS predicate, c_name AS object FROM orders JOIN customer ON o_custkey = c_custkey
      UNION ALL SELECT 'Order#' || l_orderkey, 'includes', 'Part#' || l_partkey FROM lineitem
      UNION ALL SELECT 'Part#' || l_partkey, 'supplied_by', 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') FROM lineitem)
    SELECT subject, predicate, object, count(*) AS n_sources FROM t GROUP BY ALL"""
)
def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.build_edges(star.trade_triples(spark, sf_dir))
    return edges.select("subject", "predicate", "object", "n_sources")


@query(f"WITH {_GEO} SELECT subject, object FROM geo WHERE predicate = 'based_in' AND object = 'NATION_3'")
def kg_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.match(_geo_edges(spark, sf_dir), predicate="based_in", object="NATION_3").select("subject", "object")


@query(
    f"""WITH {_GEO} SELECT node AS entity, CASE WHEN inbound THEN inverse ELSE label END AS label, target AS other, NOT inbound AS outbound,
      node || ' ' || CASE WHEN inbound THEN inverse ELSE label END || ' ' || target AS fact FROM st JOIN lab USING (predicate)"""
)
def kg_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = G.facts(_geo_edges(spark, sf_dir), star.relation_frame(spark))
    return f.select("entity", "label", "other", "outbound", G.render_fact().alias("fact"))


_ARROW = "CASE WHEN {0}.inbound THEN ' <-[' || {1}.label || ']- ' ELSE ' -[' || {1}.label || ']-> ' END || {0}.target"


@query(
    f"""WITH {_GEO}, h1 AS (SELECT r_name AS start, s.* FROM region JOIN st s ON s.node = r_name),
    h2 AS (SELECT h1.start, h1.target AS mid, h1.predicate AS p1, h1.inbound AS i1, s.target, s.predicate, s.inbound FROM h1 JOIN st s ON s.node = h1.target
      WHERE s.target <> h1.start AND (h1.start, s.target) NOT IN (SELECT (start, target) FROM h1)),
    b2 AS (SELECT start, target, min({{'m': mid, 'p': p1, 'i': i1, 'p2': predicate, 'i2': inbound}}) AS b FROM h2 GROUP BY ALL)
    SELECT start, target AS node, 1 AS distance, start || {_ARROW.format('h1', 'l')} AS via FROM h1 JOIN lab l USING (predicate)
    UNION ALL SELECT start, target, 2, start || CASE WHEN b.i THEN ' <-[' || l1.label || ']- ' ELSE ' -[' || l1.label || ']-> ' END || b.m ||
      CASE WHEN b.i2 THEN ' <-[' || l2.label || ']- ' ELSE ' -[' || l2.label || ']-> ' END || target
    FROM b2 JOIN lab l1 ON l1.predicate = b.p JOIN lab l2 ON l2.predicate = b.p2"""
)
def kg_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = read_table(spark, sf_dir, "region").select(F.col("r_name").alias("start"))
    near = G.neighbors_within(seeds, _geo_edges(spark, sf_dir), 2)
    via = G.render_path(F.col("start"), F.col("route"), G.label_map(star.LABELS))
    return near.select("start", "node", F.col("distance").cast("long").alias("distance"), via.alias("via"))


@query(
    """SELECT a.n_nationkey AS q_id, b.n_name AS entity, abs(a.n_nationkey - b.n_nationkey) AS distance,
      row_number() OVER (PARTITION BY a.n_nationkey ORDER BY abs(a.n_nationkey - b.n_nationkey), b.n_name) AS rank
    FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND abs(a.n_nationkey - b.n_nationkey) <= 7"""
)
def kg_seven_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhoods along a chain of nations by key: all that lies within the seven hops asked for."""
    nation = read_table(spark, sf_dir, "nation")
    after = nation.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("object"))
    source = F.array(F.struct(F.lit("chain").alias("doc_id"), F.lit("").alias("sentence")))
    edges = nation.join(after, "n_nationkey").select(F.col("n_name").alias("subject"), F.lit("next_to").alias("predicate"), "object", source.alias("sources"))
    asked = nation.select(F.col("n_nationkey").alias("q_id"), F.array("n_name").alias("seeds"), F.lit(None).cast("string").alias("answer_type"), F.lit(7).alias("hops"))
    near = kg.neighbourhood(asked, nation.select(F.col("n_name").alias("name"), F.lit("Nation").alias("type")), edges)
    return near.select("q_id", "entity", F.col("distance").cast("long").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_GEO}, h1 AS (SELECT n_name AS start, [n_name, target] AS nodes, n_name || {_ARROW.format('s', 'l')} AS path FROM nation JOIN st s ON s.node = n_name JOIN lab l USING (predicate)),
    h2 AS (SELECT start, list_append(nodes, target) AS nodes, path || {_ARROW.format('s', 'l')} AS path FROM h1 JOIN st s ON s.node = nodes[-1] JOIN lab l USING (predicate) WHERE NOT list_contains(nodes, target)),
    h3 AS (SELECT start, list_append(nodes, target) AS nodes, path || {_ARROW.format('s', 'l')} AS path FROM h2 JOIN st s ON s.node = nodes[-1] JOIN lab l USING (predicate) WHERE NOT list_contains(nodes, target))
    SELECT start, path, len(nodes) - 1 AS hops FROM h1 UNION ALL SELECT start, path, len(nodes) - 1 FROM h2 UNION ALL SELECT start, path, len(nodes) - 1 FROM h3"""
)
def kg_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("start"))
    found = G.simple_paths(seeds, _geo_edges(spark, sf_dir), 3)
    path = G.render_path(F.col("start"), F.col("route"), G.label_map(star.LABELS))
    return found.select("start", path.alias("path"), F.size("route").cast("long").alias("hops"))


@query("SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS component, count(*) OVER (PARTITION BY text) AS size FROM documents")
def kg_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h"), "text")
    before = F.lag("doc_id").over(Window.partitionBy("h", "text").orderBy("doc_id"))
    edges = docs.select(F.col("doc_id").alias("subject"), before.alias("object")).where("object is not null")
    return G.components(docs.select(F.col("doc_id").alias("name")), edges)


@query(f"WITH {_GEO} SELECT node, count(*) AS degree FROM st GROUP BY node")
def kg_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_geo_edges(spark, sf_dir))


@query(
    """WITH t AS (SELECT DISTINCT 'Part#' || l_partkey AS s, 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS o FROM lineitem)
    SELECT least(s, o) AS a, greatest(s, o) AS b, count(*) AS n, 'supplied_by' AS predicates FROM t GROUP BY ALL"""
)
def kg_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.match(G.build_edges(star.trade_triples(spark, sf_dir)), predicate="supplied_by")
    return G.parallel_groups(edges).select("a", "b", "n", F.array_join("predicates", ",").alias("predicates"))


@query(
    f"""WITH {_GEO} SELECT subject, predicate, object, '{{"source":"' || subject || '","target":"' || object || '","predicate":"' || predicate || '","label":"' || label ||
      '","sentence":"' || subject || ' ' || label || ' ' || object || '.","doc_id":"' || doc || '","doc_ids":["' || doc || '"]}}' AS json FROM geo JOIN lab USING (predicate)"""
)
def kg_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = G.graph_json(star.geography_nodes(spark, sf_dir), _geo_edges(spark, sf_dir), star.relation_frame(spark))
    return edges


def _plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(star.PLANS, star.PLAN_SCHEMA)


_PLAN_ROWS = ", ".join(
    f"('{q}', {_list(s)}::VARCHAR[], {f"'{t}'" if t else 'NULL'}, {_list(n)}::VARCHAR[], {_list(c)}::VARCHAR[])" for q, s, t, n, c, h in star.PLANS if h is None
)
_KIND = """kind AS (SELECT r_name AS name, 'Region' AS type FROM region UNION ALL SELECT n_name, 'Nation' FROM nation UNION ALL SELECT c_name, 'Customer' FROM customer
  UNION ALL SELECT 'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'Supplier' FROM supplier)"""


def _hop(n: int) -> str:
    return f"""h{n} AS (SELECT start, list_append(nodes, target) AS nodes, list_append(preds, s.predicate) AS preds, list_append(types, type) AS types,
      list_append(key, {{'t': target, 'p': s.predicate, 'i': inbound}}) AS key, path || {_ARROW.format('s', 'l')} AS path
      FROM h{n - 1} JOIN st s ON s.node = nodes[-1] JOIN lab l USING (predicate) JOIN kind ON name = target WHERE NOT list_contains(nodes, target))"""


_BEST = f"""plan AS (SELECT * FROM (VALUES {_PLAN_ROWS}) t(q_id, seeds, answer_type, named, cues)),
seed AS (SELECT *, seeds[i] AS start FROM (SELECT *, unnest(range(1, len(seeds) + 1)) AS i FROM plan)),
h0 AS (SELECT DISTINCT start, [start] AS nodes, []::VARCHAR[] AS preds, []::VARCHAR[] AS types, []::STRUCT(t VARCHAR, p VARCHAR, i BOOLEAN)[] AS key, start AS path FROM seed),
{_hop(1)}, {_hop(2)}, {_hop(3)}, {_hop(4)},
al AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4),
sc AS (SELECT q_id, nodes[-1] AS entity, i, key, path, -0.6::DOUBLE * len(preds) + 2.5::DOUBLE * len(list_intersect(list_distinct(preds), cues))
    + 1.5::DOUBLE * len(list_filter(list_intersect(list_distinct(types[:-2]), named), lambda x: x <> answer_type)) AS score
  FROM seed JOIN al USING (start) WHERE types[-1] = answer_type AND NOT list_contains(seeds, nodes[-1])),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, entity ORDER BY score DESC, i, len(key), key) AS k FROM sc) WHERE k = 1),
ra AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, entity) AS rank FROM be)"""


@query(f"WITH {_GEO}, {_KIND}, {_BEST} SELECT q_id, entity, round(score, 2) AS score, path, rank FROM ra WHERE rank <= 6")
def kg_best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = kg.candidates(_plans(spark), star.geography_nodes(spark, sf_dir), table(_geo_edges(spark, sf_dir)))
    path = G.render_path(F.col("start"), F.col("route"), G.label_map(star.LABELS))
    return best.select("q_id", "entity", F.round("score", 2).alias("score"), path.alias("path"), F.col("rank").cast("long").alias("rank"))


def _kg_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _plans(spark).withColumn("question", F.concat_ws(" ", F.array_join("seeds", " "), F.array_join("cues", " "), "answer_type"))
    return kg.answer(asked, star.geography_nodes(spark, sf_dir), table(_geo_edges(spark, sf_dir)), G.label_map(star.LABELS))


@query(
    f"""WITH {_GEO}, {_KIND}, {_BEST}, n AS (SELECT q_id, max(score) FILTER (rank = 1) = max(score) FILTER (rank = 2) AS tie FROM ra GROUP BY q_id),
    p AS (SELECT * FROM (VALUES {', '.join(f"('{q}', {'true' if h else 'false'}, {len(s)})" for q, s, *_, h in star.PLANS)}) t(q_id, hood, n_seeds))
    SELECT q_id, CASE WHEN hood THEN true ELSE coalesce(NOT coalesce(tie, false), false) AND n.q_id IS NOT NULL END AS confident FROM p LEFT JOIN n USING (q_id)"""
)
def kg_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kg_answers(spark, sf_dir).select("q_id", "confident")


@query()
def kg_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kg_answers(spark, sf_dir).select("q_id", "answer", "citations", "trace", "detail", "tokens_est", "confident", "note")


#: Questions in words, for the planner.
ASKED = [
    "Which nations are within two hops of ASIA?",
    "Who placed orders from NATION_7 in EUROPE?",
    "What suppliers are based in NATION_1 or NATION_12?",
    "Tell me about MIDDLE EAST customers 3 degrees from AFRICA",
    "Which people supply parts?",
    "Is NATION_24 located anywhere?",
    "",
]
_ASKED = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED))
_TYPE_CASE = "[" + ", ".join(f"CASE WHEN list_contains(w, '{t.lower()}') OR list_contains(w, '{t.lower()}s') THEN '{t}' END" for t in star.TYPES) + "]"
_NEXT = " ".join(f"WHEN x IN ('{t.lower()}', '{t.lower()}s') THEN '{t}'" for t in star.TYPES) + " WHEN x = 'people' THEN 'Person'"
_CUES = "[" + ", ".join(
    "CASE WHEN " + " OR ".join(f"list_contains(w, '{x}')" for x in sorted({s.replace("_", " ").split()[0] for s in (r.predicate, r.label, r.inverse_label)})) + f" THEN '{r.predicate}' END"
    for r in star.RELATIONS
) + "]"
_NUM = "CASE lower(h) WHEN 'one' THEN 1 WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4 WHEN 'five' THEN 5 ELSE TRY_CAST(h AS INTEGER) END"


@query(
    rf"""WITH q AS (SELECT q_id, question, regexp_extract_all(lower(question), '[a-z0-9][a-z0-9-]*') AS w FROM (VALUES {_ASKED}) t(q_id, question)),
    pl AS (SELECT '(?:^|[^A-Za-z0-9])(' || string_agg(x || '\b', '|' ORDER BY len(x) DESC, x) || ')' AS re FROM (SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation)),
    s AS (SELECT q_id, w, list_filter({_TYPE_CASE}, lambda x: x IS NOT NULL) AS nt0, list_filter({_CUES}, lambda x: x IS NOT NULL) AS cues,
      regexp_extract_all(question, (SELECT re FROM pl), 1) AS found,
      coalesce(nullif(regexp_extract(question, '(?i)\bwithin (\d+|one|two|three|four|five) hops?\b', 1), ''),
        nullif(regexp_extract(question, '(?i)\b(\d+|one|two|three|four|five) (?:hops?|degrees) (?:from|of)\b', 1), '')) AS h FROM q),
    n AS (SELECT *, CASE WHEN list_contains(w, 'people') AND NOT list_contains(nt0, 'Person') THEN list_append(nt0, 'Person') ELSE nt0 END AS nt,
      list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN w[i] IN ('which', 'what') THEN list_transform([w[i + 1]], lambda x: CASE {_NEXT} END)[1] END), lambda x: x IS NOT NULL) AS st FROM s)
    SELECT q_id, array_to_string(list_transform(list_filter(range(1, len(found) + 1), lambda i: list_position(found, found[i]) = i), lambda i: found[i]), ',') AS seeds,
      coalesce(st[1], CASE WHEN list_has_any(w, ['who', 'whom', 'whose']) THEN 'Person' END, nt[1]) AS answer_type,
      array_to_string(nt, ',') AS named_types, array_to_string(cues, ',') AS cues, {_NUM} AS hops FROM n"""
)
def question_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(ASKED)), "q_id int, question string")
    p = planner.plan_questions(asked, star.region_ontology(spark, sf_dir))
    return p.select("q_id", F.array_join("seeds", ",").alias("seeds"), "answer_type", F.array_join("named_types", ",").alias("named_types"), F.array_join("cues", ",").alias("cues"), "hops")


# --- pages and checks ------------------------------------------------------------------

_PAGES = """sup AS (SELECT 'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS title, s_suppkey AS k FROM supplier),
pg AS (SELECT 'Part#' || p_partkey AS title, 'entity' AS page_type, 'Part' AS entity_type, 'Part#' || p_partkey || ' is a ' || lower(p_type) || ' part of ' || p_brand || '.' AS summary, p_partkey AS k FROM part
  UNION ALL SELECT title, CASE WHEN k % 7 = 0 THEN 'topic' ELSE 'entity' END, 'Supplier', title || ' supplies parts.', k FROM sup WHERE k % 10 <> 0),
lk AS (SELECT DISTINCT 'Part#' || l_partkey AS title, 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS target FROM lineitem JOIN part ON l_partkey = p_partkey),
so AS (SELECT DISTINCT 'Part#' || l_partkey AS title, 'order-' || l_orderkey AS doc_id FROM lineitem JOIN part ON l_partkey = p_partkey),
ent AS (SELECT title, CASE WHEN k % 11 = 3 THEN summary || ' (old)' ELSE summary END AS summary FROM pg WHERE k % 13 <> 5
  UNION ALL SELECT title || ' (gone)', summary FROM pg WHERE k % 17 = 4)"""


@query(f"WITH {_PAGES} SELECT title, summary, CASE WHEN page_type = 'topic' THEN 'Topics' ELSE entity_type END AS category FROM pg")
def wiki_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.catalogue(star.supply_pages(spark, sf_dir))


@query(f"WITH {_PAGES} SELECT title, row_number() OVER (PARTITION BY title ORDER BY target) - 1 AS pos, target FROM lk")
def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.link_rows(star.supply_pages(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_PAGES} SELECT target, string_agg(title, ',' ORDER BY title) AS linked_from FROM lk GROUP BY target")
def wiki_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.backlinks(star.supply_pages(spark, sf_dir)).select("target", F.array_join("linked_from", ",").alias("linked_from"))


@query(
    f"""WITH {_PAGES} SELECT pg.title, summary || coalesce(chr(10) || chr(10) || string_agg('owned by [[' || target || ']]', chr(10) || chr(10) ORDER BY target), '') AS body
    FROM pg LEFT JOIN lk USING (title) GROUP BY pg.title, summary"""
)
def wiki_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.supply_pages(spark, sf_dir).select("title", pages.body().alias("body"))


@query(
    f"""WITH {_PAGES}, s AS (SELECT title, string_agg(doc_id, ', ' ORDER BY CAST(substr(doc_id, 7) AS BIGINT)) AS a, string_agg('- ' || doc_id, chr(10) ORDER BY CAST(substr(doc_id, 7) AS BIGINT)) AS b FROM so GROUP BY title),
    l AS (SELECT title, string_agg('- owned by [[' || target || ']]', chr(10) ORDER BY target) AS t FROM lk GROUP BY title)
    SELECT title, '---' || chr(10) || 'title: ' || title || chr(10) || 'page_type: ' || page_type || chr(10) || 'entity_type: ' || entity_type || chr(10) || 'sources: [' || coalesce(a, '') || ']' || chr(10)
      || 'updated: 2020-01-01' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || '> ' || summary || coalesce(chr(10) || chr(10) || '## Relationships' || chr(10) || chr(10) || t, '')
      || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || coalesce(b, '') || chr(10) AS markdown FROM pg LEFT JOIN s USING (title) LEFT JOIN l USING (title)"""
)
def wiki_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.supply_pages(spark, sf_dir).select("title", pages.render().alias("markdown"))


_WIKI_ASKED = ["Which economy parts are red?", "Tell me about Part#17 and its brand", "Supplier#000000003", "brand 7 promo supplies", "nothing here matches zzz"]
_WQ = ", ".join(f"({i}, '{q}')" for i, q in enumerate(_WIKI_ASKED))
_SCAN = f"""{_PAGES}, en AS (SELECT title, summary FROM pg),
ps AS (SELECT title, stem, list_contains(a, stem) AS t, list_contains(b, stem) AS s FROM (
  SELECT title, a, b, unnest(list_distinct(list_concat(a, b))) AS stem FROM (SELECT title, {_stems('title')} AS a, {_stems('summary')} AS b FROM en))),
df AS (SELECT stem, ln(1 + (SELECT count(*) FROM en) / count(*)::DOUBLE) AS w, count(*) <= greatest(1.0, 0.25 * (SELECT count(*) FROM en)) AS rare FROM ps GROUP BY stem),
qs AS (SELECT q_id, q, unnest({_stems('q')}) AS stem FROM (VALUES {_WQ}) t(q_id, q)),
mt AS (SELECT q_id, title, sum(w * (CASE WHEN t THEN 3.0 ELSE 0 END + CASE WHEN s THEN 1.0 ELSE 0 END)) + CASE WHEN contains(lower(any_value(q)), lower(title)) THEN 3.0 ELSE 0 END AS score,
  string_agg(stem, ',' ORDER BY stem) AS hits, count(*) AS n, bool_or(rare) AS rare FROM qs JOIN ps USING (stem) JOIN df USING (stem) GROUP BY q_id, title),
sc AS (SELECT q_id, title, round(score, 9) AS score, hits, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, round(score, 9) DESC, title) AS rank FROM mt WHERE rare)"""


def _wiki(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    made = table(star.supply_pages(spark, sf_dir))
    asked = spark.createDataFrame(list(enumerate(_WIKI_ASKED)), "q_id int, question string")
    return asked, pages.catalogue(made), made


@query(f"WITH {_SCAN} SELECT q_id, title, round(score, 6) AS score, hits, rank FROM sc")
def wiki_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, entries, made = _wiki(spark, sf_dir)
    found = wiki.scan(asked, entries, made)
    return found.select("q_id", "title", F.round("score", 6).alias("score"), F.array_join("hits", ",").alias("hits"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_SCAN}, sd AS (SELECT q_id, title, rank FROM sc WHERE rank <= 2),
    f AS (SELECT q_id, target AS title, min({{'r': rank, 'p': pos}}) AS o FROM sd JOIN (SELECT title, target, row_number() OVER (PARTITION BY title ORDER BY target) AS pos FROM lk WHERE target IN (SELECT title FROM pg)) USING (title)
      WHERE (q_id, target) NOT IN (SELECT (q_id, title) FROM sd) GROUP BY ALL),
    b AS (SELECT q_id, title, 0 AS lv, rank AS a, 0 AS c FROM sd UNION ALL SELECT q_id, title, 1, o.r, o.p FROM f)
    SELECT q_id, title, pos FROM (SELECT q_id, title, row_number() OVER (PARTITION BY q_id ORDER BY lv, a, c) AS pos FROM b)"""
)
def wiki_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, entries, made = _wiki(spark, sf_dir)
    seeds = wiki.scan(asked, entries, made).where("rank <= 2")
    return wiki.read(seeds, made, 10_000).select("q_id", "title", F.col("pos").cast("long").alias("pos"))


@query()
def wiki_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.answer(*_wiki(spark, sf_dir)).select("q_id", "answer", "citations", "tokens_est", "confident", "note")


def _lint_sql(check: str, subject: str, detail: str, rest: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{lint.SEVERITY[check]}' AS severity, {subject} AS subject, {detail} AS detail {rest}"


_LINTS = {
    "orphan_pages": _lint_sql("orphan_pages", "title", "'no other page links here'", "FROM pg WHERE page_type <> 'topic' AND title NOT IN (SELECT target FROM lk)"),
    "broken_links": _lint_sql("broken_links", "title", "'[[' || target || ']] resolves to no page'", "FROM lk WHERE target NOT IN (SELECT title FROM pg)"),
    "contradictions": _lint_sql(
        "contradictions", "title", "'owned_by takes one object, but this page says owned by ' || string_agg('[[' || target || ']]', ' and ' ORDER BY target)", "FROM lk GROUP BY title HAVING count(*) > 1"
    ),
    "stale_pages": _lint_sql(
        "stale_pages", "title", "'newest source is ' || d || ', ' || date_diff('day', d, e) || ' days behind the corpus (' || e || ')'",
        """FROM (SELECT title, max(CAST(o_orderdate AS DATE)) AS d, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS e FROM so JOIN orders ON doc_id = 'order-' || o_orderkey GROUP BY title)
        WHERE d < e - INTERVAL 180 DAY""",
    ),
    "superseded_refs": None,
    "coverage_gaps": _lint_sql("coverage_gaps", "'order-' || o_orderkey", "'no page cites this document'", "FROM orders WHERE 'order-' || o_orderkey NOT IN (SELECT doc_id FROM so)"),
    "index_drift": _lint_sql(
        "index_drift", "title",
        "CASE WHEN pg.k IS NULL THEN 'catalogued in index.md but no page was written' WHEN ent.summary IS NULL THEN 'page exists but index.md does not list it' ELSE 'index.md quotes a summary the page no longer carries' END",
        "FROM ent FULL JOIN pg USING (title) WHERE pg.k IS NULL OR ent.summary IS NULL OR ent.summary <> pg.summary",
    ),
}
_RELS = [("owned_by", "owned by", "owns"), ("supersedes", "supersedes", "superseded by")]


def _lint_query(check: str, make: Callable[[SparkSession, str], DataFrame]) -> None:
    make.__name__ = f"lint_{check}"
    query(f"WITH {_PAGES} {_LINTS[check]}")(make)


_lint_query("orphan_pages", lambda s, d: lint.orphan_pages(star.supply_pages(s, d)))
_lint_query("broken_links", lambda s, d: lint.broken_links(star.supply_pages(s, d)))
_lint_query("contradictions", lambda s, d: lint.contradictions(star.supply_pages(s, d), _RELS))
_lint_query("stale_pages", lambda s, d: lint.stale_pages(star.supply_pages(s, d), star.order_corpus(s, d)))
_lint_query("coverage_gaps", lambda s, d: lint.coverage_gaps(star.supply_pages(s, d), star.order_corpus(s, d)))
_lint_query("index_drift", lambda s, d: lint.index_drift(star.supply_pages(s, d), star.drifted_catalogue(star.supply_pages(s, d))))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per order that supersedes the customer's order before; every third says nothing of it but links to it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lag("o_orderkey", 2).over(w).alias("older"))
    name = lambda c: F.concat(F.lit("Order#"), F.col(c).cast("string"))
    says = F.when(F.col("before").isNotNull(), F.struct(F.lit("Relationships").alias("heading"), F.concat(F.lit("- supersedes [["), name("before"), F.lit("]]")).alias("body")))
    shows = F.when(F.col("older").isNotNull(), F.struct(F.lit("Related").alias("heading"), F.concat(F.lit("[["), name("older"), F.lit("]]")).alias("body")))
    part = F.when(F.col("o_orderkey") % 3 == 0, shows).otherwise(says)
    return rows.select(
        name("o_orderkey").alias("title"), F.lit("entity").alias("page_type"), F.concat(name("o_orderkey"), F.lit(" is an order.")).alias("summary"),
        F.array_compact(F.array(part)).alias("sections"),
    )


@query(
    f"""WITH h AS (SELECT o_orderkey AS k, lag(o_orderkey) OVER w AS b, lag(o_orderkey, 2) OVER w AS o FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    {_lint_sql("superseded_refs", "'Order#' || k", "'links to [[Order#' || o || ']], which has been superseded, without saying so'", "FROM h WHERE k % 3 = 0 AND o IN (SELECT b FROM h WHERE k % 3 <> 0)")}"""
)
def lint_superseded_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.superseded_refs(_history(spark, sf_dir), _RELS)


@query(
    f"""WITH {_PAGES}, f AS ({' UNION ALL '.join(v for v in _LINTS.values() if v)})
    SELECT (SELECT count(*) FROM pg) AS page_count, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS ok FROM f"""
)
def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(star.supply_pages(spark, sf_dir))
    findings = lint.lint(made, star.drifted_catalogue(made), star.order_corpus(spark, sf_dir), _RELS)
    return lint.report(findings, made)


@query(
    f"""WITH {_BM}, {_SEM} SELECT q_id, 'rag' AS approach, 'RAG' AS label, 0.0::DOUBLE AS latency_ms,
      (SELECT sum(len(text)) FROM lex JOIN chunks USING (chunk_id) WHERE lex.q_id = sem.q_id) // 4 AS evidence_tokens,
      (SELECT count(DISTINCT doc_id) FROM lex JOIN chunks USING (chunk_id) WHERE lex.q_id = sem.q_id) AS documents_touched,
      false AS derivation_shown, max(score) < 0.25 AS admitted_ignorance FROM sem GROUP BY q_id"""
)
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = answers.scoreboard(_rag(spark, sf_dir), "q_id")
    return board.withColumn("documents_touched", F.col("documents_touched").cast("long"))


@query("SELECT source, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members FROM documents GROUP BY source")
def grouped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda d: d.cast("string")), ",").alias("members"))


@query(
    """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM benchmark) AS questions, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation)
      + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS edges"""
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return (
        one(read_table(spark, sf_dir, "documents"), "documents").crossJoin(one(_questions(spark, sf_dir), "questions"))
        .crossJoin(one(star.geography_nodes(spark, sf_dir), "nodes")).crossJoin(one(_geo_edges(spark, sf_dir), "edges"))
    )
