"""Ranked retrieval. The queries are the titles of all pages, and the vectors of all rows, whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import retrieval as R
from corpusmill.operators import wiki as W
from corpusmill.plans.registry import CORE
from corpusmill.session import keep, table

BM25 = """
    asked AS (SELECT page_id AS query_id, term FROM (SELECT page_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''))) AS term
              FROM (SELECT DISTINCT page_id, title FROM wiki_page WHERE page_id % 100 = 0 AND title IS NOT NULL))),
    sized AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM documents WHERE text IS NOT NULL),
    stats AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM sized),
    tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 5) AS score
               FROM asked JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL),
    lexical AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {K})"""
VECTOR = """
    pairs AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score
              FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings v),
    nearest AS (SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= {K})"""


def _lexical(spark, d, k):
    queries = table(spark, d, "wiki_page").where("page_id % 100 = 0 and title is not null").select(F.col("page_id").alias("query_id"), F.col("title").alias("text")).distinct()
    return R.bm25(table(spark, d, "documents").select("doc_id", "text"), queries, k)


def _vector(spark, d, k):
    vectors = table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.vector_top(vectors, queries, k)


@CORE.query("bm25_topk", "WITH " + BM25.replace("{K}", "5") + " SELECT query_id, doc_id, score, rank FROM lexical")
def bm25_topk(spark, d):
    return _lexical(spark, d, 5)


@CORE.query("vector_topk", "WITH " + VECTOR.replace("{K}", "5") + " SELECT query_id, vec_id, score, rank FROM nearest")
def vector_topk(spark, d):
    return _vector(spark, d, 5)


@CORE.query(
    "hybrid_rrf",
    "WITH " + BM25.replace("{K}", "25") + ", " + VECTOR.replace("{K}", "25") + """,
    lists AS (SELECT query_id, doc_id AS item, rank FROM lexical UNION ALL SELECT query_id, vec_id AS item, rank FROM nearest),
    fused AS (SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM lists GROUP BY ALL)
    SELECT query_id, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM fused) WHERE rank <= 5""",
)
def hybrid_rrf(spark, d):
    """The two lists of one query id (a page's title, and the vector of that number) fused."""
    lexical = _lexical(spark, d, 25).withColumnRenamed("doc_id", "item")
    vector = _vector(spark, d, 25).withColumnRenamed("vec_id", "item")
    return R.fuse(lexical, vector, 5).select("query_id", "item", "score", "rank")


#: Results asked for by default and at most, how many more are fetched, and pages that only lead to others.
TOP, MOST, MORE, NAVIGATION = 5, 25, 2, ("index.md", "log.md")


def search_depth(top_k: int) -> tuple[int, int]:
    """How many results come back, and how many hits are fetched for them."""
    k = max(1, min(int(top_k), MOST))
    return k, min(k + MORE, MOST)


@CORE.query(
    "search_results",
    "WITH " + BM25.replace("{K}", "7") + """,
    placed AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, source, doc_type, text FROM lexical JOIN documents USING (doc_id)
               WHERE source IS NOT NULL AND doc_type IS NOT NULL AND coalesce(relative_path, '') NOT IN ('index.md', 'log.md'))
    SELECT query_id, rank, '[' || rank || '] ' || source || ' / ' || doc_type || CASE WHEN length(text) > 0 THEN ': ' || regexp_replace(text[1:60], '[^A-Za-z]+', ' ', 'g') ELSE '' END AS line
    FROM placed WHERE rank <= 5""",
)
def search_results(spark, d):
    """Hits as lines of text: two more than asked for are fetched, what has no place or only leads elsewhere is dropped, the rest is cut to five."""
    k, fetched = search_depth(TOP)
    docs = table(spark, d, "documents").select("doc_id", "source", "doc_type", "text", "relative_path")
    placed = _lexical(spark, d, fetched).withColumnRenamed("rank", "hit").join(docs, "doc_id").where("source is not null and doc_type is not null").where(
        ~F.coalesce("relative_path", F.lit("")).isin(*NAVIGATION)
    )
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("hit"))).where(F.col("rank") <= k)
    head = F.when(F.length("text") > 0, F.concat(F.lit(": "), F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z]+", " "))).otherwise(F.lit(""))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit(" / "), "doc_type", head)
    return ranked.select("query_id", "rank", line.alias("line"))


@CORE.query("similar_pages")
def similar_pages(spark, d):
    """Pages whose names resemble that of a page in the query set (ids divisible by 100), each against all pages."""
    p = W.unique_pages(table(spark, d, "wiki_page")).where("folder in ('entities', 'concepts')")
    names = p.select("page_id", F.explode(F.array_compact(F.array_union(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("n")).select(
        "page_id", W.page_key(F.col("n")).alias("name")
    ).where("name <> ''").distinct()
    names = keep(names, "names")
    return R.similar_names(names.where("page_id % 100 = 0"), names)
