"""Ranked retrieval: BM25 over words, exact cosine over vectors, and their fusion by reciprocal ranks.

Queries are a stated set of rows; each meets all rows. A query's candidates are scored in parts and cut to
the best k before they meet in a ranking.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.frames import groups
from corpusmill.operators.resemblance import similar_pages
from corpusmill.session import tasks

K1, B, RRF_K = 1.2, 0.75, 60
#: Queries and rows of a block, and rows that are scored at once.
QUERIES, ROWS, STEP = 2_048, 32_768, 4_096
#: Rows that are worth a block of their own.
FEW = 2_048


def meeting(queries: DataFrame, rows: DataFrame, columns: list[str], by: str | None = None, least: int = 1) -> DataFrame:
    """Each block of queries with each block of rows: block, side (0 for queries), and ``columns``, which both have; sorted by block and side.

    Blocks are drawn by a hash (of ``by``, if given, else of all columns), so they are bounded whatever the tables hold, and nothing is sent
    by the driver. There are ``least`` blocks at least, if that leaves each ``FEW`` rows.
    """
    n_queries, found = max(1, -(-queries.count() // QUERIES)), rows.count()
    n_rows = max(1, -(-found // ROWS), min(-(-least // n_queries), found // FEW))
    own = lambda n: F.pmod(F.xxhash64(*([by] if by else columns)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = queries.select(*columns, F.lit(0).alias("side"), own(n_queries).alias("i"), every(n_rows).alias("j")).unionByName(
        rows.select(*columns, F.lit(1).alias("side"), every(n_queries).alias("i"), own(n_rows).alias("j"))
    )
    n = min(n_queries * n_rows, 10_000)
    block = F.col("i") * n_rows + F.col("j")
    return sides.select(block.alias("block"), "side", *columns).repartition(max(n, tasks(rows.sparkSession)), "block").sortWithinPartitions("block", "side")


def terms(text: str):
    """Distinct entries of letters and digits in lower case, as a column of arrays."""
    return F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def top(scored: DataFrame, k: int, by: str, item: str) -> DataFrame:
    """The best k of each query, ties by item; the ranking drops what can't be among them before its shuffle."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, doc_id, score, rank; ``docs``: doc_id, text; ``queries``: query_id, text.

    Null texts are no documents. Only words of queries are counted in documents.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms("text"))).alias("term"))
    sized = docs.where("text is not null").select("doc_id", terms("text").alias("t")).withColumn("len", F.size("t"))
    lengths = docs.where("text is not null").select(F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}]+")).alias("len"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg_len"))
    # One row per document and word; what no query asks for is dropped at once.
    tf = (
        sized.select("doc_id", "len", F.explode("t").alias("term"))
        .join(asked.select("term").distinct(), "term", "left_semi")
        .groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf"))
    )
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weighed = tf.join(df, "term").withColumns({c: stats.select(c).scalar() for c in stats.columns}).select("term", "doc_id", weight.alias("w"))
    scored = asked.join(weighed, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 5).alias("score"))
    return top(scored, k, "query_id", "doc_id").select("query_id", "doc_id", "score", "rank")


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, vec_id, score, rank by cosine; ``vectors``: vec_id, embedding; ``queries``: query_id, embedding.

    Null vectors, and those without a direction, take no part. Blocks of queries meet blocks of vectors; each
    meeting passes on the best k of each query.
    """
    usable = lambda df, key: df.where("embedding is not null and size(embedding) > 0").select(F.col(key).cast("long").alias("id"), "embedding")

    def directions(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(rows["embedding"].tolist(), dtype=np.float64)
        norms = np.linalg.norm(x, axis=1)
        sound = norms > 0
        return rows["id"].to_numpy()[sound], x[sound] / norms[sound, None]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in groups(batches, "block"):
            if rows["side"].nunique() < 2:
                continue
            (ids, q), (items, x) = (directions(rows[rows["side"] == side]) for side in (0, 1))
            for at in range(0, len(items) if len(ids) else 0, STEP):
                score = np.round(q @ x[at : at + STEP].T, 5)
                # the k-th best score decides; ties at it all stay
                cut = np.partition(score, score.shape[1] - min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1])]
                qi, vi = np.nonzero(score >= cut[:, None])
                yield pd.DataFrame({"query_id": ids[qi], "vec_id": items[at + vi], "score": score[qi, vi]})

    met = meeting(usable(queries, "query_id"), usable(vectors, "vec_id"), ["id", "embedding"])
    scored = met.mapInPandas(run, "query_id long, vec_id long, score double")
    return top(scored, k, "query_id", "vec_id").select("query_id", "vec_id", "score", "rank")


def fuse(lexical: DataFrame, vector: DataFrame, k: int = 5) -> DataFrame:
    """query_id, item, score, rank: two ranked lists (query_id, item, rank) fused by reciprocal ranks."""
    both = lexical.select("query_id", "item", "rank").unionByName(vector.select("query_id", "item", "rank"))
    scored = both.groupBy("query_id", "item").agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))), 8).alias("score"))
    return top(scored, k, "query_id", "item")


def similar_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, page_id of pages with a name similar to one of a query's; both: page_id, name.

    Similar: a Ratcliff-Obershelp ratio of at least ``resemblance.LEAST``, or an equal first word of over three letters. Blocks of
    queries meet blocks of names, and slices of both are compared at once. All names of a page are in one block, so a pair
    comes from one block only. A query isn't compared with itself.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in groups(batches, "block"):
            asked, here = rows[rows["side"] == 0], rows[rows["side"] == 1]
            if len(asked) and len(here):
                for q, p in similar_pages(asked["page_id"].to_numpy(), asked["name"].tolist(), here["page_id"].to_numpy(), here["name"].tolist()):
                    yield pd.DataFrame({"query_id": q, "page_id": p})

    typed = lambda df: df.select(F.col("page_id").cast("long"), "name")
    met = meeting(typed(queries), typed(names), ["page_id", "name"], by="page_id", least=2 * tasks(names.sparkSession))
    return met.mapInPandas(run, "query_id long, page_id long")
