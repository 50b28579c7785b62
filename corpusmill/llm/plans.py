"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.llm.canonical import map_pages
from corpusmill.llm.duplicates import best_representatives
from corpusmill.llm.names import entity_pairs, link_names
from corpusmill.llm.packing import fill_report, pack
from corpusmill.llm.scans import clean_scans
from corpusmill.llm.splitting import split_oversized
from corpusmill.llm.tokenizer import decode_column, encode_column
from corpusmill.llm.truncation import truncated, truncation_report
from corpusmill.plans.registry import Registry
from corpusmill.session import keep, table

REGISTRY = Registry()


@REGISTRY.query("p8_ids")
def p8_ids(spark, d):
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


@REGISTRY.query("p8_decoded")
def p8_decoded(spark, d):
    """Whether each text comes back from its ids."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = decode_column(encode_column(docs, "doc_id", "text"), "doc_id", "ids")
    return back.join(docs.withColumnRenamed("text", "original"), "doc_id").select(
        "doc_id", F.length("text").alias("n_chars"), (F.col("text") == F.coalesce("original", F.lit(""))).alias("same")
    )


#: Tokens of a container.
CAPACITY = 4_096


def _packed(spark, d):
    sizes = keep(encode_column(table(spark, d, "documents"), "doc_id", "text", out="n", count_only=True), "sizes")
    return pack(sizes, "doc_id", "n", CAPACITY)


@REGISTRY.query("p9_containers")
def p9_containers(spark, d):
    return _packed(spark, d)


@REGISTRY.query("p9_fill")
def p9_fill(spark, d):
    """How full the containers are."""
    return fill_report(_packed(spark, d), CAPACITY)


def _entities(spark, d):
    pages = table(spark, d, "wiki_page").where("folder = 'entities'")
    return link_names(pages.select(F.col("page_id").alias("page"), "title", "aliases"))


@REGISTRY.query("p1_found")
def p1_found(spark, d):
    return entity_pairs(_entities(spark, d))


@REGISTRY.query("p1_entities")
def p1_entities(spark, d):
    """The entity of each page, with how many pages that has and the first of them."""
    linked = keep(_entities(spark, d), "linked")
    sizes = linked.groupBy("entity").agg(F.count("*").alias("n_pages"), F.min("page").alias("first_page"))
    return linked.join(sizes, "entity").select(F.col("page").alias("page_id"), "entity", "n_pages", "first_page")


@REGISTRY.query("p4_found")
def p4_found(spark, d):
    return clean_scans(table(spark, d, "chunk")).select("chunk_id", F.explode("noise").alias("noise")).distinct()


@REGISTRY.query("p4_texts")
def p4_texts(spark, d):
    """The repaired paragraphs of scanned chunks."""
    return clean_scans(table(spark, d, "chunk")).select("chunk_id", "text")


@REGISTRY.query(
    "p5_found",
    "SELECT chunk_id FROM chunk WHERE len(list_filter(regexp_split_to_array(text, '[\\s\\x0B\\x1C-\\x1F\\p{Z}\\x{85}]+'), lambda w: w <> '')) > 750",
)
def p5_found(spark, d):
    return split_oversized(table(spark, d, "chunk")).where("piece = 0").select("chunk_id").distinct()


@REGISTRY.query("p5_pieces")
def p5_pieces(spark, d):
    return split_oversized(table(spark, d, "chunk"))


@REGISTRY.query("p6_found")
def p6_found(spark, d):
    return map_pages(table(spark, d, "wiki_page"), table(spark, d, "vocab"))


@REGISTRY.query("p6_report")
def p6_report(spark, d):
    """Mapped and unmatched values counted for each field and entry."""
    found = map_pages(table(spark, d, "wiki_page"), table(spark, d, "vocab"))
    return found.groupBy("field", "canonical").agg(F.count("*").alias("n_values"), F.countDistinct("raw_value").alias("n_spellings"))


@REGISTRY.query("p7_found")
def p7_found(spark, d):
    return best_representatives(table(spark, d, "manifest_event"))[0].select("path", "keep_path")


@REGISTRY.query("p7_records")
def p7_records(spark, d):
    """The record built for each document."""
    return best_representatives(table(spark, d, "manifest_event"))[1].select("keep_path", "hash", "relative_path", "display_name", "n_members")


@REGISTRY.query("p10_found")
def p10_found(spark, d):
    return truncated(table(spark, d, "documents")).select("doc_id").distinct()


@REGISTRY.query("p10_report")
def p10_report(spark, d):
    return truncation_report(table(spark, d, "documents"))
