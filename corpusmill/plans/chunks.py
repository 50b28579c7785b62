"""Queries over texts, slides, chunks and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunking as C
from corpusmill.plans.prose_sql import prose_ctes
from corpusmill.plans.registry import CORE
from corpusmill.session import table

WORDS = "list_filter(regexp_split_to_array({0}, '[\\s\\x0B\\p{{Z}}\\x{{85}}]+'), lambda x: x <> '')"


@CORE.query(
    "token_count",
    f"SELECT doc_id, CAST(greatest(1, round(len({WORDS.format('text')}) / 0.75)) AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL",
)
def token_count(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@CORE.query(
    "sentence_split",
    """SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (
         SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\\s\\x0B\\p{Z}\\x{85}]+([A-Z("''])', '\\1\x01\\2', 'g'), '\x01'),
                lambda x: regexp_replace(x, '^[\\s\\x0B\\p{Z}\\x{85}]+|[\\s\\x0B\\p{Z}\\x{85}]+$', '', 'g')), lambda x: x <> '') AS s
         FROM documents WHERE text IS NOT NULL)""",
)
def sentence_split(spark, d):
    s = table(spark, d, "documents").where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


@CORE.query(
    "low_text_warning",
    """SELECT doc_key, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, greatest(1, coalesce(max(meta.page), 1)) AS n_pages FROM chunk
       GROUP BY doc_key HAVING sum(length(coalesce(text, ''))) < 100 * greatest(1, coalesce(max(meta.page), 1))""",
)
def low_text_warning(spark, d):
    return C.low_text(table(spark, d, "chunk"))


def slides(spark, d):
    """Slides with the texts of all their chunks in order; words are counted without the title, which is the first line."""
    chunk = table(spark, d, "chunk").where("meta.slide is not null")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))), lambda c: c["text"])
    own = F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")
    whole = chunk.groupBy(F.col("doc_key").alias("deck"), F.col("meta.slide").alias("slide")).agg(own.alias("text"))
    return whole.withColumn("n_words", C.n_words(F.regexp_replace("text", r"^[^\r\n]*[\r\n]*", "")))


SLIDES_SQL = f"""slides AS (SELECT deck, slide, text, coalesce(len({WORDS.format("regexp_replace(text, '^[^\r\n]*[\r\n]*', '')")}), 0) AS n_words FROM (
      SELECT doc_key AS deck, meta.slide AS slide, coalesce(string_agg(nullif(text, ''), chr(10) || chr(10) ORDER BY chunk_index, chunk_id), '') AS text FROM chunk WHERE meta.slide IS NOT NULL GROUP BY ALL))"""


def _slide_sql(least: int) -> str:
    return f"""WITH {SLIDES_SQL},
      marked AS (SELECT *, CASE WHEN n_words > {least} THEN 1 ELSE 0 END AS is_full FROM slides),
      placed AS (SELECT *, coalesce(sum(is_full) OVER (PARTITION BY deck ORDER BY slide ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before,
                 sum(is_full) OVER (PARTITION BY deck) AS n_full FROM marked),
      grouped AS (SELECT deck, least(n_before, greatest(n_full - 1, 0)) AS nth, min(slide) AS slide, string_agg(CAST(slide AS VARCHAR), ',' ORDER BY slide) AS slides,
                  coalesce(min(CASE WHEN is_full = 1 THEN slide END), min(slide)) AS page, max(is_full) AS is_real,
                  coalesce(string_agg(nullif(text, ''), chr(10) || chr(10) ORDER BY slide), '') AS text FROM placed GROUP BY ALL)
      SELECT deck, slide, slides, page, md5(text) AS text_hash FROM grouped WHERE is_real = 1 OR text <> ''"""


def _slide_chunks(spark, d, least):
    return C.slide_chunks(slides(spark, d), least).select("deck", "slide", F.array_join("slides", ",").alias("slides"), "page", F.md5(F.col("text").cast("binary")).alias("text_hash"))


@CORE.query("slide_chunks", _slide_sql(4))
def slide_chunks(spark, d):
    return _slide_chunks(spark, d, 4)


@CORE.query("slide_chunks_coarse", _slide_sql(60))
def slide_chunks_coarse(spark, d):
    """Slides of up to 60 words count as near-empty, so that many are merged."""
    return _slide_chunks(spark, d, 60)


@CORE.query("near_empty_slides", f"WITH {SLIDES_SQL} SELECT deck, slide, n_words, n_words <= 4 AS near_empty, n_words <= 25 AS sparse FROM slides")
def near_empty_slides(spark, d):
    """The words of every slide beside its title, and whether it has so few that it joins the next one."""
    return slides(spark, d).select("deck", "slide", "n_words", (F.col("n_words") <= 4).alias("near_empty"), (F.col("n_words") <= 25).alias("sparse"))


DOCUMENT_PARTS = "SELECT doc_id AS key, 0 AS part, NULL::INTEGER AS page, text FROM documents"
CHUNK_PARTS = "SELECT doc_key AS key, row_number() OVER (PARTITION BY doc_key ORDER BY chunk_index, chunk_id) AS part, meta.page AS page, text FROM chunk WHERE meta.slide IS NULL AND doc_key IS NOT NULL"
PROSE = "CAST(chunk_index AS INTEGER) AS chunk_index, text, CAST(page AS INTEGER) AS page, heading, heading_path, has_table, has_image"


def _documents_as_prose(spark, d):
    docs = table(spark, d, "documents")
    return C.prose_chunks(docs.select("doc_id", C.markdown_items(F.col("text"), F.lit(None)).alias("items")))


@CORE.query("prose_chunks", f"WITH RECURSIVE {prose_ctes(DOCUMENT_PARTS)} SELECT key AS doc_id, {PROSE} FROM prose")
def prose_chunks(spark, d):
    return _documents_as_prose(spark, d)


@CORE.query(
    "prose_chunk_stats",
    f"""WITH RECURSIVE {prose_ctes(DOCUMENT_PARTS)} SELECT key AS doc_id, count(*) AS n_chunks, count(*) FILTER (has_table) AS n_tables,
        CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT heading) AS n_headings FROM prose GROUP BY key""",
)
def prose_chunk_stats(spark, d):
    """Chunks, tables and characters of each document when cut as prose."""
    return _documents_as_prose(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.count_if("has_table").alias("n_tables"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("heading").alias("n_headings")
    )


@CORE.query("section_chunks", f"WITH RECURSIVE {prose_ctes(CHUNK_PARTS)} SELECT key AS doc_key, {PROSE} FROM prose")
def section_chunks(spark, d):
    """Documents put together from their chunks and cut again by sections, each chunk with the page it begins on."""
    parts = table(spark, d, "chunk").where("meta.slide is null and doc_key is not null").withColumn("page", F.col("meta.page"))
    return C.prose_chunks(C.document_items(parts, "doc_key", ["chunk_index", "chunk_id"], "text", "page"), "doc_key")


@CORE.query(
    "chunk_stats",
    """SELECT doc_key, count(*) AS n_chunks, count(*) FILTER (WHERE meta.has_table) AS n_tables, count(*) FILTER (WHERE meta.has_image) AS n_images,
              CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars FROM chunk GROUP BY doc_key""",
)
def chunk_stats(spark, d):
    return table(spark, d, "chunk").groupBy("doc_key").agg(
        F.count("*").alias("n_chunks"), F.count_if("meta.has_table").alias("n_tables"), F.count_if("meta.has_image").alias("n_images"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"),
    )


MARKER_SQL = """'<!-- chunk' || coalesce(' index=' || chunk_index, '') || coalesce(' slide=' || meta.slide, '')
    || CASE WHEN len(meta.slides) > 0 THEN ' slides=' || array_to_string(meta.slides, ',') ELSE '' END || coalesce(' page=' || meta.page, '')
    || CASE WHEN coalesce(meta.heading_path, '') <> '' THEN ' heading="' || replace(meta.heading_path, '"', '''') || '"' ELSE '' END
    || CASE WHEN meta.has_table THEN ' table=true' ELSE '' END || CASE WHEN meta.has_image THEN ' image=true' ELSE '' END || ' -->'"""


@CORE.query("chunk_markers", f"SELECT chunk_id, {MARKER_SQL} AS marker FROM chunk")
def chunk_markers(spark, d):
    return table(spark, d, "chunk").select("chunk_id", C.marker(F.col("chunk_index"), F.col("meta")).alias("marker"))


@CORE.query(
    "marker_roundtrip",
    """SELECT chunk_id, chunk_index, meta.slide AS slide, CASE WHEN len(meta.slides) > 0 THEN array_to_string(meta.slides, ',') END AS slides, meta.page AS page,
              replace(nullif(meta.heading_path, ''), '"', '''') AS heading_path, coalesce(meta.has_table, false) AS has_table, coalesce(meta.has_image, false) AS has_image FROM chunk""",
)
def marker_roundtrip(spark, d):
    """The fields of chunks as they come back from their markers."""
    marked = table(spark, d, "chunk").select("chunk_id", C.marker(F.col("chunk_index"), F.col("meta")).alias("m"))
    back = marked.select("chunk_id", *C.parse_marker(F.col("m")))
    return back.select(
        "chunk_id", "chunk_index", "slide", "slides", "page", "heading_path", F.coalesce("has_table", F.lit(False)).alias("has_table"), F.coalesce("has_image", F.lit(False)).alias("has_image")
    )


@CORE.query(
    "processed_roundtrip",
    """SELECT doc_key, count(*) AS n_chunks, CAST(sum(length(regexp_replace(text, '^[\\s\\x0B\\p{Z}\\x{85}]+|[\\s\\x0B\\p{Z}\\x{85}]+$', '', 'g'))) AS BIGINT) AS n_chars
       FROM chunk WHERE regexp_replace(coalesce(text, ''), '^[\\s\\x0B\\p{Z}\\x{85}]+|[\\s\\x0B\\p{Z}\\x{85}]+$', '', 'g') <> '' GROUP BY doc_key""",
)
def processed_roundtrip(spark, d):
    """Chunks written to one file a document and read back: how many, and their characters."""
    back = C.parse_processed(C.processed_texts(table(spark, d, "chunk")))
    return back.groupBy("doc_key").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


@CORE.query(
    "ocr_rows",
    """SELECT l_orderkey AS image, CAST(floor(l_quantity / 12.0) AS BIGINT) AS "row",
              string_agg(l_returnflag || l_linenumber, ' | ' ORDER BY l_extendedprice, l_returnflag || l_linenumber) AS line FROM lineitem GROUP BY ALL""",
)
def ocr_rows(spark, d):
    """Order lines as boxes of text on an image: their quantity is the height, their price the place in a row."""
    boxes = table(spark, d, "lineitem").withColumn("text", F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    return C.image_text_rows(boxes, "l_orderkey", "l_quantity", "l_extendedprice", "text", 12.0)


@CORE.query(
    "ocr_texts",
    """WITH boxes AS (SELECT l_orderkey AS image, l_extendedprice / 100 AS top, l_quantity AS lft, l_returnflag || l_linestatus || l_linenumber AS text, l_discount * 10 AS score,
              max(l_extendedprice / 100) OVER (PARTITION BY l_orderkey) AS height FROM lineitem),
            lines AS (SELECT image, floor(top / greatest(12.0, height / 60.0)) AS r, string_agg(text, ' ' ORDER BY lft, text) AS line FROM boxes WHERE score >= 0.5 AND height >= 80 GROUP BY ALL),
            texts AS (SELECT image, string_agg(line, chr(10) ORDER BY r) AS text FROM lines GROUP BY image)
       SELECT image, text FROM texts WHERE length(text) >= 16""",
)
def ocr_texts(spark, d):
    """Order lines as boxes on an image: the price is how far down they are, the quantity how far right, the discount how sure."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image"), (F.col("l_extendedprice") / 100).alias("top"), F.col("l_quantity").alias("left"),
        F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("text"), (F.col("l_discount") * 10).alias("score"),
    )
    sizes = lines.groupBy("image").agg(F.max("top").alias("height")).withColumn("width", F.lit(0.0))
    return C.image_texts(lines.join(sizes, "image"))


@CORE.query(
    "table_confidence",
    """WITH t AS (SELECT chunk_id, list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda x: starts_with(x, '|') AND NOT regexp_matches(x, '^[|: -]+$')) AS r FROM chunk WHERE text IS NOT NULL),
            s AS (SELECT chunk_id, len(r) AS n_rows, list_max(list_transform(r, lambda x: len(string_split(x, '|')) - 2)) AS n_cols,
                         list_sum(list_transform(r, lambda x: len(list_filter(string_split(x, '|'), lambda c: trim(c) <> '')))) AS n_cells FROM t WHERE len(r) > 0)
       SELECT chunk_id, n_rows, n_cols, CAST(n_cells AS BIGINT) AS n_cells, n_rows * n_cols >= 4 AND n_cells * 2 < n_rows * n_cols AS doubtful FROM s""",
)
def table_confidence(spark, d):
    """Rows, columns and filled cells of the tables in chunks; doubtful where under half is filled."""
    rows = F.filter(F.split(F.regexp_replace("text", "\r", ""), "\n"), lambda x: x.startswith("|") & ~x.rlike(r"^[|: -]+$"))
    cells = lambda x: F.split(x, r"\|", -1)
    t = table(spark, d, "chunk").select("chunk_id", rows.alias("r")).where("size(r) > 0")
    s = t.select(
        "chunk_id", F.size("r").alias("n_rows"), F.array_max(F.transform("r", lambda x: F.size(cells(x)) - 2)).alias("n_cols"),
        F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + F.size(F.filter(cells(x), lambda c: F.trim(c) != ""))).alias("n_cells"),
    )
    return s.withColumn("doubtful", (F.col("n_rows") * F.col("n_cols") >= 4) & (F.col("n_cells") * 2 < F.col("n_rows") * F.col("n_cols")))


@CORE.query("json_replies", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE props IS NOT NULL""")
def json_replies(spark, d):
    """A JSON object found within talk around it: from the first brace to the last."""
    told = table(spark, d, "events").where("props is not null").select("event_id", F.concat(F.lit("Here it is: "), "props", F.lit(" - done.")).alias("reply"))
    inner = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.try_parse_json("reply"), F.try_parse_json(inner))
    return told.select("event_id", F.try_variant_get(parsed, "$.k", "int").alias("k"))
