"""A row of nulls in every column, beside a sound one, and rows repeated whole."""

from corpusmill.llm.canonical import map_pages
from corpusmill.llm.duplicates import best_representatives
from corpusmill.llm.names import link_names
from corpusmill.llm.packing import pack
from corpusmill.llm.scans import clean_scans
from corpusmill.llm.splitting import split_oversized
from corpusmill.llm.tokenizer import encode_column
from corpusmill.llm.truncation import truncated

BIG = (1 << 60) + 1  # an id that a float can't hold


def frame(spark, schema, *rows):
    n = len(schema.split(", ")) if "<" not in schema else len(rows[0])
    return spark.createDataFrame([tuple([None] * n)] * 2 + list(rows) * 2, schema)


def test_names(spark):
    df = frame(spark, "page long, title string, aliases array<string>", (BIG, "Walter Bikozoorg", None))
    assert [r["page"] for r in link_names(df).collect()] == [BIG]


def test_values(spark):
    pages = spark.createDataFrame([(None, None, None, None), (BIG, "Probe", None, [None, "x"])], "page_id long, entity_type string, domain string, tags array<string>")
    vocab = spark.createDataFrame([(None, None, None), ("entity_type", "sensor", "covers probe"), ("tag", None, "covers x")], "field string, value string, description string")
    assert {(r["page_id"], r["field"], r["canonical"]) for r in map_pages(pages, vocab).collect()} == {(BIG, "entity_type", "sensor"), (BIG, "tag", "")}


def test_splitting(spark):
    df = frame(spark, "chunk_id long, text string, meta struct<page:int>", (BIG, "w " * 800, None))
    assert {r["chunk_id"] for r in split_oversized(df).collect()} == {BIG}
    null_id = spark.createDataFrame([(None, "w " * 800, None)], "chunk_id long, text string, meta struct<page:int>")
    assert {r["chunk_id"] for r in split_oversized(null_id).collect()} == {None}


def test_tokens(spark):
    df = frame(spark, "doc_id long, text string", (BIG, "a"))
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in encode_column(df, "doc_id", "text").collect()) == [(0, 0), (0, 0), (BIG, 1), (BIG, 1)]


def test_packing(spark):
    df = frame(spark, "doc_id long, n int", (BIG, 5), (7, 150))
    got = pack(df, "doc_id", "n", 100).collect()
    assert sum(r["size"] for r in got) == 310 and {r["doc_id"] for r in got} == {None, BIG, 7}
    nulls = pack(spark.createDataFrame([(None, 5), (BIG, 5)], "doc_id long, n int"), "doc_id", "n", 100).collect()
    assert {r["doc_id"] for r in nulls} == {None, BIG}


def test_truncation(spark):
    df = frame(spark, "doc_id long, text string, source string", (BIG, "The fox jum [...]", None))
    assert [(r["doc_id"], r["reason"]) for r in truncated(df).collect()] == [(BIG, "mark")]


def test_scans(spark):
    meta = "struct<slide:int,slides:array<int>,page:int,heading_path:string,has_table:boolean,has_image:boolean>"
    text = "\n".join(["the committee reviewed the whole of the programme and", "then went on to other matters of the year without any"] * 3)
    df = frame(spark, f"chunk_id long, doc_key string, chunk_index int, text string, meta {meta}", (BIG, "a.pdf", 0, text, None))
    assert [r["chunk_id"] for r in clean_scans(df).dropDuplicates(["chunk_id"]).collect()] == [BIG]


def test_duplicates(spark):
    schema = "seq long, path string, event string, hash string, previous_hash string, timestamp string, relative_path string, display_name string"
    df = frame(spark, schema, (BIG, "R/a.pdf", "ingested", "1", None, None, None, None), (BIG, "R/b.pdf", "ingested", "1", None, None, None, None))
    members, records = best_representatives(df)
    assert {(r["path"], r["keep_path"]) for r in members.collect()} == {("R/a.pdf", "R/a.pdf"), ("R/b.pdf", "R/a.pdf")} and records.count() == 1
