import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import manifest as M
from corpusmill.operators import retrieval as R
from corpusmill.operators import wiki as W

PAGE = "page_id long, slug string, body string, title string, aliases array<string>, tags array<string>, folder string, type string, updated_at string, sources array<string>"


def page(i, slug, body=None, title=None, aliases=None, tags=None, folder="entities", type="entity", updated="2024-01-01", sources=None):
    return (i, slug, body, title, aliases, tags, folder, type, updated, sources)


def test_links(spark):
    rows = [page(1, "a", "see [[B]] and [[b|Bee]], [[c#top]], [[ ghost ]] [[a]]"), page(2, "B", None), page(3, "c", ""), page(4, "lone", "[[lone]]")]
    p = spark.createDataFrame(rows, PAGE)
    assert [(r["ord"], r["target"]) for r in W.links(p).where("page_id = 1").orderBy("ord").collect()] == [(0, "b"), (1, "b"), (2, "c"), (3, "ghost"), (4, "a")]
    assert {r["page_id"]: r["n_inbound"] for r in W.inbound(p).collect()} == {1: 0, 2: 2, 3: 1, 4: 0}
    assert [r["target"] for r in W.broken_links(p).collect()] == ["ghost"]
    assert {r["page_id"]: (r["body"], r["n_changed"]) for r in W.unlink_unresolved(p).collect()} == {
        1: ("see [[B]] and [[b|Bee]], [[c#top]], ghost [[a]]", 1), 2: (None, 0), 3: ("", 0), 4: ("[[lone]]", 0),
    }
    renames = spark.createDataFrame([("b", "new"), ("C", None)], "old string, new string")
    assert W.repoint(p, renames).where("page_id = 1").first()["body"] == "see [[new]] and [[new]], c, [[ ghost ]] [[a]]"


def test_vocabulary(spark):
    vocab = spark.createDataFrame([("tag", "cold-chain", "covers refrigerated transport"), ("tag", "kickoff", None), ("entity_type", "supplier", "covers vendor and provider"), ("category", "x", None)], "field string, value string, description string")
    rows = [page(1, "a", tags=["Cold Chain ", "kickoff", "refrigerated transport", "nope", None, "kickoff"]), page(2, "b", tags=None), page(3, "c", tags=[])]
    p = spark.createDataFrame(rows, PAGE).withColumn("entity_type", F.lit("Vendor")).withColumn("domain", F.lit(None).cast("string")).withColumn("category", F.lit("x"))
    assert {r["page_id"]: r["tags"] for r in W.normal_tags(p, vocab).collect()} == {1: ["cold-chain", "kickoff"], 2: [], 3: []}
    assert {r["canonical"] for r in W.coerced(p, vocab, "entity_type", "entity_type").collect()} == {"supplier"}
    bad = {(r["page_id"], r["field"], r["value"]) for r in W.vocabulary_violations(p, vocab).collect()}
    assert bad == {(1, "tag", "nope"), *((i, "entity_type", "Vendor") for i in (1, 2, 3))}


def test_titles(spark):
    rows = [("Acme (company) (person)", "acme"), ("Acme (North)", "x"), ("acme-north_x", "y"), (None, "from-slug"), ("", "from_slug"), ("(company)", "only-mark")]
    q = F.array(F.lit("company"), F.lit("person"))
    got = [r[0] for r in spark.createDataFrame(rows, "t string, s string").select(W.normal_title(F.col("t"), F.col("s"), q)).collect()]
    assert got == ["Acme", "Acme (North)", "Acme North X", "From Slug", "From Slug", "Only Mark"]


def test_checks(spark):
    rows = [page(1, "a", title="Same", aliases=["Other", None], sources=[]), page(2, "b", title=" same", aliases=None, type="", updated=None), page(3, "c", title="OTHER", sources=[])]
    p = spark.createDataFrame(rows, PAGE)
    assert {r["page_id"]: r["missing"] for r in W.missing_fields(p).collect()} == {2: "type,updated_at,sources"}
    assert [(r["title"], r["n_pages"]) for r in W.duplicate_titles(p).collect()] == [("same", 2)]
    assert [r["name"] for r in W.alias_collisions(p).collect()] == ["other"]
    log = spark.createDataFrame([(1, "2024-03-01 wrote Other things"), (2, "2023-01-01 same"), (3, "no date same"), (4, "2024-05-01 SAME again")], "line_no long, line string")
    assert {r["page_id"]: r["log_date"] for r in W.stale(p, log).collect()} == {1: "2024-05-01", 3: "2024-03-01"}


def test_excerpt(spark):
    got = [r[0] for r in spark.createDataFrame([(" one two three ",), ("a" * 9 + " bb",), ("",), (None,)], "b string").select(W.excerpt(F.col("b"), 9)).collect()]
    assert got == ["one two …", "aaaaaaaaa …", "", None]


def test_names_of_copies(spark):
    names = {"a copy - copy_1": "a", "Report copy (1)": "report", "Report v3": "report", "report_1_1": "report", "Plan v2.5": "plan", "copycat": "copycat", "": "", "Plan v2 copy": "plan"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", M.normal_base(F.col("n")).alias("b"))
    assert {r["n"]: r["b"] for r in df.collect()} == names


def test_file_rules(spark):
    df = spark.createDataFrame([("r/~$a.docx",), ("r/.a.pdf",), ("r/A.PDF",), ("r/a.txt",), ("r/no",), ("r/_x.pptx",)], "p string")
    got = [r[0] for r in df.select(M.is_supported(M.file_name(F.col("p")))).collect()]
    assert got == [False, False, True, False, False, True]
    globs = spark.createDataFrame([("a (1).pdf", "*(1)*", True), ("axb", "a?b", True), ("a.b", "a.c", False), ("A", "a", False), ("x", "", False)], "n string, g string, want boolean")
    assert all(r["want"] == r["got"] for r in globs.select("want", M.matches_glob(F.col("n"), F.col("g")).alias("got")).collect())


def test_diff(spark):
    state = spark.createDataFrame([("same", "1", "updated"), ("other", "1", "ingested"), ("back", "1", "deleted"), ("away", "1", "ingested"), ("gone", "1", "Deleted"), ("nohash", None, "ingested")], "path string, hash string, event string")
    scan = spark.createDataFrame([("same", "1"), ("other", "2"), ("back", "1"), ("fresh", "1"), ("nohash", None)], "path string, hash string")
    assert {r["path"]: r["status"] for r in M.diff(scan, state).collect()} == {
        "same": "unchanged", "other": "changed", "back": "new", "fresh": "new", "away": "deleted", "nohash": "unchanged",
    }


def test_removals(spark):
    rows = [(1, "d/Plan.pdf"), (2, "d/Plan copy.pdf"), (3, "d/Plan_1.pdf"), (4, "d/Deck v1.pdf"), (5, "d/Deck v2.pdf"), (6, "d/Deck v2.0.pdf"), (7, "e/Plan copy.pdf"), (8, "d/Week 12 v1.pdf"), (9, "d/Week 12 v2.pdf")]
    s = spark.createDataFrame([(i, p, "ingested", None) for i, p in rows], "seq long, path string, event string, relative_path string")
    v = M.file_variants(s)
    assert {(r["keep"], r["remove"]) for r in M.artifact_removals(v).collect()} == {("d/Plan.pdf", "d/Plan copy.pdf"), ("d/Plan.pdf", "d/Plan_1.pdf")}
    assert {(r["keep"], r["remove"]) for r in M.version_removals(v).collect()} == {("d/Deck v2.pdf", "d/Deck v1.pdf"), ("d/Deck v2.pdf", "d/Deck v2.0.pdf")}


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.where("vec_id % 50 = 0 and vec_id < 300").withColumnRenamed("vec_id", "query_id")
    got = R.vector_top(df, q, 4).collect()
    n = x.astype(np.float32).astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    for i in range(0, 300, 50):
        s = np.round(n @ n[i], 5)
        want = sorted(range(300), key=lambda j: (-s[j], j))[:4]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want
    assert R.vector_top(df, q.limit(0)).count() == 0


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog"), (3, None), (4, ""), (5, "cat cat cat")], "doc_id long, text string")
    q = spark.createDataFrame([(10, "Cat!"), (11, "unknown"), (12, None)], "query_id long, text string")
    got = R.bm25(docs, q, 5).collect()
    assert [(r["query_id"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(10, 5), (10, 1)]
    assert R.bm25(docs.limit(0), q, 5).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, item long, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "query_id long, item long, rank int")
    assert [r["item"] for r in R.fuse(a, b).orderBy("rank").collect()] == [8, 7, 9]


def test_similar_names(spark):
    rnd = random.Random(2)
    names = [(i, "".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 9))).strip() or "x") for i in range(60)]
    df = spark.createDataFrame(names, "page_id long, name string")
    got = {(r["query_id"], r["page_id"]) for r in R.similar_names(df.where("page_id % 10 = 0"), df).collect()}

    def like(a, b):
        return SequenceMatcher(None, a, b).ratio() >= 0.6 or (a.split()[0] == b.split()[0] and len(a.split()[0]) > 3)

    want = {(q, p) for q, a in names if q % 10 == 0 for p, b in names if p != q and (like(a, b) if q < p else like(b, a))}
    assert got == want
