"""Writes to pages, the applied clean-up, backfills, boxes, and meetings of blocks."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.operators import manifest as M
from corpusmill.operators import retrieval as R
from corpusmill.operators import wiki as W
from corpusmill.plans.manifest import pick
from corpusmill.plans.search import search_depth

PAGE = "page_id long, slug string, body string, title string, tags array<string>, folder string"


def test_patterns(spark):
    rows = [("Plan.pdf", "P[k-m]an.*", True), ("Plan.pdf", "[!a-z]lan.pdf", True), ("plan.pdf", "[!a-z]lan.pdf", False), ("a[1.pdf", "a[1.pdf", True), ("x.pdf", "*.[pP][dD]?", True), ("a.b", "a?b", True), ("aXb", "a.b", False)]
    rows += [("a+b(1).pdf", "*(1)*", True), ("A.pdf", "a*", False), (None, "*", None)]
    got = spark.createDataFrame(rows, "n string, p string, want boolean").select("want", M.matches_glob(F.col("n"), F.col("p")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_backfill(spark):
    scanned = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None), ("e", "5")], "path string, hash string")
    state = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3"), ("d", None)], "path string, hash string")
    done = spark.createDataFrame([("a",), ("a",), ("b",), ("d",)], "path string")
    assert sorted(r["path"] for r in M.to_do(scanned, done, state).collect()) == ["b", "c", "d", "e"]
    assert [r["path"] for r in pick(scanned, ("a", "e"), 1).collect()] == ["a"] and pick(scanned, (), 0).count() == 5 and pick(scanned, ("c",), 0).count() == 1


def test_writes(spark):
    long = "\n".join("abcdefgh")
    rows = [
        (1, "wiki/entities/a.md", "new [[b]] and [[Two]] and [[ghost]]", None), (2, "wiki/entities/b.md", "x", long), (3, "wiki/entities/b.md", "x, which is No Longer so", long),
        (4, "wiki/../etc/x.md", "x", None), (5, "notes/x.md", "x", None), (6, "wiki/x.md", "see /home/me", None), (7, "wiki/index.md", "see /home/me", long), (8, "wiki/log.md", "x", long),
        (9, "wiki/e.md", "\n".join("abcd"), long), (10, "wiki/f.md", "x", "a\nb\nc"), (11, None, "x", None),
    ]
    writes = spark.createDataFrame(rows, "id int, path string, content string, existing string")
    got = {r["id"]: r for r in W.write_actions(writes, spark.createDataFrame([("two",)], "slug string"), "id").collect()}
    assert {i: (r["action"], r["reason"]) for i, r in got.items() if i != 11} == {
        1: ("written", None), 2: ("rejected", "truncated"), 3: ("updated", None), 4: ("rejected", "outside"), 5: ("rejected", "outside"), 6: ("rejected", "raw path"),
        7: ("dropped", None), 8: ("appended", None), 9: ("updated", None), 10: ("updated", None),
    }
    assert got[1]["content"] == "new [[b]] and [[Two]] and ghost" and got[1]["n_unlinked"] == 1
    assert W.write_actions(writes.limit(0), spark.createDataFrame([], "slug string"), "id").count() == 0


def test_clean_up(spark):
    rows = [
        (1, "plan", "s", "The Plan", None, "sources"), (2, "plan-2", "c", " the plan", None, "concepts"), (3, "e", "[[plan-2]] [[stub]] [[plan|P]] [[gone]]", "E", None, "entities"),
        (4, "stub", "x", "Stub", ["stub"], "entities"), (5, "plan-0", "s", "THE PLAN", None, "sources"), (6, "f", None, None, [], "entities"), (7, "g", "auto-generated stub", "G", None, "entities"),
    ]
    pages = spark.createDataFrame(rows, PAGE)
    assert [tuple(r) for r in W.source_doubles(pages).collect()] == [(2, "plan-2", "plan-0")]
    assert {r["page_id"]: r["body"] for r in W.cleaned(pages).collect()} == {1: "s", 3: "[[plan-0]] stub [[plan|P]] gone", 5: "s", 6: None}
    lines = W.digest(pages.withColumn("entity_type", F.lit("firm")).withColumn("domain", F.lit(None).cast("string")), 30)
    assert [r["line"] for r in lines.collect()] == ["  [[plan-2]]  the plan"]


def test_boxes(spark):
    rows = [("i", 100, 1200, 5.0, 9.0, "right", 0.9), ("i", 100, 1200, 19.0, 1.0, "left and more", 0.9), ("i", 100, 1200, 21.0, 1.0, " below ", None), ("i", 100, 1200, 1.0, 0.0, "unsure", 0.4), ("i", 100, 1200, 1.0, 0.0, " ", 0.9)]
    rows += [("small", 70, 79, 1.0, 1.0, "long enough to be a text", 0.9), ("short", 500, 500, 1.0, 1.0, "too short", 0.9), ("edge", 80, 10, 1.0, 1.0, "sixteen letters.", 0.5)]
    df = spark.createDataFrame(rows, "image string, width int, height int, top double, left double, text string, score double")
    assert {r["image"]: r["text"] for r in C.image_texts(df).collect()} == {"i": "left and more right\nbelow", "edge": "sixteen letters."}


@pytest.mark.parametrize("k, want", [(5, (5, 7)), (0, (1, 3)), (25, (25, 25)), (99, (25, 25)), (24, (24, 25))])
def test_depth_of_a_search(k, want):
    assert search_depth(k) == want


def test_vectors_in_blocks(spark, monkeypatch):
    for name, n in (("QUERIES", 3), ("ROWS", 16), ("STEP", 5)):
        monkeypatch.setattr(f"corpusmill.operators.retrieval.{name}", n)
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(60, 4)).round(2)
    x[7] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, []), (102, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 5 = 0 or vec_id > 99").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in R.vector_top(df, asked, 4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for q in range(0, 60, 5):
        score = np.round(unit @ unit[q], 5)
        for rank, i in enumerate(sorted(range(60), key=lambda i: (-score[i], i))[:4], 1):
            want[q, rank] = i
    assert got == want and R.vector_top(df.limit(0), asked.limit(0), 4).count() == 0


def test_similar_names_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("corpusmill.operators.retrieval.QUERIES", 2)
    monkeypatch.setattr("corpusmill.operators.retrieval.ROWS", 7)
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "group", "steel", "of", "a"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4))) + rnd.choice(["", "x", " ltd"])) for i in range(45)]
    df = spark.createDataFrame(rows, "page_id long, name string")
    got = {(r["query_id"], r["page_id"]) for r in R.similar_names(df.where("page_id % 5 = 0"), df).collect()}

    def like(a, b):
        first = a.split(" ")[0]
        return len(first) > 3 and first == b.split(" ")[0] or SequenceMatcher(None, a, b).ratio() >= 0.6

    assert got == {(q, p) for q, a in rows if q % 5 == 0 for p, b in rows if p != q and (like(a, b) if q < p else like(b, a))}
