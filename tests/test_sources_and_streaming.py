import hashlib
import json

from corpusmill.sources import files as FS
from corpusmill.sources import markdown as MD
from corpusmill.streaming.feed import follow, state

EVENT = "seq long, path string, event string, hash string, previous_hash string, timestamp string"


def test_pages_on_disk(spark, tmp_path):
    root = tmp_path / "wiki"
    (root / "entities").mkdir(parents=True)
    (root / "entities" / "acme.md").write_text("---\ntitle: Acme: the firm\ntags: [a, b]\n---\n\n# Acme\n\nBody [[x]].\n")
    (root / "entities" / "loose.md").write_text("title: Loose\ntype: entity\n\n# Loose\nText\n")
    (root / "entities" / "none.md").write_text("no fields here")
    (root / "index.md").write_text("# Index")
    got = {r["slug"]: (r["folder"], json.loads(r["fields"]), r["body"]) for r in MD.read_pages(spark, str(root)).collect()}
    assert set(got) == {"acme", "loose", "none"}
    assert got["acme"][0] == "entities" and got["acme"][1]["title"] == "Acme: the firm"
    assert got["loose"][1] == {"title": "Loose", "type": "entity"} and got["loose"][2].startswith("# Loose")
    assert got["none"] == ("entities", {}, "no fields here")


def test_broken_blocks():
    assert MD.split_page("---\n- a list\n---\nx")[0] == {}
    assert MD.split_page("---\nnever closed: 1") == ({}, "---\nnever closed: 1")
    assert MD.split_page("") == ({}, "")
    fields = {"title": 'A "b": c', "tags": ["x", "y: z"], "n": None}
    assert MD.split_page(MD.render_page(fields, "Body\n\nmore"))[0] == fields


def test_feed(spark, tmp_path):
    inbox, log, marks = (str(tmp_path / x) for x in ("in", "log", "marks"))

    def arrive(rows, name):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{inbox}/{name}")
        schema = spark.createDataFrame([], EVENT).schema
        follow(spark, f"{inbox}/*", schema, log, marks).awaitTermination()
        return {r["key"]: r["content"] for r in state(spark, log).collect()}

    first = [(1, "a", "ingested", "h0", None, "2024-01-01T00:00:00Z"), (2, "b", "ingested", "k", None, "2024-01-01T00:00:00Z")]
    assert arrive(first, "one") == {"a": "h0", "b": "k"}
    late = [(4, "a", "updated", "h2", "h1", "2024-01-03T00:00:00Z"), (5, "b", "deleted", "k", None, "2024-01-02T00:00:00Z")]
    assert arrive(late, "two") == {"a": "h2"}
    assert arrive([(6, "a", "updated", "h1", "h0", "2024-01-02T00:00:00Z"), late[0]], "three") == {"a": "h2"}


def test_roots_and_files(spark, tmp_path):
    root = tmp_path / "r"
    (root / "sub").mkdir(parents=True)
    for name in ("a.PDF", "~$b.docx", ".c.pdf", "d copy.docx", "e.txt", "sub/f.pptx"):
        (root / name).write_bytes(name.encode())
    config = tmp_path / "sources.json"
    config.write_text(json.dumps([{"name": "R", "path": "r", "exclude": ["*copy*"]}, {"name": "flat", "path": str(root), "recurse": False}, {"path": "x"}, 5, {"name": "gone", "path": "nowhere"}]))
    roots = FS.read_config(spark, str(config), str(tmp_path))
    assert {r["name"] for r in roots.collect()} == {"R", "flat", "gone"}
    got = {(r["path"], r["hash"]) for r in FS.scan(spark, roots).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {("R/a.PDF", h("a.PDF")), ("R/sub/f.pptx", h("sub/f.pptx")), ("flat/a.PDF", h("a.PDF")), ("flat/d copy.docx", h("d copy.docx"))}
    assert [r["name"] for r in FS.read_config(spark, str(tmp_path / "none.json")).collect()] == ["Local"]
    assert FS.scan(spark, roots.where("name = 'gone'")).count() == 0


def test_logs(spark, tmp_path):
    file = tmp_path / "events.json"
    file.write_text(json.dumps([{"path": "a", "event": "ingested", "hash": "1", "chunks": 3}, {"path": "a", "event": "deleted"}, {"no": "path"}]))
    got = FS.read_events(spark, str(file))
    assert [(r["seq"], r["event"], r["chunks"]) for r in got.orderBy("seq").collect()] == [(0, "ingested", 3), (1, "deleted", None)]
    file.write_text("not json")
    assert FS.read_events(spark, str(file)).count() == FS.read_events(spark, str(tmp_path / "none")).count() == 0
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", "ingested"), ("b", "ingested")], "path string, event string").coalesce(1)
    FS.append_events(log, rows)
    FS.append_events(log, rows)
    assert [r["seq"] for r in spark.read.parquet(log).orderBy("seq").collect()] == [1, 2, 3, 4]
    (tmp_path / "done.json").write_text('{"done": ["x", 3, "y"]}')
    assert {r["key"] for r in FS.read_done(spark, str(tmp_path / "done.json")).collect()} == {"x", "y"}
    assert FS.read_done(spark, str(tmp_path / "no.json")).count() == 0
