import pytest

from corpusmill.llm.duplicates import agreed, align, base_name, best_representatives, consensus, consensus_values, duplicate_groups
from corpusmill.llm.scans import clean_scans, divisions, misread_words, number_kind, readings, skeleton
from corpusmill.llm.truncation import cut_words, ending, field_limits, truncated, truncation_report

EVENT = "seq long, path string, event string, hash string, previous_hash string, timestamp string, relative_path string, display_name string, rank int, grp string"


@pytest.mark.parametrize(
    "file, other",
    [
        ("Status Report Q2 final v2.pptx", "Status Report Q2.pptx"), ("Copy of Offer Draft Issue 7.pdf", "Offer Draft Issue 7 v10.docx"), ("Kopie von Cost Baseline.pptx", "Cost_Baseline.pptx"),
        ("Cost Baseline - Copy - Copy.pptx", "COST BASELINE.pptx"), ("Étude de marché_1.pdf", "Étude-de-marché.pdf"), ("Plan - copy (1).pdf", "Plan(1).docx"), ("Kickoff Deck Part 2_1.pptx", "Kickoff Deck Part 2 copy_1.pptx"),
        ("Risk Register 2024-04-01_v2.5.docx", "Risk Register 2024-04-01 final2.docx"), ("Training\xa0Plan.pdf", "Training  Plan DRAFT.pdf"), ("Report Q2 (draft).pptx", "Report Q2.pptx"), ("Demand Forecast-1.pdf", "Demand Forecast.pdf"),
        ("Steering Minutes 2024-04-01_1.pdf", "Steering Minutes 2024-04-01.pdf"),
    ],
)
def test_same_name(file, other):
    assert base_name(file) == base_name(other)


@pytest.mark.parametrize(
    "file, other",
    [
        ("Risk Register Part 1.pdf", "Risk Register Part 2.pdf"), ("Plan 2023.pdf", "Plan 2024.pdf"), ("Minutes 2024-03-01.pdf", "Minutes 2024-04-01.pdf"), ("Deck Week 12.pdf", "Deck Week 13.pdf"),
        ("Offer Draft.pdf", "Offer.pdf"), ("Report North.pdf", "Report South.pdf"), ("Annex_1.pdf", "Annex_2.pdf"), ("Report Q1.pdf", "Report.pdf"), ("Plan Issue 7.pdf", "Plan Issue 8.pdf"),
    ],
)
def test_other_name(file, other):
    assert base_name(file) != base_name(other)


def test_groups(spark):
    files = [("R/a/Plan.pdf", "1"), ("R/a/Plan v2.pdf", "2"), ("R/b/scan77.pdf", "2"), ("S/a/Plan.pdf", "1"), ("R/c/Solo.pdf", ""), ("R/c/Other.pdf", ""), ("R/d/x.pdf", "9"), ("nofolder.pdf", "9")]
    got = {}
    for r in duplicate_groups(spark.createDataFrame(files, "path string, hash string")).collect():
        got.setdefault(r["group"], set()).add(r["path"])
    assert list(got.values()) == [{"R/a/Plan.pdf", "R/a/Plan v2.pdf", "R/b/scan77.pdf"}]
    assert duplicate_groups(spark.createDataFrame([], "path string, hash string")).count() == 0


def test_consensus(spark):
    p = []
    for v in ("a b c", "a c", "x b c", "a b c d"):
        p = align(p, [{t: 1.0} for t in v.split()])
    assert consensus(p, 4.0) == ["a", "b", "c"]
    rows = [("g", "f", "Status Report", 1.0), ("g", "f", "Status Report v2", 1.0), ("g", "f", "Status Reports", 1.0), ("g", "f", None, 5.0), ("g", "f", " ", 5.0), ("h", "f", "only", 1.0)]
    rows += [("big", "f", f"name {i} of plan", 1.0) for i in range(700)] + [("big", "f", "name of plan", 1.0)]
    got = {r["group"]: r["value"] for r in consensus_values(spark.createDataFrame(rows, "group string, field string, value string, weight double")).collect()}
    assert got == {"g": "Status Report", "h": "only", "big": "name of plan"}


def test_consensus_over_levels(spark, monkeypatch):
    monkeypatch.setattr("corpusmill.llm.duplicates.BLOCK_VALUES", 4)
    rows = [("g", "f", f"plan {'abcdefghij'[i % 10]}{i} of works", 1.0) for i in range(150)] + [("g", "f", "plan of works", 1.0)]
    got = consensus_values(spark.createDataFrame(rows, "group string, field string, value string, weight double")).collect()
    assert [(r["group"], r["value"]) for r in got] == [("g", "plan of works")]


def test_consensus_in_blocks_is_that_of_the_whole(spark, monkeypatch):
    """A winning token that is light in some blocks isn't lost, and groups of either size give the same."""
    rows = [("g", "f", f"{'x y z'[2 * (i % 3)]}{i} {'plan' if i % 5 else f'p{i}'} of {i} works", 1.0 + i % 2) for i in range(90)] + [("g", "f", "plan of works", 0.5)]
    rows += [("h", "f", " ".join(f"w{i}" for i in range(600)) + f" {k}", 1.0) for k in range(12)]  # values of many tokens stay whole
    df = spark.createDataFrame(rows, "group string, field string, value string, weight double")
    want = sorted(map(tuple, consensus_values(df).collect()))
    assert ("g", "f", "plan of works") in want
    monkeypatch.setattr("corpusmill.llm.duplicates.BLOCK_VALUES", 4)
    assert sorted(map(tuple, consensus_values(df).collect())) == want


def test_only_tokens_of_half_the_weight_agree():
    assert agreed(["a b c", "a c", "x b c", "a b c d"], [1.0] * 4) == ["a", "b", "c"]
    assert agreed(["a a b", "a a c", "a d"], [1.0, 1.0, 1.0]) == ["a", "a"]
    assert agreed(["old name", "new name"], [1.0, 3.0]) == ["new", "name"] and agreed(["p", "q", "r"], [1.0] * 3) == []


def test_votes_have_weights(spark):
    """Recency, completeness and trust each turn a vote that heads alone would decide otherwise."""

    def e(i, path, h, day, rel="r", name="Plan"):
        return (i, path, "ingested", h, None, f"2024-01-{day:02d}T00:00:00Z", rel, name, 0, "z")

    rows = [e(1, "R/a/Plan.pdf", "1", 1, name="Alpha"), e(2, "R/a/Plan v2.pdf", "2", 9, name="Beta")]  # the later one
    rows += [e(3, "R/b/Deck.pdf", "3", 2, name="Gamma"), e(4, "R/b/Deck v2.pdf", None, 2, rel=None, name="Delta"), e(5, "R/b/Deck v3.pdf", None, 2, rel=None, name=None)]  # the complete one
    rows += [e(6, "R/c/Memo.pdf", "6", 2, name="Zeta"), e(7, "R/c/Memo - Copy.pdf", "7", 2, name="Eta")]  # the original
    rows += [e(8, "R/d/Note.pdf", "8", 1, name="Old"), e(9, "R/d/Note v2.pdf", "9", 2, name="Old"), e(10, "R/d/Note v3.pdf", "10", 3, name="New")]  # the survivor is outvoted
    _, records = best_representatives(spark.createDataFrame(rows, EVENT))
    got = {r["keep_path"]: (r["display_name"], r["hash"]) for r in records.collect()}
    assert got == {"R/a/Plan v2.pdf": ("Beta", "2"), "R/b/Deck.pdf": ("Gamma", "3"), "R/c/Memo.pdf": ("Zeta", "6"), "R/d/Note v3.pdf": ("Old", "10")}


def test_survivors(spark):
    def e(i, path, h, day, rel="r", name="Plan"):
        return (i, path, "ingested", h, None, f"2024-01-{day:02d}T00:00:00Z", rel, name, 0, "z")

    rows = [
        e(1, "R/a/Plan.pdf", "1", 1), e(2, "R/a/Plan v2.pdf", "2", 2), e(3, "R/a/Plan v3.pdf", "3", 9, name="Untitled"), e(4, "R/a/Plan v4.pdf", "4", 8, rel=" "), e(5, "R/a/Plan_1.pdf", None, 7),
        e(6, "R/b/Deck.pdf", "7", 1, name="n/a"), e(7, "R/b/Deck.pptx", "8", 2, name=None, rel=None), e(8, "R/c/Alone.pdf", "55", 3), e(9, None, "1", 3),
    ]
    members, records = best_representatives(spark.createDataFrame(rows, EVENT))
    got = {r["path"]: r["keep_path"] for r in members.collect()}
    assert got == {**{f"R/a/Plan{x}.pdf": "R/a/Plan v2.pdf" for x in ("", " v2", " v3", " v4", "_1")}, "R/b/Deck.pdf": "R/b/Deck.pdf", "R/b/Deck.pptx": "R/b/Deck.pdf"}
    by = {r["keep_path"]: r for r in records.collect()}
    assert by["R/a/Plan v2.pdf"]["n_members"] == 5 and by["R/a/Plan v2.pdf"]["display_name"] == "Plan" and by["R/b/Deck.pdf"]["display_name"] is None
    members, records = best_representatives(spark.createDataFrame([], EVENT))
    assert members.count() == records.count() == 0


def test_records_of_survivors_without_a_hash(spark):
    def e(i, path, h, day, name="Plan"):
        return (i, path, "ingested", h, None, f"2024-01-{day:02d}T00:00:00Z", "r", name, 0, "z")

    rows = [e(1, "R/a/Plan.pdf", "1", 1, None), e(2, "R/a/Plan v2.pdf", None, 5), e(3, "R/b/Deck.pdf", "3", 1, None), e(4, "R/b/Deck v2.pdf", "4", 2, None), e(5, "R/b/Deck v3.pdf", "", 5)]
    rows += [e(6, "R/c/Memo.pdf", "6", 1, None), e(7, "R/c/Memo.docx", "6", 2, None), e(8, "R/c/Memo v2.pdf", "8", 3, None), e(9, "R/c/Memo v3.pdf", " ", 5)]
    rows += [e(10, "R/d/Note.pdf", None, 1), e(11, "R/d/Note v2.pdf", None, 2)]
    _, records = best_representatives(spark.createDataFrame(rows, EVENT))
    assert {r["keep_path"]: r["hash"] for r in records.collect()} == {"R/a/Plan v2.pdf": "1", "R/b/Deck v3.pdf": "4", "R/c/Memo v3.pdf": "6", "R/d/Note v2.pdf": ""}


def test_endings():
    assert ending(" \n ") is None
    assert ending("Some text. The fox ju")["kind"] == "prose" and not ending("Some text. The fox ju")["done"]
    assert ending("a | b\n| x | y |")["kind"] == "row" and ending("| x | y")["kind"] == "open row"
    assert ending("Text.\n- an item")["kind"] == "item" and ending("Kind regards,\nJane Doe")["kind"] == "signature"
    assert ending("x\n```\ncode\n```")["kind"] == "code" and ending("More: http://a.b/c")["kind"] == "link" and ending("See [[abc")["kind"] == "open link"
    assert ending("The fox jumped [...]")["mark"] == "[...]" and ending("The fox…")["mark"] == "…"
    assert ending("# Title\n## Next steps")["kind"] == "heading"


def test_cut_words(spark):
    known = spark.createDataFrame([("framework", 9), ("frame", 9), ("a", 9), ("rare", 1), ("jump", 5)], "token string, n long")
    asked = spark.createDataFrame([("framew",), ("frame",), ("j",), ("rar",), ("zz",), ("",), ("fra",)], "token string")
    assert sorted(r["token"] for r in cut_words(asked, known).collect()) == ["fra", "framew", "j"]


def test_cut_words_at_any_size(spark, monkeypatch):
    """A beginning that is RARE times rarer than its word was cut, however often it occurs; blocks of a shard change nothing."""
    known = spark.createDataFrame([("framework", 900_000), ("framew", 50), ("plan", 500), ("planning", 90_000), ("planet", 3), ("contract", 7), ("contracts", 2)], "token string, n long")
    asked = spark.createDataFrame([("framew",), ("plan",), ("contr",), ("p",), ("contract",), ("é",)], "token string")
    want = ["contr", "framew", "p"]
    assert sorted(r["token"] for r in cut_words(asked, known).collect()) == want
    monkeypatch.setattr("corpusmill.llm.truncation.BLOCK_WORDS", 1)
    assert sorted(r["token"] for r in cut_words(asked, known).collect()) == want


SENTENCES = ["The quick brown fox jumped over the fence.", "Every morning the baker opened the window.", "A framework contract was signed by the board.", "The window faces the framework of the fence."]


def corpus():
    whole = [(i, " ".join(SENTENCES[(i + k) % 4] for k in range(3 + i % 3)), "src ") for i in range(40)]
    cut = [(100, whole[0][1][:-9], "src"), (101, whole[1][1] + " The quick brown", "src"), (102, whole[2][1] + " Every mor [...]", None), (103, whole[3][1] + " The window…", "b")]
    fine = [(200, whole[0][1] + "\n\nAnd so on…", "b"), (201, whole[1][1] + "\n\nAnd so on…", "b"), (202, whole[0][1] + "\n- The fence", "b"), (203, whole[0][1] + "\n\nKind regards,\nJane Doe", "b"), (204, None, "b"), (205, "", "b"), (206, " \n", "b"), (207, "x" * 200_000 + ".", "b")]
    return whole + cut + fine + [cut[0]]


def test_truncated(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string").selectExpr("*", "1 as kind", "2 as token")
    got = {r["doc_id"]: r["reason"] for r in truncated(df).collect()}
    assert set(got) == {100, 101, 102, 103}
    assert got[100] == "word" and got[102] == got[103] == "mark"
    report = {r["source"]: (r["n_docs"], r["n_cut"]) for r in truncation_report(df).collect()}
    assert report["src"] == (43, 2) and report[None] == (1, 1) and report["b"][1] == 1
    assert truncated(df.limit(0)).count() == 0


def test_cut_short_paragraphs(spark):
    """A short last paragraph that other texts share is a closing note only if it isn't how sentences begin, and copies of a text count once."""
    whole = [r[1] for r in corpus()[:40]]
    cut = [(300, whole[4] + "\n\nThe window…"), (301, whole[5] + "\n\nThe window…"), (302, whole[6] + "\n\nMany small steps…"), (303, whole[6] + "\n\nMany small steps…")]
    notes = [(400 + i, whole[i] + "\n\nAnd so on…") for i in range(3)]
    df = spark.createDataFrame([(i, t, "a") for i, t in [*enumerate(whole), *cut, *notes]], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["reason"] for r in truncated(df).collect()} == {i: "mark" for i, _ in cut}


def test_limits_of_fields(spark):
    rows = [(100, 100 + i, i, "word") for i in range(9)] + [(n, n, n, None) for n in range(95, 106)] + [(300, 300, 1, "word")] * 9
    rows += [(50, 50, i, None) for i in range(9)] + [(70, 70, i, "word" if i < 5 else None) for i in range(9)] + [(480 + i % 2, 500, i, "word") for i in range(14)]
    chars, octets = field_limits(spark.createDataFrame(rows, "length long, n_bytes long, text_hash long, reason string"))
    assert [r["length"] for r in chars.collect()] == [100]  # equal texts count once
    assert [r["n_bytes"] for r in octets.collect()] == [500]  # not the lengths near 480


def test_cut_by_a_limit(spark):
    """Items cut at a limit in bytes look finished; others that end there show the limit."""
    cut = lambda t, n: t.encode()[:n].decode("utf-8", "ignore")
    long = [f"é{i} " + " ".join(SENTENCES[(i + k) % 4] for k in range(9)) for i in range(40)]
    rows = [(i, t, "a") for i, t in enumerate(long)] + [(100 + i, cut(t, 250 - (i % 2)) if i % 2 == 0 else t, "a") for i, t in enumerate(long[:20])]
    item = long[39][:200] + "\n- "
    item += ("the fence " * 20).encode()[: 250 - len(item.encode())].decode()
    got = {r["doc_id"]: r["reason"] for r in truncated(spark.createDataFrame([*rows, (500, item.rstrip() if len(item.rstrip().encode()) == 250 else item[:-2] + "xy", "a")], "doc_id long, text string, source string")).collect()}
    assert got.pop(500, None) in ("limit", "sentence", "word")
    assert set(got) <= {100 + i for i in range(0, 20, 2)} and len(got) >= 8


def test_lines():
    assert skeleton("Stekraqiieeff Tclecom | Data s0urces   5") == skeleton("STEKRAQUEEFF TELECOM | Data sources   12")
    assert skeleton("Tclecom Annua1 Revievv") == skeleton("Telecom Annual Review") != skeleton("Telecom Annual Report")
    assert [(a, b, j) for a, b, j, *_ in divisions(["the depa-", "", "rtment of cross-", "Title 5", "border"])] == [(0, 2, "department"), (2, 4, "crossborder")]
    assert "tested" in readings("te5ted") and "published" in readings("piiblished") and "simplified" in readings("sirnplified")


def test_divisions_of_numbered_prose():
    assert [(a, b, j) for a, b, j, *_ in divisions(["44. The team came out-", "side of regular hours", "and de-", "", "Acme", "Review", "12", "partmental"])] == [(0, 1, "outside"), (2, 7, "departmental")]


def test_misread_names(spark):
    """Rare names are set right where the form is no word's; between words of letters alone frequency decides."""
    words = [("ni8agaux", 5, 0), ("nibagaux", 12, 0), ("madi†huulv", 3, 0), ("madithuulv", 2, 0), ("lap1ekreal", 1, 0), ("laplekreal", 1, 0), ("savvikol", 2, 0), ("sawikol", 3, 0)]
    words += [("comrnittee", 5, 0), ("committee", 100, 50), ("bam", 5, 0), ("barn", 12, 0), ("navvet", 3, 0), ("nawet", 3, 0), ("b8b", 2, 1), ("bbb", 40, 1), ("x7y", 3, 0)]
    got = {r["word"]: r["meant"] for r in misread_words(spark.createDataFrame(words, "word string, n long, n_native long")).collect()}
    assert got == {"ni8agaux": "nibagaux", "madi†huulv": "madithuulv", "lap1ekreal": "laplekreal", "savvikol": "sawikol", "comrnittee": "committee"}


def test_slips_outside_of_scans(spark):
    """A few slips in other documents don't make a word of a misreading; a word that is just rare stays one."""
    words = [("comrnittee", 50, 3), ("committee", 90_000, 60_000), ("barn", 40, 30), ("bam", 90_000, 60_000), ("x" * 50 + "1y", 2, 0), ("x" * 50 + "ly", 9, 3)]
    got = {r["word"]: r["meant"] for r in misread_words(spark.createDataFrame(words, "word string, n long, n_native long")).collect()}
    assert got == {"comrnittee": "committee", "x" * 50 + "1y": "x" * 50 + "ly"}


def test_long_titles_and_large_numbers():
    assert number_kind("Page 123456", True) == "form" and number_kind("12345", True) == "bare"
    assert skeleton("A tit1e of " + "very " * 30 + "many words") == skeleton("A title of " + "very " * 30 + "many words")


def scan(title, lines, page, form="Seite {}"):
    return f"{title}\r\n" + "\r\n".join(lines) + "\r\n" + form.format(page)


def chunks():
    meta = lambda page, path=None: (None, None, page, path, None, None)
    words = "the departmental committee reviewed a cross-border programme of measures before the summer"
    body = [words[:54].rstrip(), words[54:].lstrip() + " closure and", "afterwards the committee agreed on every single point of", "the programme of many measures, and in the end the depart-", "mental committee reviewed the whole of what had come of it", "at length and at leisure."]
    rows = [(i, "R/native.docx", i, " ".join(body).replace("depart- mental", "departmental") + " 12 pages.", meta(1)) for i in range(30)]
    for p in range(1, 6):
        rows.append((100 + p, "R/scan.pdf", p, scan("Acme Annual Review", body, p), meta(p)))
    rows.append((106, "R/scan.pdf", 6, "\n".join(["Findings", *body[:3], "the comrnittee reviewed a cross-", "border programme of some length, and then it took up the de-", "partmental measures at leisure."]), meta(6, "Findings")))
    rows.append((200, "R/native.pdf", 0, "Findings\n" + words + ". " + words + ".\n\n40\n25\n21", meta(1, "Findings")))
    rows += [(300, "R/scan.pdf", 7, None, meta(7)), (301, "R/scan.pdf", 8, "", meta(8)), (302, None, 0, "text", meta(1)), (303, "R/other.pdf", 0, "z " * 50_000, None)]
    return rows


META = "struct<slide:int,slides:array<int>,page:int,heading_path:string,has_table:boolean,has_image:boolean>"


def test_scans(spark):
    df = spark.createDataFrame(chunks(), f"chunk_id long, doc_key string, chunk_index int, text string, meta {META}").selectExpr("*", "1 as line", "2 as page")
    got = {r["chunk_id"]: r for r in clean_scans(df).collect()}
    assert set(got) == {101, 102, 103, 104, 105, 106}
    for i in range(101, 106):
        assert got[i]["noise"] == ["header", "hyphen", "page_number"]
        assert "departmental committee" in got[i]["text"] and "Seite" not in got[i]["text"] and "Acme" not in got[i]["text"]
    assert got[106]["noise"] == ["character", "hyphen"]
    assert "the committee reviewed a cross-border programme of some length, and then it took up the departmental measures" in got[106]["text"]
    assert clean_scans(df.limit(0)).count() == 0


def test_scans_with_joined_lookups(spark, monkeypatch):
    """Tables of words too large to be sent give the same, also for a word whose two parts and whole are misread or hyphened."""
    more = "and then they spoke of a cross-\nb0rder programme once more with the cornmittee and the de-\npartrnental board of it\nat length and at leisure on this day of the new year"
    df = spark.createDataFrame([*chunks(), (107, "R/scan.pdf", 9, more, None)], f"chunk_id long, doc_key string, chunk_index int, text string, meta {META}")
    want = {r["chunk_id"]: (r["noise"], r["text"]) for r in clean_scans(df).collect()}
    monkeypatch.setattr("corpusmill.llm.scans.MAX_SENT", 0)
    assert {r["chunk_id"]: (r["noise"], r["text"]) for r in clean_scans(df).collect()} == want
