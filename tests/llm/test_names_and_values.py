import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.canonical import Reference, map_pages, map_values, split_aliases
from corpusmill.llm.graph import components
from pyspark.sql import functions as F

from corpusmill.llm.names import bound, entity_pairs, entry_shards, joined_words, link_names, parse, query_shards, resolve, spellings, trie_join, whole_shards
from corpusmill.llm.tries import Trie, within


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=7), max_size=12), st.text("abc", max_size=7), st.integers(0, 2))
def test_automaton(words, query, k):
    trie = Trie()
    for w in words:
        trie.add(w, w)
    assert sorted(trie.near(query, k)) == sorted((w, osa(query, w)) for w in words if osa(query, w) <= k)


def spoil(w, rnd):
    i = rnd.randrange(len(w) - 1)
    return rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abcdef") + w[i:], w[:i] + rnd.choice("abcdef") + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])


def test_shards_meet(spark):
    """Every pair within the bound shares a shard."""
    rnd = random.Random(4)
    pairs = []
    for _ in range(4000):
        w = "".join(rnd.choice("abcdef") for _ in range(rnd.randrange(5, 15)))
        v = spoil(w, rnd)
        if len(w) >= 11 and rnd.random() < 0.6:
            v = spoil(v, rnd)
        assert within(v, w, bound(len(w))) == (osa(v, w) <= bound(len(w)))
        if len(v) >= 4 and osa(v, w) <= bound(len(w)):
            pairs.append((v, w, osa(v, w)))
    df = spark.createDataFrame(pairs, "v string, w string, far int")
    v, w = F.col("v"), F.col("w")
    one = df.where("far <= 1")
    assert one.count() > 2000 and one.where(~F.arrays_overlap(whole_shards(v), whole_shards(w))).collect() == []
    two = df.where("length(w) >= 11")
    assert two.where("far = 2").count() > 300 and two.where(~F.arrays_overlap(query_shards(v), entry_shards(w))).collect() == []


def against_all_pairs(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for k in (1, 2):
        found = trie_join(df, df, k).collect()
        want = {(q, e): osa(q, e) for q in words for e in words if q != e and len(q) >= 4 and len(e) >= (5, 11)[k - 1] and osa(q, e) <= min(k, bound(len(e)))}
        assert {(r["query"], r["entry"]): r["distance"] for r in found} == want and len(found) == len(want)


def test_join_against_all_pairs(spark):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcdef") for _ in range(rnd.randrange(3, 14))) for _ in range(60)]
    against_all_pairs(spark, sorted({*base, *(spoil(w, rnd) for w in base for _ in range(2)), *(spoil(spoil(w, rnd), rnd) for w in base)}))


def test_join_in_blocks(spark, monkeypatch):
    """A shard with much work is cut into blocks that all meet."""
    monkeypatch.setattr("corpusmill.llm.names.BLOCK_WORDS", 3)
    against_all_pairs(spark, ["abcde", *(f"abcd{c}" for c in "fghijk"), *(f"{c}abcdefabcde" for c in "uvwxyz"), "abcdefabcde", "bcde"])


def test_parse():
    assert parse("Basequaex, Larry") == ["basequaex", "lawrence"]
    assert parse("Dr. Gabi S. Stiprozuov, PhD") == ["gabriele", "s", "stiprozuov"]
    assert parse("Krufletroap Textiles Ltd") == ["krufletroap", "textiles", "limited"]
    assert parse("Gequokloeg Steel & Co") == ["gequokloeg", "steel"]
    assert parse("EleanorPrizikriurs (person)") == ["eleanor", "prizikriurs"]
    assert parse("Kikribreand Optics Int'l") == ["kikribreand", "optics", "international"]
    assert parse("T. H. Mikrepriis") == ["t", "mikrepriis"]


def test_resolve():
    to = resolve([("foods", "group"), ("foods",), ("insurance", "group"), ("group",), ("f", "grp")])
    assert to[("foods",)] == ("foods", "group") == to[("f", "grp")]
    assert to[("group",)] == ("group",)  # two firms have one
    assert resolve([("walter",), ("waler",)])[("waler",)] == ("walter",)
    assert resolve([("media", "corporation"), ("mdia", "corp")])[("mdia", "corp")] == ("media", "corporation")


PAGES = [
    (1, "Walter Bikozoorg", None), (2, "walt bikozootg", []), (3, "Walt B.", ["Walt Bikozoorg", ""]), (4, "Henry Bikozoorg", [None]), (5, "W. Bikozoorg", None),
    (6, "Takekraak Foods Group", None), (7, "GROUP TAKKERAAK FOODS", None), (8, "Takekraak Insurance Associates", None), (9, "Takekraak Foods", None), (10, None, None), (11, " ", []),
    (12, "TFG", ["Takekraak Foods Grp."]), (13, "TFG", None), (6, "Takekraak Foods Group", None), (14, "Henry Stiprozuov", None), (15, "Josef Stiprozuov", None), (16, "walterbikozoorg", None),
    (17, "Walter Bikozoorg", None), (18, "Walter Drobopriith", None), (19, "Walter Gekrelaog", None),
]


def test_entities(spark):
    df = spark.createDataFrame(PAGES, "page long, title string, aliases array<string>")
    linked = link_names(df).collect()
    assert len(linked) == 19
    groups = {}
    for r in linked:
        groups.setdefault(r["entity"], set()).add(r["page"])
    assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == [[1, 2, 3, 5, 16, 17], [6, 7, 9, 12]]
    pairs = {(r["page_a"], r["page_b"]) for r in entity_pairs(link_names(df)).collect()}
    assert (6, 12) in pairs and (9, 12) in pairs and all(a < b for a, b in pairs) and len(pairs) == 15 + 6


def test_short_names(spark):
    """Names without a word of five letters are linked in any order of words; codes alone, and short names with an initial, aren't."""
    names = ["Li Wei", "Wei, Li", "John Kim", "Kim, John", "Ana Ruiz", "ruiz ana", "Robert Henry", "Henry, Bob", "Max Koch", "Eva Roth", "TFG", "TFG", "Rick S.", "Rick S.", "K.F.C.", "Fred S.", "Fred S.", "Alex G.", "Alex G."]
    linked = link_names(spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "page long, title string, aliases array<string>")).collect()
    groups = {}
    for r in linked:
        groups.setdefault(r["entity"], []).append(r["page"])
    assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == [[0, 1], [2, 3], [4, 5], [6, 7]]


def test_chains_of_spellings(spark):
    """A misspelling of a misspelling, six steps long, stands for the word at the end."""
    chain = ["abcdefgh", "abcdefgi", "abcdefji", "abcdkfji", "abcmkfji", "abnmkfji", "aonmkfji"]
    df = spark.createDataFrame([(w, 400 * 5**-i + 1e-9) for i, w in enumerate(chain)], "word string, x double").selectExpr("word", "cast(ceil(x) as long) as n")
    assert {r["canon"] for r in spellings(df).collect()} == {"abcdefgh"}


def test_words_run_together(spark):
    rows = [("bikozoorg", 5), ("walter", 50), ("walterbikozoorg", 2), ("health", 900), ("care", 800), ("healthcare", 90), ("inter", 2), ("national", 90), ("international", 80)]
    assert {r["word"]: r["parts"] for r in joined_words(spark.createDataFrame(rows, "word string, n long")).collect()} == {"walterbikozoorg": ["walter", "bikozoorg"], "healthcare": ["health", "care"]}


def test_no_pages(spark):
    assert link_names(spark.createDataFrame([], "page long, title string, aliases array<string>")).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)] + [(1, 1), (None, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


VOCAB = [
    ("tag", "cold-chain", "covers refrigerated transport"), ("tag", "sales", None), ("tag", "contract", None), ("tag", "operations", None), ("tag", "purchasing", None),
    ("tag", "sensor-device", "covers probe and meter"), ("tag", "people-and-culture", "covers contact"), ("domain", "sales", None),
]


def test_values():
    ref = Reference([(v, split_aliases(d)) for f, v, d in VOCAB if f == "tag"])
    good = {
        "Cold Chain": "cold-chain", "chain, cold": "cold-chain", "chain of cold": "cold-chain", "COLDCHAIN": "cold-chain", "ColdChain": "cold-chain", "cold-chaon": "cold-chain",
        "refrigerated-transport": "cold-chain", "#cold_chain": "cold-chain", "tag:cold-chain": "cold-chain", "cold chain (main)": "cold-chain", "сold-chain": "cold-chain",
        "salws": "sales", "purhaing": "purchasing", "opera.": "operations", "sens. device": "sensor-device", "senso rdevie": "sensor-device", "CONTACT": "people-and-culture", "culture and people": "people-and-culture", "conract": "contract", "operat": "operations", "Probe": "sensor-device",
    }
    assert {raw: ref.best(raw, "tag") for raw in good} == good
    for raw in ("opera", "saline", "coaching", "???", "-", "x" * 5000):
        assert ref.best(raw, "tag") == ""
    assert ref.all_near("operaions") == [("operations", (1, False))]


def test_any_order_of_any_number_of_words():
    ref = Reference([("supply-chain-risk", ["global supply chain risk management"]), ("proof", ["proof of value"]), ("law", ["act of parliament"])])
    for raw in ("chain supply rsk management global", "supply global chain rsk management", "management risk chain supply global", "riskk managment global chain supply"):
        assert ref.best(raw, "tag") == "supply-chain-risk"
    assert ref.best("value proof", "tag") == "proof" and ref.best("parliament act", "tag") == "law" and ref.best("parl. act", "tag") == ""
    assert ref.best("act of parl.", "tag") == "law"
    assert ref.best(" ".join(f"w{i}" for i in range(40)), "tag") == ""


def test_lists_of_any_length(spark, monkeypatch):
    """A list too long to be sent gives what a short one gives."""
    vocab = spark.createDataFrame([*VOCAB, ("tag", "sale", None)], "field string, value string, description string")
    raws = ["Cold Chain", "chain, cold", "salws", "purhaing", "opera.", "operat", "Probe", "opera", "x", "sales", "probes", "SALE", "sals", "contract (main)"]
    df = spark.createDataFrame([(f, r) for r in raws for f in ("tag", "domain", "nofield")], "field string, raw_value string")
    want = sorted(map(tuple, map_values(df, vocab).collect()))
    monkeypatch.setattr("corpusmill.llm.canonical.SENT_ENTRIES", 2)
    assert sorted(map(tuple, map_values(df, vocab).collect())) == want and len({c for *_, c in want}) > 5


def test_map(spark):
    vocab = spark.createDataFrame(VOCAB, "field string, value string, description string")
    rows = [("tag", "Sales"), ("tag", "sales"), ("tag", None), ("tag", " "), ("tag", " sales"), ("nofield", "sales"), ("domain", "contract"), ("tag", "Sales")]
    got = {(r["field"], r["raw_value"], r["canonical"]) for r in map_values(spark.createDataFrame(rows, "field string, raw_value string"), vocab).collect()}
    assert got == {("tag", "Sales", "sales"), ("tag", " sales", "sales"), ("nofield", "sales", ""), ("domain", "contract", "")}
    pages = spark.createDataFrame([(1, "probe", None, ["Sales", "Sales", None]), (2, None, "SALES", None), (1, "probe", None, ["Sales", "Sales", None])], "page_id long, entity_type string, domain string, tags array<string>")
    got = sorted((r["page_id"], r["field"], r["raw_value"], r["canonical"]) for r in map_pages(pages, vocab).collect())
    assert got == [(1, "entity_type", "probe", ""), (1, "tag", "Sales", "sales"), (2, "domain", "SALES", "sales")]
    assert map_values(spark.createDataFrame([], "field string, raw_value string"), vocab).count() == 0
