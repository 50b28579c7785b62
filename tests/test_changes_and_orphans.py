from datetime import datetime, timedelta, timezone

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import numpy as np

from corpusmill.operators.changes import apply_changes, balances, current_files, identifiers, latest_of, merge_changes, read_changes
from corpusmill.operators.orphans import BITS, orphan_references, orphan_report, packed, page_orphans, slug_of, unpacked
from pyspark.sql import functions as F

EVENT = "seq long, path string, event string, hash string, previous_hash string, timestamp string"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(days, micro=0):
    return (T0 + timedelta(days=days, microseconds=micro)).isoformat()


def files(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENT)
    return {r["path"]: r["hash"] for r in current_files(df).collect()}


def test_order_is_that_of_instants(spark):
    rows = [
        ("a", "updated", "h1", "h0", at(2)),
        ("a", "ingested", "h0", None, at(1)),
        ("b", "INGESTED ", "x", None, at(1)),
        ("b", " Deleted", "x", None, at(3)),
        ("c", "ingested", "y", None, at(1)),
        ("c", "deleted", "y", None, at(2)),
        ("c", "ingested", "y", None, at(3)),
    ]
    assert files(spark, rows) == {"a": "h1", "c": "y"}


def test_offsets_count(spark):
    rows = [("a", "ingested", "h0", None, "2024-01-01T12:00:00+02:00"), ("a", "updated", "h1", None, "2024-01-01T10:30:00Z"), ("a", "updated", "h2", None, "2024-01-01 09:59:00")]
    assert files(spark, rows) == {"a": "h1"}


def test_content_decides_where_instants_tie_are_missing_or_contradict(spark):
    rows = [
        ("tie", "updated", "t1", "t0", at(1)),
        ("tie", "ingested", "t0", None, at(1)),
        ("none", "ingested", "n0", None, at(1)),
        ("none", "updated", "n1", "n0", None),
        ("against", "updated", "g1", "g0", at(1)),
        ("against", "ingested", "g0", None, at(2)),
        ("gone", "deleted", "d0", None, at(1)),
        ("gone", "ingested", "d0", None, at(2)),
        ("gone2", "ingested", "e0", None, at(1)),
        ("gone2", "deleted", "e0", None, None),
    ]
    assert files(spark, rows) == {"tie": "t1", "none": "n1", "against": "g1"}


def test_repeats_change_nothing(spark):
    rows = [("a", "ingested", "h0", None, at(1, 5)), ("a", "updated", "h1", "h0", at(2, 7)), ("a", "ingested", "h0", None, at(1, 5)), ("a", "updated", "h1", "h0", at(2))]
    assert files(spark, rows * 3) == {"a": "h1"}


def test_missing_changes(spark):
    """An update that never arrived leaves two contents that nothing replaced; the later one counts."""
    assert files(spark, [("a", "ingested", "h0", None, at(1)), ("a", "updated", "h2", "h1", at(3))]) == {"a": "h2"}
    assert files(spark, [("a", "ingested", "h0", None, at(1)), ("a", "deleted", "h1", None, at(3))]) == {}


def test_nulls_blanks_and_nothing(spark):
    assert files(spark, []) == {}
    rows = [(None, "ingested", "h", None, at(1)), ("a", None, "h", None, at(1)), ("b", "ingested", None, None, at(1)), ("c", "ingested", " ", None, "no time"), ("d", "moved", "h", None, at(1))]
    assert files(spark, rows) == {"b": "", "c": ""}


def test_base_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, "a", "updated", "h1", "h0", at(1), 9, "x"), (1, "b", "deleted", "k", None, at(1), 9, "y"), (2, "n", "ingested", "m", None, at(2), 4, "new")], EVENT + ", key int, rank string")
    base = spark.createDataFrame([("a", "h0", 1, "old", "own"), ("b", "k", 1, "old", "own"), ("c", "z", 1, "old", "own")], "key string, content string, k int, rank string, other string")
    out = apply_changes(base, read_changes(df, ("rank",)))
    assert out.columns == base.columns
    assert sorted(map(tuple, out.collect())) == [("a", "h1", 1, "x", "own"), ("c", "z", 1, "old", "own"), ("n", "m", None, "new", None)]
    assert sorted(apply_changes(base, read_changes(df.limit(0), ("rank",))).collect()) == sorted(base.collect())
    assert [r["key"] for r in apply_changes(base.limit(0), read_changes(df)).orderBy("key").collect()] == ["a", "n"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.randoms(use_true_random=False))
def test_merging_in_parts_is_applying_at_once(spark, rnd):
    """Whatever part of a feed a base is made of, with repeats and late changes in the rest."""
    rows = []
    for k in range(6):
        content = None
        for i in range(rnd.randrange(1, 7)):
            kind = "ingested" if content is None else rnd.choice(["updated", "updated", "deleted"])
            new = f"h{k}.{rnd.randrange(3)}"
            when = rnd.choice([at(i), at(i, 7), None])
            rows.append((f"p{k}", kind, content if kind == "deleted" else new, content if kind == "updated" else None, when))
            content = None if kind == "deleted" else new
    rows += rnd.sample(rows, len(rows) // 3)
    rnd.shuffle(rows)
    cut = rnd.randrange(len(rows) + 1)
    first, rest = (read_changes(spark.createDataFrame([(i, *r) for i, r in enumerate(part)], EVENT)) for part in (rows[:cut], rows[cut:]))
    seen, merged = merge_changes(identifiers(first).select("id"), balances(first), rest)
    got = {r["key"]: r["content"] for r in latest_of(merged).where("kind <> 'deleted'").collect()}
    assert got == files(spark, rows)
    assert seen.count() == identifiers(read_changes(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENT))).select("id").distinct().count()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.randoms(use_true_random=False))
def test_any_history_in_any_order(spark, kinds, rnd):
    """A history written down by a simple machine comes out as it ended, whatever order and repeats it arrives in."""
    state, rows, n = {}, [], 0
    for i, k in enumerate(kinds):
        path = f"p{k % 2}"
        n += 1
        if path not in state:
            state[path] = f"h{n}"
            rows.append((path, "ingested", f"h{n}", None, at(i)))
        elif k >= 2 and n % 3:
            rows.append((path, "updated", f"h{n}", state[path], at(i)))
            state[path] = f"h{n}"
        else:
            rows.append((path, "deleted", state.pop(path), None, at(i)))
    shuffled = rows + rnd.sample(rows, len(rows) // 2)
    rnd.shuffle(shuffled)
    assert files(spark, shuffled) == state


def test_hot_key(spark):
    """One path with most of the rows, two contents that take turns."""
    rows = [("hot", "ingested", "a", None, at(0))]
    for i in range(1, 400):
        rows.append(("hot", "updated", "ab"[i % 2], "ab"[(i + 1) % 2], at(i)))
    assert files(spark, rows + [("cold", "ingested", "z", None, at(1))]) == {"hot": "b", "cold": "z"}


REF, PAR = "owner long, domain string, target string, at long", "domain string, target string, alive boolean, born long"
DAY = 86_400_000_000


def test_states(spark):
    refs = [(1, "s", "here", 100 * DAY), (1, "s", "gone", 100 * DAY), (2, "s", "dead", 100 * DAY), (3, "s", "young", 100 * DAY), (4, "s", "young", None), (5, "s", None, 1), (5, "s", "", 1), (6, "r", "here", DAY), (1, "s", "gone", 100 * DAY)]
    parents = [("s", "here", True, 90 * DAY), ("s", "dead", False, 5 * DAY), ("s", "young", True, 101 * DAY), ("s", "young", False, 105 * DAY), ("s", "here", False, 200 * DAY)]
    out = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR))
    got = sorted((r["owner"], r["domain"], r["target"], r["state"]) for r in out.collect())
    assert got == [(1, "s", "gone", "missing"), (2, "s", "dead", "deleted"), (3, "s", "young", "late"), (6, "r", "here", "missing")]
    assert {(r["table_name"], r["state"], r["n_references"]) for r in orphan_report(out).collect()} >= {("s", "missing", 1), ("r", "missing", 1)}


def test_no_rows(spark):
    empty = orphan_references(spark.createDataFrame([], REF), spark.createDataFrame([], PAR))
    assert empty.count() == 0
    only = orphan_references(spark.createDataFrame([(1, "s", "x", 1)], REF), spark.createDataFrame([], PAR))
    assert [r["state"] for r in only.collect()] == ["missing"]


def test_against_sets(spark):
    """Many keys over several ranges of the dictionary against plain sets."""
    refs = [(i % 50, "s", f"k{i * 7 % 3000}", (i % 90) * DAY) for i in range(4000)]
    parents = [("s", f"k{i}", i % 3 > 0, (i % 80) * DAY) for i in range(0, 3000, 2)]
    out = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR))
    got = {(r["owner"], r["target"], r["at"], r["state"]) for r in out.collect()}
    by = {t: (alive, born) for _, t, alive, born in parents}
    want = set()
    for owner, _, t, when in refs:
        if t not in by:
            want.add((owner, t, when, "missing"))
        elif not by[t][0]:
            want.add((owner, t, when, "deleted"))
        elif when < by[t][1]:
            want.add((owner, t, when, "late"))
    assert got == want


def test_slugs(spark):
    rows = [("[[Abc-D]]",), ("abc-d.md",), (" [[abc-d|Name]] ",), ("[[abc-d#top]]",), ("[[abc-d.MD]]",), ("",), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, "l string").select(slug_of(F.col("l"))).collect()]
    assert out == ["abc-d"] * 5 + ["", None]


def test_pages(spark):
    page = "page_id long, slug string, created_at string, updated_at string, sources array<string>, relations array<map<string,string>>, title string"
    pages = [
        (1, "one", "2024-01-01", "2024-02-01", ["Root/A.pdf ", "root/b.pdf", None, " "], [{"serves": "[[Two]]"}, {"serves": "[[none]]"}], "x"),
        (2, "two", "2024-03-01", None, None, None, None),
        (1, "one", "2024-01-01", "2024-02-01", ["Root/A.pdf ", "root/b.pdf", None, " "], [{"serves": "[[Two]]"}, {"serves": "[[none]]"}], "x"),
    ]
    events = [(1, "Root/a.pdf", "ingested", "h", None, "2024-01-05T00:00:00Z"), (2, "Root/a.pdf", "deleted", "h", None, "2024-01-06T00:00:00Z")]
    out = page_orphans(spark.createDataFrame(pages, page), spark.createDataFrame(events, EVENT))
    assert sorted((r["owner"], r["domain"], r["target"], r["state"]) for r in out.collect()) == [
        (1, "relations", "none", "missing"), (1, "relations", "two", "late"), (1, "sources", "root/a.pdf", "deleted"), (1, "sources", "root/b.pdf", "missing"),
    ]


def test_containers():
    """Each kind of container gives back its positions and is the smallest of the three."""
    rnd = np.random.default_rng(1)
    cases = {"a": np.sort(rnd.choice(BITS, 900, replace=False)), "r": np.arange(5, 30_000), "b": np.sort(rnd.choice(BITS, 20_000, replace=False))}
    for kind, positions in cases.items():
        raw = packed(positions)
        assert raw[:1].decode() == kind and len(raw) <= BITS // 8 + 1
        assert np.flatnonzero(unpacked(raw)).tolist() == positions.tolist()
    for positions in ([], [0], [BITS - 1], [0, BITS - 1], list(range(BITS))):
        assert np.flatnonzero(unpacked(packed(np.array(positions, dtype=np.int64)))).tolist() == positions
