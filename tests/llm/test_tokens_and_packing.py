import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.packing import best_fit, fill_report, pack
from corpusmill.llm.splitting import max_words, min_words, split_oversized, split_text, tokens
from corpusmill.llm.tokenizer import DEFAULT_FILE, PATTERN, Encoder, Transducer, Utf8Stream, decode_column, encode_column, load_ranks

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    try:
        return load_ranks()
    except OSError:
        pytest.skip(f"{DEFAULT_FILE} isn't here")


@pytest.fixture(scope="module")
def both(ranks):
    return Encoder(ranks), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab  \n\t'sd19,.é漢🎉\xa0 \x1c\x85<|endoftext|>", max_size=60))
def test_same_ids(both, text):
    mine, theirs = both
    text = text.encode("utf-8", "ignore").decode()
    assert mine.encode(text) == theirs.encode_ordinary(text)


def test_long_and_odd(both):
    mine, theirs = both
    for text in ("a" * 20_000, " " * 5_000 + "x", "\n" * 999, "😀" * 2_000, "<|endoftext|>", "don't we'll I'D  x"):
        assert mine.encode(text) == theirs.encode_ordinary(text)


def test_lookahead_is_in_the_states(ranks):
    fst = Transducer(ranks)
    word = b" internationalisation"
    assert fst.encode(word) == fst.merge(word)
    n = len(fst.items)
    fst.encode(word)
    assert len(fst.items) == n  # states are made once


def test_ids_come_before_the_text_ends(ranks, monkeypatch):
    """After LOOKAHEAD bytes and the longest entry, ids are out while the text goes on."""
    monkeypatch.setattr("corpusmill.llm.tokenizer.LOOKAHEAD", 32)
    fst = Transducer(ranks)
    theirs = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    longest = max(map(len, ranks))
    rnd = random.Random(2)
    for text in (b"internationalisation" * 60, bytes(rnd.choice(b"abcdeilnorst") for _ in range(3000)), "漢字かな".encode() * 200, b"a" * 2000):
        fed, out = 0, []

        def source():
            nonlocal fed
            for b in text:
                fed += 1
                assert fed - sum(len(fst.bytes_of[i]) for i in out) <= 2 * longest + 64
                yield b

        for i in fst.stream(source()):
            out.append(i)
        assert out == theirs.encode_ordinary(text.decode())


def test_caches_start_anew(ranks, monkeypatch):
    for name in ("KEPT_PIECES", "KEPT_STATES", "KEPT_PAIRS"):
        monkeypatch.setattr(f"corpusmill.llm.tokenizer.{name}", 5)
    mine, theirs = Encoder(ranks), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("the quick brown fox jumps over the lazy dog", "un mot après l'autre, et encore un autre", "ein Wort nach dem anderen " * 5):
        assert mine.encode(text) == theirs.encode_ordinary(text)
        assert len(mine.pieces) <= 5


def test_frames(spark, both):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "é漢", "x"), (4, "é漢", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode_column(df, "doc_id", "text").collect())
    assert got == sorted((i, both[1].encode_ordinary(t or "")) for i, t, _ in df.collect())
    back = decode_column(encode_column(df, "doc_id", "text"), "doc_id", "ids").collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == [(1, "hello world"), (2, ""), (3, ""), (4, "é漢"), (4, "é漢")]
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_utf8_in_parts():
    s = Utf8Stream()
    assert [s.feed(bytes([b])) for b in "é".encode()] == ["", "é"]
    assert s.feed(b"\xe6", True) == "�"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_containers_hold_what_they_may(sizes):
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    at = best_fit(sizes, 100, 5, 0.6)
    for c in set(at):
        mine = sizes[at == c]
        assert mine.sum() <= 100 and len(mine) <= 5 and (((mine / 100) ** 2).sum() <= 0.6 + 1e-6 or len(mine) == 1)


@pytest.mark.parametrize("sizes, max_items, max_cost, want", [([60, 50], 9, 9, 2), ([10, 10, 10], 2, 9, 2), ([70, 20], 9, 0.5, 2), ([70, 20], 9, 0.53, 1), ([90], 9, 0.5, 1)])
def test_each_capacity_decides(sizes, max_items, max_cost, want):
    """Tokens, documents and attention cost each open a second container where the other two would not."""
    assert len(set(best_fit(np.array(sizes), 100, max_items, max_cost))) == want


def test_pack(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(1, 60)) for i in range(900)] + [(1000, 250), (1001, 0), (1002, None), (1003, 100), (1004, 300)]
    df = spark.createDataFrame(rows, "doc_id long, n int")
    got = pack(df, "doc_id", "n", 100, block_items=300).collect()
    assert sum(r["size"] for r in got) == sum(n or 0 for _, n in rows)
    load = {}
    for r in got:
        load.setdefault(r["container"], []).append(r["size"])
    assert all(sum(v) <= 100 for v in load.values())
    split = {r["doc_id"] for r in got if r["piece"] > 0}
    assert split == {1000, 1004}
    full = [sum(v) for k, v in load.items() if k]
    assert sum(full) / (100 * len(full)) > 0.95
    assert {r["doc_id"] for r in got if r["container"] == ""} == {1001, 1002}
    one = fill_report(spark.createDataFrame(got), 100).first()
    assert one["n_tokens"] == sum(full) and one["n_containers"] == len(full) and one["most_tokens"] == max(full) and one["fill"] == round(sum(full) / (100 * len(full)), 6)
    assert pack(df.limit(0), "doc_id", "n", 100).count() == 0 and fill_report(spark.createDataFrame(got).limit(0), 100).first()["n_containers"] == 0


def test_limits():
    assert max_words(1000) == 750 and tokens(751) > 1000
    assert tokens(min_words(150)) >= 150 > tokens(min_words(150) - 1)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["word", "End.", "Next", "\n", "\n\n", "\r\n", "# Title\n", "| a | b |\n", "- item\n", " ", "x" * 40]), max_size=400))
def test_pieces(parts):
    text = " ".join(parts)
    pieces = split_text(text, limit=40, overlap=8, max_chars=500)
    rebuilt = ""
    for i, (piece, shared, chars) in enumerate(pieces):
        assert len(piece.split()) <= max_words(40) or len(pieces) == 1
        lead = piece[:chars]
        assert shared == len(lead.split()) and rebuilt.endswith(lead)
        assert shared == (min_words(8) if i and len(rebuilt.split()) >= min_words(8) else shared)
        rebuilt += piece[chars:]
    assert rebuilt == text


def test_natural_cuts():
    text = "# One\n" + "alpha beta. " * 20 + "\n\n# Two\n" + "gamma delta. " * 20
    pieces = split_text(text, limit=64, overlap=0)
    assert [p.split()[1] for p, *_ in pieces] == ["One", "Two"]


def test_split_frame(spark):
    meta = "struct<page:int,slides:array<int>>"
    rows = [(1, "w " * 2000, (3, [1, 2]), 0), (2, "w " * 750, (1, None), 0), (3, None, None, 0), (4, "", None, 0), (5, "y" * 5000, None, 0), (6, "a b\xa0" * 400, None, 1)]
    df = spark.createDataFrame(rows, f"chunk_id long, text string, meta {meta}, piece int")
    got = split_oversized(df).collect()
    assert {r["chunk_id"] for r in got} == {1, 6}
    one = sorted((r for r in got if r["chunk_id"] == 1), key=lambda r: r["piece"])
    assert all(r["tokens"] <= 1000 and r["meta"]["slides"] == [1, 2] and r["n_pieces"] == len(one) for r in one)
    assert [r["overlap_words"] for r in one] == [0] + [113] * (len(one) - 1)
    assert split_oversized(df.limit(0)).count() == 0
