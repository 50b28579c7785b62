import random
import time
from difflib import SequenceMatcher

import numpy as np
import pytest

from corpusmill.operators import resemblance as X
from corpusmill.operators import retrieval as R


def like(a, b):
    first = a.split(" ", 1)[0]
    return len(first) > 3 and first == b.split(" ", 1)[0] or SequenceMatcher(None, a, b).ratio() >= 0.6


def expected(queries, rows):
    return {(q, p) for q, a in queries for p, b in rows if q != p and (like(a, b) if q < p else like(b, a))}


@pytest.mark.parametrize("letters", ["ab", "abc ", "aeioubcdfgklmn ", "中文é字ab ", "a\U0001f600b"])
@pytest.mark.parametrize("longest", [6, 25, 64, 90, 230])
def test_pairs_are_those_of_difflib(monkeypatch, letters, longest):
    """Ties among matches, both directions, letters counted in sets or not to the end, texts beyond a word of bits or with junk."""
    rnd = random.Random(longest)
    if rnd.random() < 0.5:
        monkeypatch.setattr(X, "LETTERS", 2)
        monkeypatch.setattr(X, "OFTEN", 3)
    monkeypatch.setattr(X, "ASKED", 8)
    monkeypatch.setattr(X, "PAIRS", 128)
    monkeypatch.setattr(X, "MATCHED", 7)
    rows = []
    for i in range(60 if longest < 200 else 24):
        for _ in range(rnd.choice([1, 1, 2])):
            text = [rnd.choice(letters) for _ in range(rnd.randrange(longest))]
            if rows and rnd.random() < 0.5:
                text = list(rnd.choice(rows)[1])
                for _ in range(len(text) // 3):
                    text[rnd.randrange(len(text))] = rnd.choice(letters)
                half = rnd.randrange(len(text) + 1)
                text = text[half:] + text[:half]
            rows.append((i * 7 % 60, "".join(text)))
    queries = [(p, t) for p, t in rows if p % 4 == 0]
    got = [pair for found in X.similar_pages(*columns(queries), *columns(rows)) for pair in zip(*(x.tolist() for x in found))]
    assert len(got) == len(set(got)) and set(got) == expected(queries, rows)


def columns(rows):
    return np.array([p for p, _ in rows]), [t for _, t in rows]


def test_similar_names_of_many_pages(spark):
    """7.5 million pairs of names; one by one, those with enough letters in common took over a minute."""
    rnd = random.Random(3)
    part = lambda n: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(n))
    kinds = ["textiles group", "pharma services", "energy company", "paper partners", "media holdings"]
    rows = [(i, f"{part(4)} {rnd.choice(kinds)}" if i % 2 else f"{part(3)} {part(4)}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "page_id long, name string")
    began = time.monotonic()
    got = R.similar_names(df.where("page_id < 250"), df).toPandas()
    assert time.monotonic() - began < 30
    part = got[(got["query_id"] < 2) & (got["page_id"] < 3_000)]
    assert set(part.itertuples(index=False, name=None)) == expected(rows[:2], rows[:3_000])
