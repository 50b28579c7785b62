import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.functions.frames import groups, runs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("aabbbc"), max_size=12), st.lists(st.integers(0, 12), max_size=3))
def test_groups_and_runs_across_batches(keys, cuts):
    df = pd.DataFrame({"k": sorted(keys), "v": range(len(keys))})
    at = [0, *sorted(min(c, len(df)) for c in cuts), len(df)]
    batches = [df.iloc[a:b] for a, b in zip(at, at[1:])]
    want = [(k, g["v"].tolist()) for k, g in df.groupby("k")]
    assert [(k, g["v"].tolist()) for k, g in groups(batches, "k")] == want == [(k, v) for k, (v,) in runs(batches, "k", ["v"])]
