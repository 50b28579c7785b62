"""Rows of a sorted partition by groups, as they come in batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd


def groups(batches: Iterable[pd.DataFrame], key: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """The rows of each key of a partition sorted by ``key``, across batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.iloc[a:b]
            if held and held[0][key].iat[0] != keys[a]:
                yield held[0][key].iat[0], held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield held[0][key].iat[0], held[0] if len(held) == 1 else pd.concat(held)


def runs(batches: Iterable[pd.DataFrame], key: str, columns: list[str]) -> Iterator[tuple[object, list[list]]]:
    """Like ``groups``, with the named columns of each key as lists; for many small groups."""
    now, held = None, None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        lists = [batch[c].tolist() for c in columns]
        a = 0
        for b in [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]:
            if held is not None and keys[a] == now:
                for old, new in zip(held, lists):
                    old += new[a:b]
            else:
                if held is not None:
                    yield now, held
                now, held = keys[a], [x[a:b] for x in lists]
            a = b
    if held is not None:
        yield now, held
