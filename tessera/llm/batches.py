"""Groups of rows out of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key in one partition, next to each other."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of each run of equal keys; a run may reach over several batches."""
    rest: list[dict[str, np.ndarray]] = []
    for frame in frames:
        if not len(frame):
            continue
        cols = {c: frame[c].to_numpy() for c in frame.columns}
        new = np.zeros(len(frame), bool)
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        new[0] = bool(rest) and any(rest[-1][k][-1] != cols[k][0] for k in keys)
        cuts = [0, *np.flatnonzero(new), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            if new[a] and rest:
                yield _joined(rest)
                rest = []
            if b > a:
                rest.append({c: v[a:b] for c, v in cols.items()})
    if rest:
        yield _joined(rest)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
