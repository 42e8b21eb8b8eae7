"""Seeded clustering of the days of each window, one group of at most 42 days at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .windows import FEATURES, KEY

ROUNDS, RESTARTS, TRIALS = 35, 10, 7
# Least silhouette, gain over one cluster fewer, stability, by number of clusters.
ACCEPT = {2: (0.28, 0.18, 0.72), 3: (0.30, 0.15, 0.75), 4: (0.32, 0.12, 0.78)}
_M32 = 0xFFFFFFFF


def seed_of(dates: list[str], salt: int) -> int:
    """The 32-bit FNV hash of dates (exclusive or, then multiply), its offset mixed with a salt."""
    h = 2166136261 ^ (salt & _M32)
    for c in "".join(dates).encode():
        h = ((h ^ c) * 16777619) & _M32
    return h


class Uniforms:
    """The public mulberry32 generator."""

    def __init__(self, seed: int):
        self.state = seed & _M32

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & _M32
        t = self.state
        t = ((t ^ (t >> 15)) * (t | 1)) & _M32
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & _M32)) & _M32
        return ((t ^ (t >> 14)) & _M32) / 4294967296


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return ((x[:, None] - centres) ** 2).sum(axis=2)


def k_means(x: np.ndarray, k: int, u: Uniforms) -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, centres, sum of squares). Seeds are drawn by squared distance.

    A cluster that runs empty moves to the row farthest from all centres as they stand, and that row changes its
    label at once. Rounds end when no label changes; labels are those of the last round.
    """
    if k == 1:
        c = x.mean(axis=0, keepdims=True)
        return np.zeros(len(x), np.int64), c, float(_gaps(x, c).sum())
    centres = [x[int(u() * len(x))]]
    while len(centres) < k:
        d = _gaps(x, np.array(centres)).min(axis=1)
        left = u() * d.sum()
        at = np.flatnonzero(np.cumsum(d) >= left)
        centres.append(x[at[0]] if len(at) else x[-1])
    c, labels = np.array(centres), np.full(len(x), -1)
    for _ in range(ROUNDS):
        near = _gaps(x, c).argmin(axis=1)
        new = near.copy()
        for j in range(k):
            own = near == j
            if own.any():
                c[j] = x[own].mean(axis=0)
            else:
                far = int(_gaps(x, c).min(axis=1).argmax())
                c[j], new[far] = x[far], j
        same = (new == labels).all()
        labels = new
        if same:
            break
    return labels, c, float(((x - c[labels]) ** 2).sum())


def best_of(x: np.ndarray, dates: list[str], k: int, salt: int = 0, restarts: int = RESTARTS) -> tuple[np.ndarray, np.ndarray, float] | None:
    found = None
    for r in range(restarts if k > 1 else 1):
        got = k_means(x, k, Uniforms(seed_of(dates, k * 7919 + salt) + 104729 * r))
        if len(np.unique(got[0])) == k and (found is None or got[2] < found[2]):
            found = got
    return found


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    n = np.bincount(labels)
    sums = np.stack([d[:, labels == j].sum(axis=1) for j in range(len(n))], axis=1)
    i = np.arange(len(x))
    a = sums[i, labels] / np.maximum(n[labels] - 1, 1)
    other = sums / n
    other[i, labels] = np.inf
    b = other.min(axis=1)
    s = np.where((n[labels] > 1) & (np.maximum(a, b) > 0), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda v: (v * (v - 1) / 2).sum()
    both, rows, cols, every = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0)), pairs(np.array([len(a)]))
    expected, most = rows * cols / max(every, 1), (rows + cols) / 2
    return 1.0 if most == expected else float((both - expected) / (most - expected))


def stability(x: np.ndarray, dates: list[str], labels: np.ndarray, k: int) -> float:
    """Median agreement, over refits on four fifths of the days, of those days' labels with the refit's nearest centres."""
    u, scores = Uniforms(seed_of(dates, k * 65537)), []
    keep = max(4 * k, int(0.8 * len(x)))
    for trial in range(TRIALS):
        order = list(range(len(x)))
        for i in range(len(order) - 1, 0, -1):
            j = int(u() * (i + 1))
            order[i], order[j] = order[j], order[i]
        rows = np.array(sorted(order[:keep]))
        got = best_of(x[rows], [dates[i] for i in rows], k, trial * 313, 5)
        if got:
            scores.append(adjusted_rand(labels[rows], _gaps(x[rows], got[1]).argmin(axis=1)))
    return float(np.median(scores)) if scores else 0.0


def models_of(x: np.ndarray, dates: list[str]) -> tuple[np.ndarray, list[dict]]:
    """Labels of the largest accepted number of clusters, and a row of figures for each number that was tried."""
    fitted = {1: best_of(x, dates, 1)}
    tried = [{"k": 1, "accepted": True, "silhouette": 0.0, "improvement": 0.0, "stability": 1.0, "sizes": [len(x)]}]
    for k in range(2, min(4, len(x) // 4) + 1):
        fitted[k] = best_of(x, dates, k)
        if fitted[k] is None or fitted[k - 1] is None:
            continue
        labels, _, sse = fitted[k]
        sizes = np.bincount(labels, minlength=k)
        row = {"k": k, "silhouette": silhouette(x, labels), "improvement": (fitted[k - 1][2] - sse) / max(fitted[k - 1][2], 1e-6), "stability": stability(x, dates, labels, k), "sizes": sizes.tolist()}
        floors = zip((row["silhouette"], row["improvement"], row["stability"]), ACCEPT[k], strict=True)
        tried.append(row | {"accepted": bool(sizes.min() >= 4 and all(value >= floor for value, floor in floors))})
    chosen = max(row["k"] for row in tried if row["accepted"])
    return fitted[chosen][0], tried


def propose(x: np.ndarray, dates: list[str]) -> tuple[np.ndarray, int, float]:
    """(labels, selected k, stability) of the accepted model."""
    labels, tried = models_of(x, dates)
    own = max((row for row in tried if row["accepted"]), key=lambda row: row["k"])
    return labels, own["k"], own["stability"]


def diagnostics(featured: DataFrame) -> DataFrame:
    """(person, window_end, k, accepted, silhouette, improvement, stability, sizes) for each number of clusters tried."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        _, tried = models_of(pdf[FEATURES].to_numpy(float), [str(d)[:10] for d in pdf["day"]])
        return pd.DataFrame(tried).assign(person=pdf["person"].iloc[0], window_end=pdf["window_end"].iloc[0])

    person = featured.schema["person"].dataType.simpleString()
    return featured.groupBy(*KEY).applyInPandas(run, f"person {person}, window_end date, k int, accepted boolean, silhouette double, improvement double, stability double, sizes array<int>")


def cluster(featured: DataFrame) -> DataFrame:
    """featured with cluster, selected_k and stability. Rows of a window are taken by date, however they arrive."""
    columns = [f.name for f in featured.schema.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day").reset_index(drop=True)
        labels, k, sure = propose(pdf[FEATURES].to_numpy(float), [str(d)[:10] for d in pdf["day"]])
        return pdf[columns].assign(cluster=labels.astype("int32"), selected_k=np.int32(k), stability=sure)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in featured.schema.fields)
    return featured.groupBy(*KEY).applyInPandas(run, f"{schema}, cluster int, selected_k int, stability double")
