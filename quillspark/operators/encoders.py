"""Alignment by similarity from a batched encoder of units; encoders are plugged in, none is bundled.

An encoder takes sequences of units and gives each a matrix, a row for each
unit.  It is made once for each task, sees each distinct sequence of an Arrow
batch once, and only those of pairs that exact anchors leave gaps in.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ANCHORS
from . import kernels

Units = tuple[str, ...]
Encoder = Callable[[Sequence[Units]], "list[np.ndarray]"]
#: A feature of two units, from 0 to 1, and its weight.
Feature = tuple[float, Callable[[str, str], float]]


def unit_length(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x, dtype=float), where=length > 0)


def windows(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Stretches of at most ``size`` pieces that cover ``n``, each but the first beginning ``overlap`` before the last one's end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    out, at = [], 0
    while True:
        out.append((at, min(n, at + size)))
        if at + size >= n:
            return out
        at += size - overlap


def pooled_units(owners: Sequence[int], vectors: np.ndarray, n: int) -> np.ndarray:
    """Mean vector of each of ``n`` units over all its pieces, in whatever window they stand, of length one.

    ``owners`` names the unit of each piece (-1: none); a unit without a piece is an error.
    """
    owners = np.asarray(owners)
    inside = owners >= 0
    sums = np.zeros((n, vectors.shape[1]))
    np.add.at(sums, owners[inside], vectors[inside])
    counts = np.bincount(owners[inside], minlength=n)
    if n and counts.min() == 0:
        raise ValueError(f"unit {int(np.argmin(counts))} has no piece")
    return unit_length(sums / counts[:, None])


def hash_encoder(width: int = 64, grams: int = 2) -> Encoder:
    """Vectors of hashed character n-grams: units that share characters are alike.  A stand-in for a model."""

    def vector(unit: str) -> np.ndarray:
        out = np.zeros(width)
        for n in range(1, grams + 1):
            for k in range(max(1, len(unit) - n + 1)):
                digest = hashlib.blake2b(unit[k : k + n].encode(), digest_size=8).digest()
                out[int.from_bytes(digest, "big") % width] += 1
        return out

    return lambda batch: [unit_length(np.array([vector(u) for u in units]).reshape(len(units), width)) for units in batch]


class Remembered:
    """An encoder that is asked in batches, and remembers the last sequences."""

    def __init__(self, encode: Encoder, batch: int, most: int):
        self.encode, self.batch, self.most = encode, batch, most
        self.kept: OrderedDict[Units, np.ndarray] = OrderedDict()

    def __call__(self, asked: Sequence[Units]) -> dict[Units, np.ndarray]:
        out: dict[Units, np.ndarray] = {}
        missing = []
        for units in dict.fromkeys(asked):
            if units in self.kept:
                self.kept.move_to_end(units)
                out[units] = self.kept[units]
            else:
                missing.append(units)
        for k in range(0, len(missing), self.batch):
            some = missing[k : k + self.batch]
            for units, x in zip(some, self.encode(some), strict=True):
                if len(x) != len(units):
                    raise ValueError(f"{len(x)} vectors for {len(units)} units")
                out[units] = self.kept[units] = x
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return out


def similarity(a: Units, b: Units, x: np.ndarray, y: np.ndarray, features: Sequence[Feature], weight: float) -> np.ndarray:
    """Cosine of the vectors and further features of the units, by their weights."""
    total = weight * (unit_length(x) @ unit_length(y).T)
    for w, of in features:
        total = total + w * np.array([[of(s, t) for t in b] for s in a]).reshape(len(a), len(b))
    return total / (weight + sum(w for w, _ in features))


def nearest_in_gaps(exact: dict[int, int], scores: np.ndarray, threshold: float) -> dict[int, int]:
    """Free target units with their most similar free source unit at ``threshold`` or more, each source unit once, best first.

    Of what crosses, the longest part that does not is kept between exact anchors.
    """
    m, n = scores.shape
    free_s, free_t = sorted(set(range(m)) - set(exact.values())), sorted(set(range(n)) - set(exact))
    pairs = sorted(((-scores[s, t], t, s) for t in free_t for s in free_s if scores[s, t] >= threshold))
    found: dict[int, int] = {}
    for _, t, s in pairs:
        if t not in found and s not in found.values():
            found[t] = s
    return kernels.monotonic_fuzzy(exact, found, m, n)


def batched_anchors(
    make_encoder: Callable[[], Encoder], threshold: float = 0.6, crossing: bool = False, features: Sequence[Feature] = (), weight: float = 1.0,
    batch: int = 32, remember: int = 64,
) -> Callable[[Column, Column], Column]:
    """(source, target) -> anchors: exact ones, and similar ones by the encoder in what these leave open.

    Within residual gaps non-crossing matches of the largest surplus are taken; with
    ``crossing`` every free unit looks for its nearest anywhere, and what does not
    cross is kept (the two-step character aligner, whose further features of
    characters are given by ``features``).
    """

    @F.pandas_udf(ANCHORS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encoder = Remembered(make_encoder(), batch, remember)
        for sources, targets in batches:
            pairs = [(tuple(a), tuple(b)) for a, b in zip(sources, targets)]
            exact = [kernels.lcs_anchors(a, b) for a, b in pairs]
            open_ = [bool(set(range(len(a))) - set(e.values())) and len(e) < len(b) if crossing else bool(kernels.residual_gaps(e, len(a), len(b))) for (a, b), e in zip(pairs, exact)]
            vectors = encoder([units for pair, o in zip(pairs, open_) if o for units in pair])
            out = []
            for (a, b), same, o in zip(pairs, exact, open_):
                rows = [{"t": t, "s": s, "kind": "exact", "cosine": None} for t, s in same.items()]
                if o:
                    table = similarity(a, b, vectors[a], vectors[b], features, weight)
                    near = nearest_in_gaps(same, table, threshold) if crossing else kernels.align(a, b, lambda i, j: table[i, j], threshold)[1]  # noqa: B023
                    rows += [{"t": t, "s": s, "kind": "similar", "cosine": float(table[s, t])} for t, s in near.items()]
                out.append(sorted(rows, key=lambda r: r["t"]))
            yield pd.Series(out)

    return run
