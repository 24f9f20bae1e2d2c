"""Sentence GLEU: n-grams counted in one Arrow kernel, a row's outputs and references together."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .units import Sequences

ORDERS = 4
#: Rows whose tables of equal places are held at once.
AT_ONCE = 2048
Grams = list[Counter]


def grams(units: Sequence, orders: int = ORDERS) -> Grams:
    """Counts of the sequence's n-grams, for every order."""
    return [Counter(zip(*(islice(units, k, None) for k in range(n)))) for n in range(1, orders + 1)]


def gleu_of(source: tuple[int, Grams], hypothesis: tuple[int, Grams], reference: tuple[int, Grams]) -> float:
    """GLEU from 0 to 1 of three (length, grams); a count of zero is smoothed to one.

    Of each order: matches with the reference, less matches with grams that the
    source has and the reference has not.  Our reading of the published metric
    (2015, revised 2016), whose reference kernel is not at hand.
    """
    total = 0.0
    for n, (s, h, r) in enumerate(zip(source[1], hypothesis[1], reference[1])):
        met = 0
        for gram, count in h.items():
            if gram in r:
                met += min(count, r[gram])
            elif gram in s:
                met -= min(count, s[gram])
        total += math.log(max(met, 1)) - math.log(max(hypothesis[0] - n, 1))
    c, r = max(hypothesis[0], 1), max(reference[0], 1)
    return math.exp(total / len(hypothesis[1]) + min(0.0, 1 - r / c))


def _offsets(lists) -> list[int]:
    return lists.offsets.to_pylist()


def gleu_table(orders: int = ORDERS):
    """(source, hypotheses, references) -> array<array<double>>: each hypothesis's GLEU with each reference.

    Sequences are arrays of units.  Units are numbered once for a batch, equal
    outputs of a row are scored once, and nothing leaves the row.  A null is an
    error, empty lists give empty lists.
    """

    @F.arrow_udf("array<array<double>>")
    def run(source, hypotheses, references):
        import pyarrow as pa

        if source.null_count or hypotheses.null_count or references.null_count:
            raise ValueError("source, hypotheses and references must be present")
        # all three as lists of sequences over one list of numbered units
        sides = [source, hypotheses.values, references.values]
        ids = pa.concat_arrays([s.values for s in sides]).dictionary_encode().indices.to_pylist()
        sequences, shift = [], 0
        for s in sides:
            at = _offsets(s)
            sequences.append((at, shift))
            shift += len(s.values)

        def counted(side: int, k: int) -> tuple[int, Grams]:
            at, begin = sequences[side]
            units = ids[begin + at[k] : begin + at[k + 1]]
            return len(units), grams(units, orders)

        of_h, of_r, out = _offsets(hypotheses), _offsets(references), []
        for k in range(len(source)):
            src, refs, done, row = counted(0, k), [counted(2, j) for j in range(of_r[k], of_r[k + 1])], {}, []
            for j in range(of_h[k], of_h[k + 1]):
                at, begin = sequences[1]
                key = tuple(ids[begin + at[j] : begin + at[j + 1]])
                if key not in done:
                    hyp = (len(key), grams(key, orders))
                    done[key] = [gleu_of(src, hyp, r) for r in refs]
                row.append(done[key])
            out.append(row)
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return run


def sentence_gleu(source: Column, hypothesis: Column, reference: Column, orders: int = ORDERS) -> Column:
    """GLEU of token or character arrays."""
    return gleu_table(orders)(source, F.array(hypothesis), F.array(reference))[0][0]


def select_best(scores: DataFrame, row: list[str], score: str = "gleu", ref_id: str = "ref_id") -> DataFrame:
    """The first of the highest scores of each row."""
    best = Window.partitionBy(*row).orderBy(F.desc(score), ref_id)
    return scores.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank")


def running_best(scores: DataFrame, row: list[str], score: str = "gleu", ref_id: str = "ref_id") -> DataFrame:
    """Each row's best score over its first k references, for every k."""
    upto = Window.partitionBy(*row).orderBy(ref_id).rowsBetween(Window.unboundedPreceding, 0)
    return scores.withColumn("best", F.max(score).over(upto)).withColumn("k", F.row_number().over(Window.partitionBy(*row).orderBy(ref_id)))


def running_best_within(scores: Column) -> Column:
    """The same within a row: the best of the first k of ``scores``, for every k."""
    some = F.transform(F.sequence(F.lit(1), F.size(scores)), lambda k: F.array_max(F.slice(scores, F.lit(1), k)))
    return F.when(F.size(scores) > 0, some).otherwise(F.array().cast("array<double>"))


def gleu_of_batch(source: Sequences, hypothesis: Sequences, reference: Sequences, orders: int = ORDERS) -> np.ndarray:
    """:func:`gleu_of` of every row of short sequences, from tables of which places hold equal units.

    Grams at two places are equal if their units are, one after the other.  A gram's
    matches are its places in the hypothesis that have fewer equal places before them
    than the other side has at all.
    """
    parts = [
        _gleu_of_some(*[Sequences(x.ids[a : a + AT_ONCE], x.n[a : a + AT_ONCE]) for x in (source, hypothesis, reference)], orders) for a in range(0, len(source), AT_ONCE)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def _gleu_of_some(source: Sequences, hypothesis: Sequences, reference: Sequences, orders: int) -> np.ndarray:
    # beyond their ends the sides hold different numbers, so no gram that leaves a side is equal to one
    s, h, r = (np.ascontiguousarray(np.where(x.ids < 0, -k, x.ids).T) for k, x in enumerate((source, hypothesis, reference), 1))
    units = [x[:, None, :] == h[None, :, :] for x in (s, h, r)]
    units[1] &= np.triu(np.ones((len(h), len(h)), bool), 1)[:, :, None]  # what stands before
    equal, total, n = units, 0.0, hypothesis.n
    places = np.arange(len(h))[:, None]
    for k in range(orders):
        if k:
            equal = [e[:-1, :-1] & u[k:, k:] for e, u in zip(equal, units)]
        in_s, before, in_r = (e.view(np.uint8).sum(0, dtype=np.uint16) for e in equal)
        inside = (places[: max(len(h) - k, 0)] + k) < n[None, :]
        met = (inside & (before < in_r)).sum(0) - (inside & (in_r == 0) & (before < in_s)).sum(0)
        total = total + (np.log(np.maximum(met, 1)) - np.log(np.maximum(n - k, 1)))
    return np.exp(total / orders + np.minimum(0.0, 1 - np.maximum(reference.n, 1) / np.maximum(n, 1)))
