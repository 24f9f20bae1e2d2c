"""Precision, recall and F from counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision(tp: Column, fp: Column) -> Column:
    return F.when(fp == 0, F.lit(1.0)).otherwise(tp / (tp + fp))


def recall(tp: Column, fn: Column) -> Column:
    return F.when(fn == 0, F.lit(1.0)).otherwise(tp / (tp + fn))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 0.5) -> Column:
    """One without false positives, one without false negatives, zero if both ratios are zero."""
    p, r, b = precision(tp, fp), recall(tp, fn), beta * beta
    return F.when(p + r == 0, F.lit(0.0)).otherwise((1 + b) * p * r / (b * p + r))


def exact_f05(tp: Column, fp: Column, fn: Column) -> Column:
    below = 1.25 * tp + fp + 0.25 * fn
    return F.when(below == 0, F.lit(1.0)).otherwise(1.25 * tp / below)
