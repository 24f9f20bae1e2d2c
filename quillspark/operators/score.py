"""Scoring of hypothesis edits against several complete references."""

from __future__ import annotations

import itertools
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import f_beta, precision, recall
from ..functions.text import link_comment

UNIT = "␟"


def _key(s0: Column, s1: Column, correction: Column) -> Column:
    return F.concat_ws("|", s0.cast("string"), s1.cast("string"), F.array_join(correction, UNIT))


def logical_edits(edit_rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, edit_key, labels)`` from physical edits (keys, s0, s1, kind, correction, comment).

    A key is span and correction, never the type.  The two sides of a link are one
    edit, keyed by origin, destination and material; its label is WO.  Edits of one
    key keep the list of their labels.  noop edits are no edits.
    """
    rows = edit_rows.where("kind <> 'noop'").withColumn("link", link_comment(F.col("comment")))
    plain = rows.where("link is null").select(*keys, _key(F.col("s0"), F.col("s1"), F.col("correction")).alias("edit_key"), F.col("kind").alias("label"))
    linked = rows.where("link is not null")
    gone = linked.where("kind = 'U'").select(*keys, F.col("link.link").alias("link_id"), "s0", "s1")
    come = linked.where("kind = 'M'").select(*keys, F.col("link.link").alias("link_id"), F.col("s0").alias("to"), "correction")
    moved = gone.join(come, [*keys, "link_id"]).select(
        *keys,
        F.concat_ws("|", F.lit("W-LD"), F.col("s0").cast("string"), F.col("s1").cast("string"), F.col("to").cast("string"), F.array_join("correction", UNIT)).alias("edit_key"),
        F.lit("WO").alias("label"),
    )
    return plain.unionByName(moved).groupBy(*keys, "edit_key").agg(F.sort_array(F.collect_list("label")).alias("labels"))


def match_edits(candidates: DataFrame, hyp: DataFrame, ref: DataFrame, row: list[str], hyp_id: list[str], ref_id: list[str]) -> DataFrame:
    """Outcome of every edit of every candidate: (row, hyp_id, ref_id, label, tp, fp, fn).

    candidates holds (row, hyp_id, ref_id).  A key on both sides counts its
    reference labels as true positives; otherwise each side's labels are false.
    """
    h = candidates.join(hyp, [*row, *hyp_id]).select(*row, *hyp_id, *ref_id, "edit_key", F.col("labels").alias("h"))
    r = candidates.join(ref, [*row, *ref_id]).select(*row, *hyp_id, *ref_id, "edit_key", F.col("labels").alias("r"))
    met = h.join(r, [*row, *hyp_id, *ref_id, "edit_key"], "full_outer")
    counted = met.select(*row, *hyp_id, *ref_id, F.col("h").isNotNull().alias("in_h"), F.col("r").isNotNull().alias("in_r"), F.explode(F.coalesce("r", "h")).alias("label"))
    both = F.col("in_h") & F.col("in_r")
    one = lambda c: F.when(c, 1).otherwise(0)
    return counted.select(*row, *hyp_id, *ref_id, "label", one(both).alias("tp"), one(F.col("in_h") & ~F.col("in_r")).alias("fp"), one(F.col("in_r") & ~F.col("in_h")).alias("fn"))


def score_candidates(candidates: DataFrame, outcomes: DataFrame, keys: list[str], beta: float = 0.5) -> DataFrame:
    """``candidates`` with tp, fp, fn and local f; a candidate without edits counts (0, 0, 0)."""
    sums = outcomes.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    filled = candidates.join(sums, keys, "left").select(*candidates.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return filled.withColumn("f", f_beta(F.col("tp"), F.col("fp"), F.col("fn"), beta))


def select_best(scored: DataFrame, row: list[str], order: list[str]) -> DataFrame:
    """Per row the candidate of highest f, then tp, then lowest fp, fn, then first in ``order``."""
    best = Window.partitionBy(*row).orderBy(F.desc("f"), F.desc("tp"), "fp", "fn", *order)
    return scored.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank")


def pooled(best: DataFrame, by: list[str], beta: float = 0.5) -> DataFrame:
    """Counts summed over rows, with precision, recall and F of the sums."""
    sums = best.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumn("precision", precision(tp, fp)).withColumn("recall", recall(tp, fn)).withColumn("f", f_beta(tp, fp, fn, beta))


def corpus_greedy(scored: DataFrame, by: list[str], row: str, order: list[str], beta: float = 0.5) -> DataFrame:
    """Historical selection by the four-decimal F of running totals, a fold over rows in order.

    Each choice depends on all before it, so a group of ``by`` is one task's work;
    its rows are bare counts.
    """

    def value(tp: int, fp: int, fn: int) -> float:
        p = tp / (tp + fp) if fp else 1.0
        r = tp / (tp + fn) if fn else 1.0
        return round((1 + beta * beta) * p * r / (beta * beta * p + r), 4) if p + r else 0.0

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([row, *order], kind="stable")
        total = (0, 0, 0)
        for _, candidates in itertools.groupby(zip(frame[row], frame["tp"], frame["fp"], frame["fn"]), key=operator.itemgetter(0)):
            sums = [(total[0] + int(tp), total[1] + int(fp), total[2] + int(fn)) for _, tp, fp, fn in candidates]
            # of equal ones the first
            total = max(sums, key=lambda t: (value(*t), t[0], -t[1], -t[2]))
        return pd.DataFrame([[*frame[by].iloc[0], *total]], columns=[*by, "tp", "fp", "fn"])

    kinds = ", ".join(f"{c} {scored.schema[c].dataType.simpleString()}" for c in by)
    return scored.groupBy(*by).applyInPandas(fold, f"{kinds}, tp long, fp long, fn long")


# ---- the same algebra over arrays: a sentence's edits stay in its row, so nothing is shuffled before pooling ----------


def keyed_edits(edits: Column) -> Column:
    """array<struct<key, label>> of an array of edits: what :func:`logical_edits` makes, within the row."""
    plain = lambda e: F.struct(_key(e["s0"], e["s1"], e["correction"]).alias("key"), e["kind"].alias("label"))
    counted = F.filter(edits, lambda e: e["kind"] != "noop")

    def moved(all_: Column) -> Column:
        name = lambda e: F.regexp_extract(e["comment"], "^LINK=(w[0-9]+);", 1)

        def pair(u: Column) -> Column:
            m = F.get(F.filter(all_, lambda e: (e["kind"] == "M") & (name(e) == name(u))), F.lit(0))
            key = F.concat_ws("|", F.lit("W-LD"), u["s0"].cast("string"), u["s1"].cast("string"), m["s0"].cast("string"), F.array_join(m["correction"], UNIT))
            return F.struct(key.alias("key"), F.lit("WO").alias("label"))

        linked = F.transform(F.filter(all_, lambda e: e["comment"].startswith("LINK=") & (e["kind"] == "U")), pair)
        return F.concat(F.transform(F.filter(all_, lambda e: ~e["comment"].startswith("LINK=")), plain), linked)

    return F.when(F.exists(counted, lambda e: e["comment"].startswith("LINK=")), moved(counted)).otherwise(F.transform(counted, plain))


def outcome_arrays(h: Column, r: Column) -> Column:
    """struct<tp, fp, fn> of label arrays: a key on both sides counts its reference labels."""
    labels = lambda of, other, inside: F.transform(
        F.filter(of, lambda x: F.array_contains(other["key"], x["key"]) if inside else ~F.array_contains(other["key"], x["key"])), lambda x: x["label"]
    )
    return F.struct(labels(r, h, True).alias("tp"), labels(h, r, False).alias("fp"), labels(r, h, False).alias("fn"))


def candidate_array(h: Column, refs: Column, beta: float = 0.5) -> Column:
    """One struct<loss, minus_tp, fp, fn, ref_id, tp, f, outcome> for each of refs: array<struct<ref_id, edits>>.

    Both sides' edits are keyed.  Structs order from better to worse, so the
    least of the array is the selected candidate.
    """

    def scored(ref: Column) -> Column:
        def sized(o: Column) -> Column:
            tp, fp, fn = F.size(o["tp"]), F.size(o["fp"]), F.size(o["fn"])
            f = f_beta(tp, fp, fn, beta)
            return F.struct((-f).alias("loss"), (-tp).alias("minus_tp"), fp.alias("fp"), fn.alias("fn"), ref["ref_id"].alias("ref_id"), tp.alias("tp"), f.alias("f"), o.alias("outcome"))

        return F.transform(F.array(outcome_arrays(h, ref["edits"])), sized)[0]

    return F.transform(refs, scored)


# ---- the same over a batch's rows at once: edits are numbers, sorted by row -------------------------------------------


def f_beta_of(tp: np.ndarray, fp: np.ndarray, fn: np.ndarray, beta: float = 0.5) -> np.ndarray:
    """:func:`..functions.scores.f_beta` of columns of counts."""
    p = np.where(fp == 0, 1.0, tp / np.maximum(tp + fp, 1))
    r = np.where(fn == 0, 1.0, tp / np.maximum(tp + fn, 1))
    b = beta * beta
    below = b * p + r
    return np.where(p + r == 0, 0.0, (1 + b) * p * r / np.where(below == 0, 1, below))


def found_in(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the sorted numbers ``one`` are among the sorted numbers ``other``."""
    if not len(other):
        return np.zeros(len(one), bool)
    return other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one


def counts_of(h: np.ndarray, r: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tp, fp, fn) of rows 0 to ``size`` - 1, from both sides' edits as sorted numbers.

    A number stands for an edit's row, span and correction, and ``rows`` is what
    a row's first number is.
    """
    per_row = lambda x: np.diff(np.searchsorted(x, np.append(rows, np.iinfo(np.int64).max)))[:size]
    tp = per_row(r[found_in(r, h)])
    return tp, per_row(h[~found_in(h, r)]), per_row(r) - tp


def best_of(candidates: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(ref, tp, fp, fn, f) of each row's best candidate; -1 as ref where it has none.

    Candidates are (has, tp, fp, fn) of each reference in turn: the highest f, then
    tp, then the lowest fp, fn, then the first.
    """
    best = None
    for k, (has, tp, fp, fn) in enumerate(candidates):
        f = f_beta_of(tp, fp, fn)
        now = (np.where(has, k, -1), tp, fp, fn, f)
        if best is None:
            best = now
            continue
        ref, tp_, fp_, fn_, f_ = best
        better = (f > f_) | ((f == f_) & ((tp > tp_) | ((tp == tp_) & ((fp < fp_) | ((fp == fp_) & (fn < fn_))))))
        take = has & (better | (ref < 0))
        best = tuple(np.where(take, a, b) for a, b in zip(now, best))
    return best
