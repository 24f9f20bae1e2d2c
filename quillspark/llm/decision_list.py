"""Quality rules: word statistics of whole texts and a learned decision list over them.

The list is learned by sequential covering: conjunctions of thresholds are grown
by information gain on part of the labelled rows, from each feature in turn, and
pruned on the rest, part after part; of those that stay precise there the widest
becomes a rule, the rows it covers go, and the next rule starts.  Rules come out as ordered Spark conditions, so judging a
text needs built-in functions alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import BLANK_CHARS, count_of, let, words

SYMBOLS = "#*$%&|<>"
#: A text fails at once with fewer words, or with a larger share (percent) of repeated words.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Labelled rows that the learner reads at most, by a hash of the id.
MAX_LABELLED = 20_000
#: What the thresholds may be about.
FEATURES = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "line_length", "n_words")


def _repeated(parts: Column, width: int) -> Column:
    """Words that stand in ``width``-word windows found twice or more, first included.

    Windows are told apart by a 64-bit hash.  Only a text with two equal hashes
    pays for the sort; equal ones then stand together, and the places they cover
    are summed in order.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(parts) - width), lambda i: F.xxhash64(F.slice(parts, i + 1, width))
    )

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when(
                        (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda x: x.isNotNull(),
            )
            def gaps(at: Column) -> Column:
                reach = F.transform(at, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - x, F.lit(width))))
                return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

            return let(F.sort_array(same), gaps)

        return let(placed, twice)

    once = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(parts) > width, once).otherwise(F.lit(0).cast("long"))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and the learner's features in one struct column ``stats``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0)

    def per_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), _repeated(w, WINDOW).alias("repeated"))

    def per_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    measured = F.struct(
        let(words(text), per_words).alias("w"),
        let(lines, per_lines).alias("l"),
        F.length(F.translate(text, BLANK_CHARS, "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("upper"),
        F.regexp_count(text, F.lit(r"[0-9]")).alias("digits"),
        F.regexp_count(text, F.lit(r"[!?|]")).alias("marks"),
    )

    def stats(m: Column) -> Column:
        n, chars = m["w"]["n"], F.greatest(m["word_chars"], F.lit(1))
        least = F.greatest(n, F.lit(1))
        failed = (n < MIN_WORDS) | (100 * m["w"]["repeated"] > MAX_REPEAT_PERCENT * n)
        return F.struct(
            n.alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
            m["l"]["dup"].alias("n_dup_lines"), m["w"]["repeated"].alias("n_repeat_words"), failed.alias("base_failed"),
            (m["word_chars"] / least).alias("word_length"), (m["n_symbols"] / least).alias("symbol_rate"),
            (m["l"]["dup"] / F.greatest(m["l"]["n"], F.lit(1))).alias("dup_line_rate"),
            (m["w"]["repeated"] / least).alias("repeat_rate"), (m["upper"] / chars).alias("upper_rate"),
            (m["digits"] / chars).alias("digit_rate"), (m["marks"] / least).alias("mark_rate"),
            (n / F.greatest(m["l"]["n"], F.lit(1))).alias("line_length"),
        )

    return docs.withColumn("stats", let(measured, stats))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, stats: Column) -> Column:
        value = stats[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]

    def holds(self, row: dict) -> bool:
        return all(t.holds(row) for t in self.tests)

    def column(self, stats: Column) -> Column:
        out = self.tests[0].column(stats)
        for t in self.tests[1:]:
            out = out & t.column(stats)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


class _Table:
    """Labelled rows by feature, each feature's order worked out once."""

    def __init__(self, rows: list[dict]):
        self.x = np.array([[float(r[f]) for f in FEATURES] for r in rows]).reshape(len(rows), len(FEATURES))
        self.bad = np.array([bool(r["bad"]) for r in rows], bool)
        self.order = np.argsort(self.x, axis=0, kind="stable")

    def holds(self, test: Test) -> np.ndarray:
        values = self.x[:, FEATURES.index(test.feature)]
        return values > test.threshold if test.above else values <= test.threshold

    def covered(self, tests: tuple[Test, ...]) -> np.ndarray:
        out = np.ones(len(self.bad), bool)
        for t in tests:
            out &= self.holds(t)
        return out

    def best_test(self, inside: np.ndarray, feature: int | None = None) -> Test | None:
        """The cut between neighbouring values with the most FOIL gain over the rows ``inside``; None: no gain."""
        total, total_bad = int(inside.sum()), int((inside & self.bad).sum())
        if not total_bad or total_bad == total:
            return None
        base, best, found = math.log2(total_bad / total), 1e-9, None
        for f in range(len(FEATURES)) if feature is None else (feature,):
            order = self.order[:, f]
            order = order[inside[order]]
            values, bad = self.x[order, f], np.cumsum(self.bad[order])
            at = np.flatnonzero(values[:-1] < values[1:])  # a cut after each of these places
            for above in (False, True):
                n_bad = total_bad - bad[at] if above else bad[at]
                n = total - at - 1 if above else at + 1
                gain = np.where(n_bad > 0, n_bad * (np.log2(np.maximum(n_bad, 1) / n) - base), 0.0)
                if len(gain) and gain.max() > best:
                    k = int(np.argmax(gain))
                    low, high = float(values[at[k]]), float(values[at[k] + 1])
                    middle = (low + high) / 2
                    best, found = float(gain[k]), Test(FEATURES[f], above, middle if low < middle < high else low)
        return found

    def grown(self, inside: np.ndarray, first: int, most: int) -> list[Test]:
        """A conjunction that begins with a test of feature ``first`` and goes on by gain."""
        tests: list[Test] = []
        while len(tests) < most and (test := self.best_test(inside, None if tests else first)):
            tests.append(test)
            inside = inside & self.holds(test)
        return tests


def _precision(hit: np.ndarray, bad: np.ndarray) -> float:
    return float((hit & bad).sum() / hit.sum()) if hit.any() else 0.0


def learn_rules(rows: list[dict], max_rules: int = 12, max_tests: int = 3, precision: float = 0.99, sure: float = 0.9, folds: int = 3) -> list[Rule]:
    """Ordered rules for rows whose ``bad`` is true; rows hold the features and ``bad``.

    For each rule every feature begins a conjunction, which is grown on all but
    one fold of the rows not yet covered and pruned on that fold (rows are dealt to
    folds by their order), for each fold in turn.  A conjunction is a candidate if
    it hits bad rows of its pruning fold, and its precision is at least
    ``precision`` there, on all rows not yet covered and on all rows; and at least
    ``sure`` if one good row more had been covered, so that a few rows by chance
    make no rule.  The candidate that covers the most bad rows becomes the next rule (then the
    most precise, then the shortest, then the first).  No candidate ends the
    list.  No labelled rows, or rows of one label: no rules.
    """
    if not rows:
        return []
    table = _Table(rows)
    fold, left, rules = np.arange(len(rows)) % folds, np.ones(len(rows), bool), []
    while len(rules) < max_rules and (left & table.bad).any():
        found: dict[tuple, tuple[Test, ...]] = {}
        for out in range(folds):
            prune = left & (fold == out)
            for first in range(len(FEATURES)):
                tests = table.grown(left & (fold != out), first, max_tests)
                for n in range(1, len(tests) + 1):
                    hit = table.covered(tuple(tests[:n]))
                    n_bad, n_all = int((hit & left & table.bad).sum()), int((hit & left).sum())
                    fit = _precision(hit & left, table.bad)
                    if min(_precision(hit & prune, table.bad), fit, _precision(hit, table.bad)) < precision or n_bad < sure * (n_all + 1):
                        continue
                    found.setdefault((-n_bad, -fit, n, first, out), tuple(tests[:n]))
                    break  # a longer one is no more precise than is asked for
        if not found:
            break
        tests = found[min(found)]
        # of two cuts on one side of a feature the later is the stricter
        rules.append(Rule(tuple(t for k, t in enumerate(tests) if not any((o.feature, o.above) == (t.feature, t.above) for o in tests[k + 1 :]))))
        left &= ~table.covered(rules[-1].tests)
    return rules


def labelled_statistics(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = MAX_LABELLED
) -> list[dict]:
    """Features of at most ``limit`` labelled rows, chosen and ordered by a hash of the id; label 0 is bad.

    Texts are measured for the chosen rows alone.  Null labels, ids and texts teach nothing.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(id_col)
        .agg(F.min(label_col).alias("label"))
        .select(F.col(id_col).alias("id"), "label", F.xxhash64(F.col(id_col)).alias("order"))
        .orderBy("order", "id")
        .limit(limit)
    )
    # at most ``limit`` short rows: their size is proven
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    joined = with_statistics(texts.join(F.broadcast(chosen), "id"))
    got = joined.select("id", "order", "label", *[F.col("stats")[f].cast("double").alias(f) for f in FEATURES]).collect()
    got.sort(key=lambda r: (r["order"], r["id"]))
    return [{f: r[f] for f in FEATURES} | {"bad": r["label"] == 0} for r in got]


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with ``stats`` (struct), ``rule`` (int, the first rule that holds; null: none) and ``kept``.

    kept is false where the base rules fail or a learned rule holds.  Null texts
    are empty and fail for want of words.  Repeated rows are judged alike, an
    empty table stays empty; a column named stats, rule or kept is replaced.
    """
    measured = with_statistics(docs, text_col)
    first = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        first = F.when(rules[k].column(F.col("stats")), F.lit(k)).otherwise(first)
    judged = measured.withColumn("rule", first)
    return judged.withColumn("kept", ~F.col("stats.base_failed") & F.col("rule").isNull())
