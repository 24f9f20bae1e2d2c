"""Small building blocks of native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the word rules have it: \x20 and \x09-\x0D.
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\u000b\u000c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where body has lambdas that use it.

    A column that only a lambda reads may be inlined by the optimizer and then be
    computed anew for every element; a lambda's own variable is not.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def count_of(text: Column, chars: str) -> Column:
    """How many of the text's code points are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


#: Elements that one inner fold joins; folds over folds keep the work on n elements at about n times this.
FOLD = 512
#: Code points in a block of :func:`cut_out`.
BLOCK = 4096


def spans_of(steps: Column) -> Column:
    """array<struct<start, stop, match>> from array<struct<gap, match>>: matches in order and the length before each.

    An array grows by copying, so places are summed over runs of FOLD elements,
    and each run is then moved to its place.
    """
    none = F.expr("cast(array() as array<struct<start: int, stop: int, match: string>>)")

    def add(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        end = begin + F.length(s["match"])
        span = F.struct(begin.alias("start"), end.alias("stop"), s["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def run(b: Column) -> Column:
        return F.aggregate(F.slice(steps, b * FOLD + 1, FOLD), F.struct(F.lit(0).alias("at"), none.alias("spans")), add)

    def moved(runs: Column) -> Column:
        starts = F.aggregate(
            runs, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"]))
        )

        def shift(s: Column) -> Column:
            return F.flatten(
                F.transform(
                    runs,
                    lambda r, i: F.transform(
                        r["spans"],
                        lambda x: F.struct(
                            (x["start"] + F.get(s, i)).alias("start"), (x["stop"] + F.get(s, i)).alias("stop"), x["match"].alias("match")
                        ),
                    ),
                )
            )

        return let(starts, shift)

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / FOLD).cast("int")), run)
    return F.when(F.size(steps) > 0, let(runs, moved)).otherwise(none)


def match_spans(text: Column, pattern: str) -> Column:
    """The pattern's leftmost non-overlapping matches as array<struct<start, stop, match>>.

    Offsets count code points from 0, stop exclusive.  What stands between the
    matches and the matches themselves together make the text, so their lengths
    place each match; the pattern must not match an empty string.
    """
    none = F.expr("cast(array() as array<struct<start: int, stop: int, match: string>>)")

    def steps(parts: Column) -> Column:
        return F.transform(parts["found"], lambda m, i: F.struct(F.length(F.get(parts["gaps"], i)).alias("gap"), m.alias("match")))

    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )
    return F.when(text.rlike(pattern), let(let(parts, steps), spans_of)).otherwise(none)


def running_max(values: Column) -> Column:
    """array<int>: the greatest of ``values`` (array<int>) up to each place."""

    def run(b: Column) -> Column:
        low = F.array().cast("array<int>")
        return F.aggregate(
            F.slice(values, b * FOLD + 1, FOLD), low, lambda acc, x: F.concat(acc, F.array(F.greatest(F.try_element_at(acc, F.lit(-1)), x)))
        )

    def whole(runs: Column) -> Column:
        before = F.aggregate(
            runs, F.array(F.lit(None).cast("int")), lambda acc, r: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.element_at(r, -1))))
        )
        return let(before, lambda top: F.flatten(F.transform(runs, lambda r, i: F.transform(r, lambda x: F.greatest(x, F.get(top, i))))))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FOLD).cast("int")), run)
    return F.when(F.size(values) > 0, let(runs, whole)).otherwise(F.array().cast("array<int>"))


def joined_spans(spans: Column) -> Column:
    """array<struct<start, stop>>: ``spans``, in order of their starts, with those that overlap or touch made one."""

    def joined(v: Column) -> Column:
        begins = F.filter(v["spans"], lambda s, k: (k == 0) | (s["start"] > F.get(v["upto"], k - 1)))
        ends = F.filter(v["upto"], lambda u, k: (k == F.size(v["upto"]) - 1) | (F.get(v["spans"], k + 1)["start"] > u))
        return F.zip_with(begins, ends, lambda b, e: F.struct(b["start"].alias("start"), e.alias("stop")))

    def with_reach(x: Column) -> Column:
        return let(F.struct(x.alias("spans"), running_max(F.transform(x, lambda s: s["stop"])).alias("upto")), joined)

    return let(spans, with_reach)


def cut_out(text: Column, spans: Column) -> Column:
    """array<string>: what stands under each of ``spans`` (struct<start, stop>, code points).

    A substring counts its place from the text's beginning; so the text is first
    cut into blocks, and each span reads the blocks that it touches alone.
    """

    def cut(v: Column) -> Column:
        def one(s: Column) -> Column:
            first, last = F.floor(s["start"] / BLOCK).cast("int"), F.floor((s["stop"] - 1) / BLOCK).cast("int")
            near = F.array_join(F.slice(v["blocks"], first + 1, F.greatest(last - first + 1, F.lit(1))), "")
            return F.substring(near, (s["start"] - first * BLOCK + 1).cast("int"), F.greatest(s["stop"] - s["start"], F.lit(0)).cast("int"))

        return F.transform(v["spans"], one)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(F.struct(blocks.alias("blocks"), spans.alias("spans")), cut)
