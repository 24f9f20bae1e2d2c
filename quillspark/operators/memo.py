"""Memo tables: what was computed before is joined, the rest is computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import save
from .audit import expect_none

def split_hits(asked: DataFrame, memo: DataFrame, key: str = "cache_key", distinct: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(asked rows with the memo's columns, asked rows that the memo lacks, one of each key or of each ``distinct``)."""
    return asked.join(memo, key), asked.join(memo, key, "left_anti").dropDuplicates(distinct or [key])


def hits_and_misses(asked: DataFrame, by: str, stores: Column, key: str = "cache_key") -> DataFrame:
    """``(by, hits, misses)``: asked rows whose key is among those of the rows that ``stores`` holds for, and distinct other keys.

    Each key of a group of ``by`` is shuffled once, with its number of rows.
    """
    each = asked.groupBy(key, by).agg(F.count("*").alias("n"), F.bool_or(stores).alias("stored"))
    met = each.groupBy(key).agg(F.bool_or("stored").alias("known"), F.collect_list(F.struct(by, "n")).alias("asked"))
    rows = met.select("known", F.explode("asked").alias("a")).select("known", f"a.{by}", "a.n")
    return rows.groupBy(by).agg(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("hits"), F.count_if(~F.col("known")).cast("long").alias("misses"))


def convert(asked: DataFrame, memo: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(answers for all asked rows, the memo with what was computed).  ``compute`` keeps the key.

    What was computed is written before it is used, so nothing is computed twice,
    and an asked key that is still without an answer is an error.
    """
    _, misses = split_hits(asked, memo, key)
    full = memo.unionByName(save(compute(misses).select(*memo.columns), "computed"))
    expect_none(asked.join(full, key, "left_anti").select(key), "asked for, and not computed")
    return asked.join(full, key), full


def append(memo_path: str, computed: DataFrame) -> None:
    """Add rows to a stored memo table; readers keep the first row of a key."""
    computed.write.mode("append").parquet(memo_path)


def resumable(rows: DataFrame, done: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that succeeded with the same input, rows still to do)."""
    ok = done.where("ok").select(*keys).distinct()
    return rows.join(ok, keys, "left_semi"), rows.join(ok, keys, "left_anti")


def latest_ok(journal: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last successful entry of each key."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return journal.where("ok").withColumn("__nr", F.row_number().over(last)).where("__nr = 1").drop("__nr")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__nr", F.row_number().over(first)).where("__nr = 1").drop("__nr")
