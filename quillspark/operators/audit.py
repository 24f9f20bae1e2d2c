"""Invariants as DataFrames of violations: an empty one passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AuditError(ValueError):
    """An invariant does not hold."""


def expect_none(violations: DataFrame, message: str) -> None:
    """Fail with the first few violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise AuditError(f"{message}: {[r.asDict() for r in found]}")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def coverage(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing and keys that are extra."""
    a, b = rows.select(*keys).distinct(), expected.select(*keys).distinct()
    return b.exceptAll(a).withColumn("problem", F.lit("missing")).unionByName(a.exceptAll(b).withColumn("problem", F.lit("extra")))


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full-outer comparison of one value by key; absent on either side is a mismatch."""
    a, b = left.select(*keys, F.col(value).alias("left_value")), right.select(*keys, F.col(value).alias("right_value"))
    marked = a.withColumn("__l", F.lit(True)).join(b.withColumn("__r", F.lit(True)), keys, "full_outer")
    same = F.col("__l").isNotNull() & F.col("__r").isNotNull() & F.col("left_value").eqNullSafe(F.col("right_value"))
    return marked.where(~same).select(*keys, "left_value", "right_value")


def out_of_tolerance(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    both = left.select(*keys, F.col(value).alias("left_value")).join(right.select(*keys, F.col(value).alias("right_value")), keys, "full_outer")
    apart = F.abs(F.col("left_value") - F.col("right_value")) > tolerance
    return both.where(F.col("left_value").isNull() | F.col("right_value").isNull() | apart)


def not_invariant(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys under which a value differs."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n")).where("n > 1")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    return a.exceptAll(b).withColumn("only", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only", F.lit("right")))


def valid_tokens(tokens: Column) -> Column:
    """Every token present, not empty, without white space or the field mark."""
    return F.forall(tokens, lambda t: t.isNotNull() & (t != "") & ~t.rlike(r"(?U)[\s\x1c-\x1f]") & ~t.contains("|||"))


def invalid_records(records: DataFrame) -> DataFrame:
    """Token-pair records that break a rule, with the reason."""
    ids = F.transform("references", lambda r: r["annotator_id"])
    reason = (
        F.when(~valid_tokens(F.col("source_tokens")), "invalid source token")
        .when(F.size("references") < 1, "no reference")
        .when(F.exists(ids, lambda i: i.isNull() | (i < 0)), "invalid annotator id")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "annotator repeats")
        .when(~F.forall("references", lambda r: valid_tokens(r["target_tokens"])), "invalid target token")
    )
    return records.withColumn("reason", reason).where("reason is not null")
