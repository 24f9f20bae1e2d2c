"""Roll-ups over scores, outputs and segmentations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import exact_f05
from ..functions.text import boundaries, boundary_f1, reference_bucket


def _n(condition) -> F.Column:
    return F.count_if(condition).cast("long")


def dataset_statistics(refs: DataFrame, by: str = "ds", row: str = "row_id") -> DataFrame:
    """Sentences and references of each dataset, and of all in a Total row."""
    each = refs.groupBy(by, row).agg(F.count("*").alias("n"))
    out = each.rollup(by).agg(
        F.count("*").alias("sentences"), F.sum("n").cast("long").alias("references"), _n(F.col("n") > 1).alias("multi_reference"),
        _n(F.col("n") > 3).alias("over_3"), F.max("n").cast("long").alias("max_references"),
    )
    return out.withColumn(by, F.coalesce(by, F.lit("Total")))


def reference_distribution(refs: DataFrame, by: str = "ds", row: str = "row_id") -> DataFrame:
    return refs.groupBy(by, row).agg(F.count("*").alias("n_refs")).groupBy(by, "n_refs").agg(F.count("*").alias("sentences"))


def by_density(best: DataFrame, refs: DataFrame, stage: str = "stage", row: str = "row_id") -> DataFrame:
    """Counts of the selected candidates pooled by how many references their sentence has."""
    buckets = refs.groupBy(row).agg(reference_bucket(F.count("*")).alias("bucket"))
    sums = best.join(buckets, row).groupBy("bucket", stage).agg(
        F.count("*").alias("sentences"), *[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    )
    return sums.withColumn("f05", exact_f05(F.col("tp"), F.col("fp"), F.col("fn")))


def lagged(outputs: DataFrame, value: str, row: str = "row_id", stage: str = "stage") -> DataFrame:
    return outputs.withColumn("previous", F.lag(value).over(Window.partitionBy(row).orderBy(stage)))


def transitions(scores: DataFrame, value: str, row: str, stage: str, tolerance: float = 1e-12) -> DataFrame:
    """Per stage how many rows are better, equal or worse than in the stage before."""
    d = F.col(value) - F.col("previous")
    return lagged(scores, value, row, stage).where("previous is not null").groupBy(stage).agg(
        _n(d > tolerance).alias("better"), _n(F.abs(d) <= tolerance).alias("equal"), _n(d < -tolerance).alias("worse")
    )


def carry_forward(stages: DataFrame, value: str, row: str = "row_id", stage: str = "stage") -> DataFrame:
    """The last value so far where a stage has none."""
    upto = Window.partitionBy(row).orderBy(stage).rowsBetween(Window.unboundedPreceding, 0)
    return stages.withColumn("carried", F.last(value, ignorenulls=True).over(upto))


def splits_and_merges(segmented: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """Boundaries that the second segmentation adds and removes."""
    a, b = boundaries(F.col(first)), boundaries(F.col(second))
    sized = segmented.select(*by, F.size(F.array_except(b, a)).alias("s"), F.size(F.array_except(a, b)).alias("m"))
    return sized.groupBy(*by).agg(F.sum("s").cast("long").alias("splits"), F.sum("m").cast("long").alias("merges"))


def boundary_report(segmented: DataFrame, by: list[str], gold: str, made: str) -> DataFrame:
    """Pooled boundary precision, recall and F1, and the mean F1 of sentences."""
    pairs = segmented.select(*by, boundaries(F.col(gold)).alias("g"), boundaries(F.col(made)).alias("m"))
    sums = pairs.groupBy(*by).agg(
        F.sum(F.size(F.array_intersect("g", "m"))).cast("long").alias("hits"), F.sum(F.size("g")).cast("long").alias("n_gold"),
        F.sum(F.size("m")).cast("long").alias("n_made"), F.avg(boundary_f1(F.col("g"), F.col("m"))).alias("mean_f1"),
    )
    return sums.select(
        *by, "hits", "n_gold", "n_made", (F.col("hits") / F.nullif("n_made", F.lit(0))).alias("precision"), (F.col("hits") / F.nullif("n_gold", F.lit(0))).alias("recall"),
        (2 * F.col("hits") / F.nullif(F.col("n_gold") + F.col("n_made"), F.lit(0))).alias("f1"), "mean_f1",
    )


def rank_summary(scores: DataFrame, key: str, stage: str, value: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """For pairs of stages (later, earlier): on how many keys the later wins, ties or loses at two decimals."""
    wide = scores.groupBy(key).pivot(stage, sorted({s for p in pairs for s in p})).agg(F.first(value))
    rows = None
    for late, early in pairs:
        a, b = F.round(F.col(str(late)), 2), F.round(F.col(str(early)), 2)
        one = wide.agg(_n(a > b).alias("wins"), _n(a == b).alias("ties"), _n(a < b).alias("losses")).select(F.lit(late).alias("late"), F.lit(early).alias("early"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def best_stage(scores: DataFrame, key: list[str], stage: str, value: str) -> DataFrame:
    """The earliest of the stages with the highest value."""
    least = F.min(F.struct((-F.col(value)).alias("v"), F.col(stage).alias("s")))
    return scores.groupBy(*key).agg(least.alias("b")).select(*key, F.col("b.s").alias(stage), (-F.col("b.v")).alias(value))


def contrasts(scores: DataFrame, key: list[str], stage: str, value: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """Late less early value for each listed pair of stages."""
    spark = scores.sparkSession
    dim = spark.createDataFrame(pairs, "late int, early int")
    s = scores.select(*key, F.col(stage).alias("st"), F.col(value).alias("v"))
    late = dim.join(s.withColumnRenamed("st", "late").withColumnRenamed("v", "late_value"), "late")
    early = s.withColumnRenamed("st", "early").withColumnRenamed("v", "early_value")
    return late.join(early, [*key, "early"]).withColumn("delta", F.col("late_value") - F.col("early_value"))


def convergence(rows: DataFrame, by: list[str], rounds: list[str]) -> DataFrame:
    """How many rows settle at each round, how many stay open, and how many return to where they were two rounds before.

    A row settles at the first round that equals the one before; it is open if the
    last round differs from the one before.
    """
    settled = F.lit(None).cast("int")
    for k in range(len(rounds) - 1, 0, -1):
        settled = F.when(F.col(rounds[k]) == F.col(rounds[k - 1]), k + 1).otherwise(settled)
    cycles = F.lit(False)
    for k in range(2, len(rounds)):
        cycles = cycles | ((F.col(rounds[k]) == F.col(rounds[k - 2])) & (F.col(rounds[k]) != F.col(rounds[k - 1])))
    open_ = F.col(rounds[-1]) != F.col(rounds[-2])
    marked = rows.select(*by, settled.alias("__at"), open_.alias("__open"), cycles.alias("__cycle"))
    at = [_n(F.col("__at") == k).alias(f"at_{k}") for k in range(2, len(rounds) + 1)]
    return marked.groupBy(*by).agg(F.count("*").alias("n"), *at, _n(F.col("__open")).alias("open"), _n(F.col("__cycle")).alias("two_cycles"))


def long_form(wide: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row for each of ``columns``."""
    return wide.unpivot(keys, columns, name, value)
