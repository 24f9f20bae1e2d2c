"""Fixed source segmentations: the nearest reference's boundaries carried over to the source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import detokenize, normalize_text
from . import kernels
from .audit import expect_none

FIXED = (
    "row_index long, item_id string, source string, selected_reference_index int, selected_reference string, selected_reference_normalized string, "
    "levenshtein_distance int, source_ltp string, selected_reference_ltp string, fixed_source_segmentation string"
)


def closest_within(source: Column, refs: Column) -> Column:
    """struct<distance, ref_id, ref> of the nearest of ``refs`` (array<struct<ref_id, ref>>), the first among equals."""
    near = F.transform(refs, lambda r: F.struct(F.levenshtein(normalize_text(source), normalize_text(r["ref"])).alias("distance"), r["ref_id"].alias("ref_id"), r["ref"].alias("ref")))
    return F.array_min(near)


def closest_reference(refs: DataFrame, keys: list[str], source: str = "source", ref: str = "ref", ref_id: str = "ref_id") -> DataFrame:
    """The reference at the least character distance, the first among equals."""
    distance = F.levenshtein(normalize_text(F.col(source)), normalize_text(F.col(ref)))
    near = refs.groupBy(*keys).agg(F.min(F.struct(distance.alias("distance"), F.col(ref_id).alias("ref_id"), F.col(ref).alias("ref"))).alias("m"))
    return near.select(*keys, "m.ref_id", "m.distance", "m.ref")


@F.pandas_udf(T.StringType())
def project(target_segmented: pd.Series, source_segmented: pd.Series) -> pd.Series:
    """The source's segmentation after that of an edited text is carried over by exact anchors."""
    out = []
    for t, s in zip(target_segmented, source_segmented):
        target, source = t.split(), s.split()
        text = "".join(source)
        same = kernels.lcs_anchors(list(text), list("".join(target)))
        base = {end - 1 for _, end in kernels.token_spans(source)}
        out.append(kernels.segmented(text, kernels.project_boundaries(text, base, target, same, same)[0]))
    return pd.Series(out)


def write_fixed(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").csv(path, sep="\t", header=True)


def load_fixed(spark, path: str) -> DataFrame:
    """Fixed segmentations; gaps in row_index and texts that a segmentation changes fail."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=FIXED)
    bounds = rows.agg(F.count("*").alias("n"), F.count_distinct("row_index").alias("d"), F.min("row_index").alias("a"), F.max("row_index").alias("z"))
    expect_none(bounds.where("n > 0 and (a <> 0 or z <> n - 1 or d <> n)"), "row_index has gaps")
    expect_none(rows.where(detokenize(F.col("fixed_source_segmentation")) != normalize_text(F.col("source"))), "segmentation changes the text")
    return rows
