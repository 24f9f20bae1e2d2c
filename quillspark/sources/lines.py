"""Lines of text files with their numbers, read in splits: no file is one row, and no text is shuffled to count it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BOM


def _raw(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("place"),
        F.replace("value", F.lit(BOM), F.lit("")).alias("value"),
    )


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, split, n, value)``: n counts a file's lines from 1; byte order marks go.

    A split's lines follow each other within a task, so their numbers are told by
    its first place and the lines of the splits before, a number for each split.
    """
    raw = _raw(spark, path)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = raw.groupBy("file", "split").agg(F.count("*").alias("lines"), F.min("place").alias("first"))
    before = counts.select("file", "split", (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return raw.join(before, ["file", "split"]).select("file", "split", (F.col("place") + F.col("shift")).alias("n"), "value")


def numbered_lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """``(file, n, value)``; lines of nothing but white space are left out unless asked for, and count."""
    rows = split_lines(spark, path).select("file", "n", "value")
    return rows if keep_blank else rows.where("trim(value) <> ''")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, lines)``: what stands between blank lines, counted from 0 in each file.

    A split's lines follow each other within a task, which puts them together as it
    reads them.  Only what reaches over the edge of a split is shuffled, and a row
    for each split tells how many blocks were before it.
    """
    meta = F.col("_metadata")
    raw = spark.read.text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.replace("value", F.lit(BOM), F.lit("")).alias("value")
    ).withColumn("blank", ~F.col("value").rlike(r"\S"))
    runs = raw.mapInArrow(_runs, "file string, split long, k int, head boolean, tail boolean, lines array<string>")
    earlier = Window.partitionBy("file").orderBy("split")
    splits = runs.groupBy("file", "split").agg(F.count_if(F.size("lines") > 0).alias("n"), F.bool_or("head").alias("head"), F.bool_or("tail").alias("tail"))
    splits = splits.withColumn("goes_on", F.col("head") & F.coalesce(F.lag("tail").over(earlier), F.lit(False)))
    starts = F.sum(F.col("n") - F.col("goes_on").cast("int"))
    splits = splits.select(
        "file", "split", "goes_on", F.coalesce(starts.over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.coalesce(F.lead("goes_on").over(earlier), F.lit(False)).alias("is_continued"),
    )
    placed = runs.where(F.size("lines") > 0).join(F.broadcast(splits), ["file", "split"]).select(
        "file", (F.col("before") + F.col("k") - F.col("goes_on").cast("int")).cast("long").alias("block"), "split", "lines",
        ((F.col("head") & F.col("goes_on")) | (F.col("tail") & F.col("is_continued"))).alias("part"),
    )
    met = placed.where("part").groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("split", "lines"))).alias("rows"))
    return placed.where("not part").select("file", "block", "lines").unionByName(met.select("file", "block", F.flatten("rows.lines").alias("lines")))


def _runs(batches):
    """Runs of lines that are not blank: (file, split, k, head, tail, lines), k from 0 in each split.

    head and tail tell whether a run begins or ends with its split.  A split of
    blank lines alone has one row without lines.  What may go on in the next batch
    is kept until that is there.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["file", "split", "k", "head", "tail", "lines"]
    kept, count = None, 0  # lines of the split that was read last which are not told yet, and its runs that are

    def told(rows, count: int, begun: bool, ended: bool):
        """The runs of lines of one split, and how many."""
        full = ~rows.column("blank").to_numpy(zero_copy_only=False)
        edge = np.diff(np.concatenate([[0], full.astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = len(a)
        lines = rows.column("value").filter(pc.invert(rows.column("blank")))
        at = np.append(0, np.cumsum(b - a)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), lines)
        head, tail = (a == 0) & begun, (b == len(full)) & ended
        first = np.zeros(n, np.int64)
        columns = [rows.column("file").take(pa.array(first)), rows.column("split").take(pa.array(first)), pa.array(np.arange(count, count + n, dtype=np.int32)), pa.array(head), pa.array(tail), lists]
        return pa.record_batch(columns, names), n

    def nothing(rows):
        return pa.record_batch([rows.column("file").slice(0, 1), rows.column("split").slice(0, 1), pa.array([0], pa.int32()), pa.array([False]), pa.array([False]), pa.array([[]], pa.list_(pa.string()))], names)

    def whole(rows, count, begun):
        """All that is left of a split."""
        out, n = told(rows, count, begun, True)
        return out if count + n else nothing(rows)

    begun = True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if kept is None else pa.concat_batches([kept, batch])
        file, split = rows.column("file"), rows.column("split").to_numpy()
        other = (split[1:] != split[:-1]) | pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(other) + 1).tolist(), len(split)]
        for a, b in zip(bounds[:-2], bounds[1:-1]):
            yield whole(rows.slice(a, b - a), count, begun)
            count, begun = 0, True
        kept = rows.slice(bounds[-2])
        # a run is told once a blank line follows it; a blank line stays, so what follows it begins no split
        gaps = np.flatnonzero(kept.column("blank").to_numpy(zero_copy_only=False))
        if len(gaps) and gaps[-1] > 0:
            out, n = told(kept.slice(0, int(gaps[-1])), count, begun, False)
            yield out
            kept, count, begun = kept.slice(int(gaps[-1])), count + n, False
    if kept is not None and kept.num_rows:
        yield whole(kept, count, begun)
