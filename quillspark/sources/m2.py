"""M2 files: scan, parse and render.

A block is the lines between blank lines: ``S`` source, then ``A start
end|||type|||correction|||required|||comment|||annotator``, and in some files
``T<coder>[-A<alternative>] target``.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import kernels
from .lines import blocks as text_blocks

IDENTITY = "没有错误"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, lines)``: blocks counted from 0; marks, CRLF and repeated blank lines are tolerated."""
    return text_blocks(spark, path)


def violations(blocks: DataFrame, strict: bool = True) -> DataFrame:
    """``(file, block, line, problem)`` of what makes a file no M2 file.

    Loose reading lets lines pass that are neither S, A nor T lines, and blocks without annotation.
    Spans are looked at in blocks whose lines are right.
    """
    return blocks.select("file", "block", F.explode(_problems(strict)("lines")).alias("p")).select("file", "block", "p.line", "p.problem")


_KNOWN, _SOURCE = re.compile(r"S( |$)|A |T[0-9]+(-A[0-9]+)?\s"), re.compile("S( |$)")


def _problems_of(lines: list[str], strict: bool) -> list[dict]:
    found = []
    for pos, line in enumerate(lines):
        if not pos and not _SOURCE.match(line):
            found.append((line, "a block must begin with its source"))
        elif pos and _SOURCE.match(line):
            found.append((line, "a second source"))
        elif line.startswith("A ") and not _LINE.fullmatch(line):
            found.append((line, "not an M2 edit"))
        elif strict and not _KNOWN.match(line):
            found.append((line, "an unknown line"))
    if not found:
        m = len(_source_of(lines) or [])
        spans = [(e["s0"], e["s1"]) for e in _edits_of(lines) if e["kind"] != "noop"]
        found = [(f"A {a} {b}", "a span outside the source") for a, b in spans if a < 0 or b < a or b > m]
    return [{"line": line, "problem": problem} for line, problem in found]


def _problems(strict: bool):
    @F.arrow_udf("array<struct<line: string, problem: string>>")
    def run(lines):
        import pyarrow as pa

        return pa.array([_problems_of(x, strict) for x in lines.to_pylist()], pa.list_(pa.struct([("line", pa.string()), ("problem", pa.string())])))

    return run


def _source_of(lines: list[str]) -> list[str] | None:
    line = next((x for x in lines if x.startswith("S ") or x == "S"), None)
    return None if line is None else line[1:].split()


def _edits_of(lines: list[str]) -> list[dict]:
    """The edits of a block's A lines in order; a line that is none fails."""
    out = []
    for pos, line in enumerate(lines):
        if line.startswith("A "):
            m = _LINE.fullmatch(line)
            if m is None:
                raise ValueError(f"not an M2 edit: {line}")
            s0, s1, kind, words, required, comment, annotator = m.groups()
            correction = [] if words == "-NONE-" else [w for w in words.split(" ") if w]
            out.append({"annotator": int(annotator), "pos": pos, "s0": int(s0), "s1": int(s1), "kind": kind, "correction": correction, "required": required, "comment": comment})
    return out


_PARSED = "annotator: int, pos: int, s0: int, s1: int, kind: string, correction: array<string>, required: string, comment: string"


def parsed(lines: str) -> Column:
    """A block's lines -> its edits."""
    return F.arrow_udf(_parsed_arrow, f"array<struct<{_PARSED}>>")(lines)


def _parsed_arrow(lines):
    import pyarrow as pa

    every = [_edits_of(x) for x in lines.to_pylist()]
    flat, at, words = [e for es in every for e in es], [0], [0]
    for es in every:
        at.append(at[-1] + len(es))
    for e in flat:
        words.append(words[-1] + len(e["correction"]))
    column = lambda c, kind: pa.array([e[c] for e in flat], kind)
    corrections = pa.ListArray.from_arrays(pa.array(words, pa.int32()), pa.array([w for e in flat for w in e["correction"]], pa.string()))
    fields = {c: column(c, pa.int32()) for c in ("annotator", "pos", "s0", "s1")} | {"kind": column("kind", pa.string()), "correction": corrections}
    fields |= {c: column(c, pa.string()) for c in ("required", "comment")}
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def _targets_arrow(lines):
    import pyarrow as pa

    out = []
    for block in lines.to_pylist():
        by: dict[int, list] = {}
        for e in _edits_of(block):
            by.setdefault(e["annotator"], []).extend([e] if e["kind"] != "noop" else [])
        source = _source_of(block)
        if source is None and by:
            raise ValueError("a block without a source")
        made = {k: kernels.apply_edits(source, [kernels.Edit(e["s0"], e["s1"], 0, 0, e["kind"], tuple(e["correction"])) for e in es]) for k, es in by.items()}
        out.append([{"annotator": k, "target": t} for k, t in made.items()])
    return pa.array(out, pa.list_(pa.struct([("annotator", pa.int32()), ("target", pa.list_(pa.string()))])))


def rebuilt_targets(blocks: DataFrame) -> DataFrame:
    """``(file, block, annotator, target)``: every annotator's target, from the source and its edits, within the block's row."""
    return blocks.select("file", "block", F.explode(F.arrow_udf(_targets_arrow, "array<struct<annotator: int, target: array<string>>>")("lines")).alias("t")).select("file", "block", "t.annotator", "t.target")


def audit(blocks: DataFrame) -> DataFrame:
    """``(metric, value)``: blocks, edits, noops, T lines, blocks by their number of annotators, and per label its edits and blocks.

    A block is counted in its row; what is shuffled are a batch's sums.
    """

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            n = Counter()
            for lines in batch.column("lines").to_pylist():
                es = _edits_of(lines)
                kinds = Counter(e["kind"] for e in es)
                n["noops"] += kinds.pop("noop", 0)
                n["edits"] += sum(kinds.values())
                n["targets"] += sum(_TARGET.match(x) is not None for x in lines)
                n["blocks"] += 1
                if es:
                    n[f"blocks with {len({e['annotator'] for e in es})} annotators"] += 1
                for kind, k in kinds.items():
                    n[f"edits with {kind}"] += k
                    n[f"blocks with {kind}"] += 1
            yield pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["metric", "value"])

    always = blocks.sparkSession.createDataFrame([(m, 0) for m in ("blocks", "edits", "noops", "targets")], "metric string, value long")
    return blocks.select("lines").mapInArrow(counted, "metric string, value long").unionByName(always).groupBy("metric").agg(F.sum("value").alias("value"))


_TARGET = re.compile("T[0-9]+")


def labels(lines: Column) -> Column:
    """The edit types named in a block's lines, each once, in order; noop is none."""
    said = F.transform(F.filter(lines, lambda x: x.startswith("A ")), lambda x: F.split_part(x, F.lit("|||"), F.lit(2)))
    return F.array_sort(F.array_distinct(F.filter(said, lambda k: k != "noop")))


def surface_pair(lines: Column) -> Column:
    """struct<source, label, correction> of a block's first edit line; null without one."""
    first = F.get(F.filter(lines, lambda x: x.startswith("A ") & ~x.contains("|||noop|||")), F.lit(0))
    span = F.split(F.substring(F.split_part(first, F.lit("|||"), F.lit(1)), 3, 1 << 30), " ")
    words = tokens(F.substring(F.get(F.filter(lines, lambda x: x.startswith("S ")), F.lit(0)), 3, 1 << 30))
    left = F.slice(words, span[0].cast("int") + 1, span[1].cast("int") - span[0].cast("int"))
    made = F.struct(F.array_join(left, " ").alias("source"), F.split_part(first, F.lit("|||"), F.lit(2)).alias("label"), F.split_part(first, F.lit("|||"), F.lit(3)).alias("correction"))
    return F.when(first.isNotNull(), made)


def sources(blocks: DataFrame) -> DataFrame:
    """``(file, block, source)``: the tokens of each S line."""
    line = F.get(F.filter("lines", lambda x: x.startswith("S ") | (x == "S")), F.lit(0))
    return blocks.select("file", "block", tokens(F.substring(line, 2, F.length(line))).alias("source"))


#: Fields of an A line.  Only the correction may hold bars, so it takes all that the other fields leave.
_LINE = re.compile(r"A (-?\d+) (-?\d+)\|\|\|(.*?)\|\|\|(.*)\|\|\|([^|]*)\|\|\|([^|]*)\|\|\|(-?\d+)", re.ASCII)


def edits(blocks: DataFrame) -> DataFrame:
    """One row per A line; a noop keeps (-1, -1).  Lines with other than six fields fail."""
    return blocks.select("file", "block", F.explode(parsed("lines")).alias("e")).select("file", "block", "e.*")


def targets(blocks: DataFrame) -> DataFrame:
    """``(file, block, coder, alternative, target)`` of T lines; the identity mark stands for the source."""
    rows = blocks.select("file", "block", F.explode("lines").alias("line"), "lines").where(r"line rlike '^T[0-9]+'")
    pattern = r"^T(\d+)(?:-A(\d+))?\s+(.*)$"
    source = F.get(F.filter("lines", lambda x: x.startswith("S ")), F.lit(0))
    said = F.trim(F.regexp_extract("line", pattern, 3))
    return rows.select(
        "file", "block", F.regexp_extract("line", pattern, 1).cast("int").alias("coder"), F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")).cast("int").alias("alternative"),
        F.when(said == IDENTITY, F.trim(F.substring(source, 3, 1 << 30))).otherwise(said).alias("target"),
    )


def edit_line(s0: Column, s1: Column, kind: Column, correction: Column, annotator: Column, comment: Column | None = None) -> Column:
    words = F.when(F.size(correction) == 0, "-NONE-").otherwise(F.array_join(correction, " "))
    span = F.concat_ws(" ", F.lit("A"), s0.cast("string"), s1.cast("string"))
    return F.concat_ws("|||", span, kind, words, F.lit("REQUIRED"), comment if comment is not None else F.lit("NONE"), annotator.cast("string"))


def noop_line(annotator: Column) -> Column:
    return F.concat(F.lit("A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||"), annotator.cast("string"))


def render(source_rows: DataFrame, annotators: DataFrame, edit_rows: DataFrame, key: str) -> DataFrame:
    """``(key, block)``: S line, then each annotator's edits in order, or its noop.

    source_rows (key, source), annotators (key, annotator), edit_rows (key,
    annotator, pos, s0, s1, kind, correction, comment).
    """
    lines = edit_rows.select(key, "annotator", "pos", edit_line(*[F.col(c) for c in ("s0", "s1", "kind", "correction", "annotator", "comment")]).alias("line"))
    full = annotators.join(lines, [key, "annotator"], "left").select(
        key, "annotator", F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce("line", noop_line(F.col("annotator"))).alias("line")
    )
    met = full.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("annotator", "pos", "line"))).alias("rows"))
    head = F.rtrim(F.concat(F.lit("S "), F.array_join("source", " ")))
    return source_rows.join(met, key).select(key, F.concat_ws("\n", head, F.array_join("rows.line", "\n")).alias("block"))


def rendered(source, annotators, edits: dict):
    """The blocks of a batch as Arrow strings.

    ``source`` has each row's text, ``annotators`` is (rows, annotators) of all that
    annotate, ``edits`` has Arrow columns: row, annotator and pos by which its edits
    are sorted, s0, s1, kind, correction (as a text) and comment.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    text = lambda x: pc.cast(x, pa.string())
    row, by, pos = (pc.cast(edits[c], pa.int64()).to_numpy() for c in ("row", "annotator", "pos"))
    words = pc.if_else(pc.equal(edits["correction"], ""), "-NONE-", edits["correction"])
    span = pc.binary_join_element_wise("A", text(edits["s0"]), text(edits["s1"]), " ")
    lines = pc.binary_join_element_wise(span, edits["kind"], words, "REQUIRED", edits["comment"], text(edits["annotator"]), "|||")
    rows, every = (np.asarray(x, np.int64) for x in annotators)
    size = int(every.max(initial=0)) + 1
    none = ~np.isin(rows * size + every, row * size + by)
    noops = pc.binary_join_element_wise("A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||", text(pa.array(every[none])), "")
    row, by, pos = np.append(row, rows[none]), np.append(by, every[none]), np.append(pos, np.full(int(none.sum()), -1))
    heads = pc.utf8_rtrim(pc.binary_join_element_wise("S ", source, ""), " ")
    order = np.lexsort((pos, by, row))
    at = np.append(0, np.cumsum(np.bincount(row, minlength=len(source)))).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(at), pa.concat_arrays([lines, noops]).take(pa.array(order)))
    return pc.binary_join_element_wise(heads, pc.binary_join(listed, "\n"), "\n")


def write(blocks: DataFrame, path: str, key: str | None, files: int | None = None) -> None:
    """Blocks in key order, a blank line after each; ``files`` 1 makes a single file.

    Without a key blocks are written where they are, in the order that they have.
    """
    if key is None:
        blocks.select(F.concat("block", F.lit("\n")).alias("value")).write.mode("errorifexists").text(path)
        return
    parts = files or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = blocks.repartitionByRange(parts, key).sortWithinPartitions(key)
    ordered.select(F.concat("block", F.lit("\n")).alias("value")).write.mode("errorifexists").text(path)
