"""Adapters from published correction corpora to ``(id, source, refs)``.

ids count from 1 in file order.  Cells are cleaned, references made distinct in
order; a source without one is its own reference.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BOM, clean_cell, detokenize, ordered_unique
from . import m2
from .lines import numbered_lines


def _prepared(rows: DataFrame, refs: Column) -> DataFrame:
    source = clean_cell(F.col("source"))
    found = ordered_unique(F.coalesce(refs, F.array().cast("array<string>")))
    return rows.select("id", source.alias("source"), F.when(F.size(found) > 0, found).otherwise(F.array(source)).alias("refs"))


def from_m2(spark: SparkSession, path: str, continued: bool = False) -> DataFrame:
    """Targets of T lines, coders and alternatives in file order; ``continued`` joins ## pieces."""
    blocks = m2.scan(spark, path)
    pattern = r"^T\d+(?:-A\d+)?\s+(.*)$"
    line = F.get(F.filter("lines", lambda x: x.startswith("S ")), F.lit(0))
    source = detokenize(F.substring(line, 3, 1 << 30), continued)
    said = F.transform(F.filter("lines", lambda x: x.rlike(r"^T\d+")), lambda x: F.trim(F.regexp_extract(x, pattern, 1)))
    rows = blocks.select((F.col("block") + 1).alias("id"), source.alias("source"), said.alias("said"))
    refs = F.transform("said", lambda x: F.when(x == m2.IDENTITY, F.col("source")).otherwise(detokenize(x, continued)))
    return _prepared(rows, refs)


def from_annotated_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One sentence a line with annotations; corrections for grammar alone are references."""
    schema = "sentence_text string, sentence_annos array<struct<correction: string, is_grammatical: int>>"
    rows = _numbered_lines(spark, path).select("id", F.from_json("value", schema).alias("r"))
    kept = F.filter("r.sentence_annos", lambda a: a["is_grammatical"] == 1)
    return _prepared(rows.select("id", F.col("r.sentence_text").alias("source"), kept.alias("a")), F.col("a.correction"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file with their number from 1."""
    return numbered_lines(spark, path).select(F.col("n").alias("id"), "value")


def _json_values(spark: SparkSession, path: str, value: str, keyed: bool) -> DataFrame:
    """Entries of one JSON document, an object of records or a list of them, in order."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.map_values(F.from_json("value", f"map<string, {value}>")) if keyed else F.from_json("value", f"array<{value}>")
    return whole.select(F.posexplode(entries).alias("n", "r")).select((F.col("n") + 1).cast("long").alias("id"), "r.*")


def from_pairs_json(spark: SparkSession, path: str, source: str = "source", target: str = "target", keyed: bool = True) -> DataFrame:
    rows = _json_values(spark, path, f"struct<`{source}`: string, `{target}`: string>", keyed)
    return _prepared(rows.select("id", F.col(source).alias("source"), F.col(target).alias("t")), F.array("t"))


def from_parallel(spark: SparkSession, path: str) -> DataFrame:
    """Lines of number, source and references, tab-separated."""
    cells = F.split("value", "\t")
    rows = _numbered_lines(spark, path).select("id", cells[1].alias("source"), F.slice(cells, F.lit(3), F.greatest(F.size(cells) - 2, F.lit(0))).alias("r"))
    return _prepared(rows, F.col("r"))


def expand_labels(operations: list[dict]) -> list[dict]:
    """From the first operation whose labels are lists on, one operation for each item and label."""
    out, listed = [], False
    for op in operations:
        listed = listed or any(op.get(k) and isinstance(op[k][0]["label"], list) for k in ("Insert", "Modify"))
        if not listed:
            out.append(op)
            continue
        out += [{k: [{**item, "label": label}]} for k in ("Insert", "Modify") for item in op.get(k, []) for label in item["label"]]
    return out


def apply_operation(sentence: str, op: dict) -> str:
    """The sentence after one operation: reorder, then delete, insert and modify by place."""
    chars = [sentence[i] for i in op["Switch"]] if "Switch" in op else list(sentence)
    # what each place turns into: (text, places it takes up, text for the front of the sentence)
    slots: dict[int, tuple[str, int, str]] = {i: ("", 1, "") for i in op.get("Delete", [])}
    front = []
    for item in op.get("Insert", []):
        if item["pos"] == -1:
            front.append(item["label"])
        elif item["tag"].startswith("INS"):
            slots[item["pos"]] = (chars[item["pos"]] + item["label"], 1, "")
        else:
            slots[item["pos"]] = ("", 1, item["label"])
    for item in op.get("Modify", []):
        taken = int(item["tag"].split("+")[0].rpartition("_")[2])
        slots[item["pos"]] = (item["label"], max(1, taken), "")
    body, at = "", 0
    while at < len(chars):
        text, taken, lead = slots.get(at, (chars[at], 1, ""))
        body, at = lead + body + text, at + taken
    for label in front:
        body = label + body
    return body


@F.pandas_udf(T.ArrayType(T.StringType()))
def operation_targets(sentence: pd.Series, operations: pd.Series) -> pd.Series:
    """Distinct results of a JSON list of operations, each applied to the sentence by itself."""
    return pd.Series([list(dict.fromkeys(apply_operation(s, op) for op in expand_labels(json.loads(o)))) for s, o in zip(sentence, operations)])


def from_operations(spark: SparkSession, path: str) -> DataFrame:
    """Records with an operation language; sentences without an error are their own reference."""
    rows = _json_values(spark, path, "struct<sentence: string, error_flag: int, operation: string>", keyed=True)
    wrong = F.col("error_flag") == 1
    made = operation_targets(F.col("sentence"), F.when(wrong, F.col("operation")).otherwise(F.lit("[]")))
    staged = rows.select("id", F.col("sentence").alias("source"), wrong.alias("wrong"), made.alias("made"))
    checked = F.when(F.col("wrong") & (F.size("made") == 0), F.raise_error(F.lit("operations made no reference")).cast("array<string>")).otherwise(F.col("made"))
    return _prepared(staged, F.when(F.col("wrong"), checked).otherwise(F.array("source")))


def write_prepared(prepared: DataFrame, path: str) -> None:
    """``gold.para`` (id, source, references) and ``pipeline.tsv`` (source, first reference) under ``path``."""
    ordered = prepared.repartitionByRange(int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id")
    ordered.select(F.concat_ws("\t", F.col("id").cast("string"), "source", F.array_join("refs", "\t")).alias("value")).write.mode("errorifexists").text(f"{path}/gold.para")
    ordered.select(F.concat_ws("\t", "source", F.col("refs")[0]).alias("value")).write.mode("errorifexists").text(f"{path}/pipeline.tsv")


def sanitize_m2(spark: SparkSession, path: str, out: str) -> None:
    """A copy without the byte order marks that joined shards leave."""
    spark.read.text(path).select(F.replace("value", F.lit(BOM), F.lit("")).alias("value")).write.mode("errorifexists").text(out)
