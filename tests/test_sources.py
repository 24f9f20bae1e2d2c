import json
import random
import re
import uuid
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import correct, segmentation
from quillspark.sources import datasets


def refs(df):
    return [(r.source, r.refs) for r in df.orderBy("id").collect()]


def test_operation_language():
    ops = [{"Modify": [{"pos": 0, "tag": "MOD_2", "label": ["缩小", "缩减"]}]}]
    assert [datasets.apply_operation("降低了适应症范围", o) for o in datasets.expand_labels(ops)] == ["缩小了适应症范围", "缩减了适应症范围"]
    assert datasets.apply_operation("abcd", {"Switch": [1, 0, 2, 3], "Delete": [3]}) == "bac"
    assert datasets.apply_operation("abc", {"Insert": [{"pos": -1, "tag": "IH", "label": "x"}, {"pos": 1, "tag": "INS_1", "label": "y"}]}) == "xabyc"
    assert datasets.apply_operation("abc", {"Modify": [{"pos": 1, "tag": "MOD_2+INS_1", "label": "zzz"}]}) == "azzz"


def test_adapters(spark, tmp_path):
    m2 = "S 57 ##1 亿\nT0-A0 没有错误\nT1-A0 57 ##2 亿\nT1-A1 57 ##2 亿\nA 0 1|||R|||x|||-|||-|||0\n\nS # #\n"
    (tmp_path / "a.m2").write_text("﻿" + m2)
    assert refs(datasets.from_m2(spark, str(tmp_path / "a.m2"), continued=True)) == [("571亿", ["571亿", "572亿"]), ("##", ["##"])]
    (tmp_path / "y.jsonl").write_text(json.dumps({"sentence_text": "a", "sentence_annos": [{"correction": "b", "is_grammatical": 1}, {"correction": "c", "is_grammatical": 0}]}) + "\n")
    assert refs(datasets.from_annotated_jsonl(spark, str(tmp_path / "y.jsonl"))) == [("a", ["b"])]
    (tmp_path / "f.json").write_text(json.dumps({"1": {"source": "a", "target": "b"}, "2": {"source": "c", "target": ""}}))
    assert refs(datasets.from_pairs_json(spark, str(tmp_path / "f.json"))) == [("a", ["b"]), ("c", ["c"])]
    (tmp_path / "c.json").write_text(json.dumps([{"sent": "a", "revisedSent": "b"}]))
    assert refs(datasets.from_pairs_json(spark, str(tmp_path / "c.json"), "sent", "revisedSent", keyed=False)) == [("a", ["b"])]
    (tmp_path / "p.para").write_text("1\ta\tb\tb\tc\n2\td\n")
    assert refs(datasets.from_parallel(spark, str(tmp_path / "p.para"))) == [("a", ["b", "c"]), ("d", ["d"])]
    rows = {"x": {"sentence": "ab", "error_flag": 1, "operation": '[{"Delete": [0]}]'}, "y": {"sentence": "ok", "error_flag": 0, "operation": ""}}
    (tmp_path / "o.json").write_text(json.dumps(rows))
    prepared = datasets.from_operations(spark, str(tmp_path / "o.json"))
    assert refs(prepared) == [("ab", ["b"]), ("ok", ["ok"])]
    datasets.write_prepared(prepared, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out" / "gold.para")).collect()) == ["1\tab\tb", "2\tok\tok"]


def test_segmentations(spark, tmp_path):
    table = spark.createDataFrame([(1, "我爱饭", 0, "我爱吃饭"), (1, "我爱饭", 1, "我爱米饭"), (1, "我爱饭", 2, "我爱饭"), (2, "甲乙", 0, "甲丙"), (2, "甲乙", 1, "丁乙")], "id int, source string, ref_id int, ref string")
    assert {r.id: (r.ref_id, r.distance) for r in segmentation.closest_reference(table, ["id"]).collect()} == {1: (2, 0), 2: (0, 1)}
    pair = spark.createDataFrame([("研究生 命", "研究 生命")], "t string, s string")
    assert pair.select(segmentation.project("t", "s").alias("p")).first().p == "研究生 命"
    row = (0, "1", "甲乙", 0, "甲乙", "甲乙", 0, "甲乙", "甲乙", "甲 乙")
    segmentation.write_fixed(spark.createDataFrame([row], segmentation.FIXED), str(tmp_path / "f"))
    assert segmentation.load_fixed(spark, str(tmp_path / "f")).count() == 1
    segmentation.write_fixed(spark.createDataFrame([(1, *row[1:])], segmentation.FIXED), str(tmp_path / "g"))
    with pytest.raises(ValueError, match="gaps"):
        segmentation.load_fixed(spark, str(tmp_path / "g"))


def test_calls(spark):
    def make():
        tried = []

        def say(prompt):
            tried.append(prompt)
            if "flaky" in prompt and tried.count(prompt) < 2:
                raise RuntimeError("busy")
            if "down" in prompt:
                raise RuntimeError("down")
            if "filter" in prompt:
                raise correct.ContentFiltered
            if "blank" in prompt and "只输出" not in prompt:
                return "  "
            if "mute" in prompt:
                return ""
            return "修改后：" + prompt.rsplit("句子如下：", 1)[-1].upper()

        return say

    prompts = spark.createDataFrame([(k, f"句子如下：{w}") for k, w in enumerate(("plain", "flaky", "down", "filter", "blank", "mute"))], "id long, prompt string")
    got = {r.id: r for r in correct.accepted(correct.call(prompts, make)).collect()}
    assert (got[0].correction, got[0].ok, got[0].attempts) == ("PLAIN", True, 1) and (got[1].correction, got[1].attempts) == ("FLAKY", 2)
    assert got[4].ok and got[4].attempts == 2 and not got[5].ok and got[5].attempts == 3 and "format" in got[5].error
    assert not got[2].ok and "down" in got[2].error and (got[3].correction, got[3].fallback) == ("filter", True)


def test_rounds_ask_once(spark, tmp_path):
    from quillspark.operators import iterate

    log = tmp_path / "asked"
    log.mkdir()

    @F.pandas_udf("string")
    def noisy(text: pd.Series, segmented: pd.Series) -> pd.Series:
        for t in text:
            (log / uuid.uuid4().hex).write_text(t)
        return text.str.lower() + " " + str(uuid.uuid4().int % 7)

    rows = spark.createDataFrame([(k, f"A B {k}") for k in range(6)], "id long, source string")
    done = iterate.run_rounds(rows, noisy, lambda t: t, rounds=3)
    first, again = done.orderBy("id").collect(), done.orderBy("id").collect()
    assert first == again
    asked = Counter(p.read_text() for p in log.iterdir())
    for r in first:
        assert asked[r.source] == {2: 1, 3: 2, None: 3}[r.converged_at]
    attempts = iterate.repair(rows, lambda todo, k: todo.withColumn("k", F.lit(k)), lambda made: made.where("id % 3 <= k"), "id")
    assert {r.id: r.k for r in attempts.collect()} == {k: k % 3 for k in range(6)}
    assert iterate.repair(rows.limit(0), lambda todo, k: todo, lambda made: made, "id").count() == 0


def test_blocks_do_not_hang_on_splits(spark, tmp_path):
    from quillspark.sources import lines, m2

    rng = random.Random(4)
    text = "".join(rng.choice(["\n", " \n", "S a b\n", "A 0 1|||R|||x|||REQUIRED|||NONE|||0\n", "T1 longer line of some words here\n"]) for _ in range(4000))
    (tmp_path / "x.m2").write_text("\ufeff" + text)
    want = [[x for x in b.split("\n") if x.strip()] for b in re.split(r"\n(?:[^\S\n]*\n)+", text.replace("\r", "\n"))]
    want = [b for b in want if b]
    for size in ("128m", "1k", "137"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = {r.block: r.lines for r in lines.blocks(spark, str(tmp_path / "x.m2")).collect()}
            assert [got[k] for k in range(len(got))] == want
            numbers = {r.n: r.value for r in lines.numbered_lines(spark, str(tmp_path / "x.m2"), keep_blank=True).collect()}
            assert [numbers[k + 1] for k in range(len(numbers))] == text.split("\n")[: len(numbers)] and len(numbers) >= text.count("\n")
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "bad.m2").write_text("S a b\nA 0 9|||R|||x|||REQUIRED|||NONE|||0\n\nA 0 1|||R|||x|||REQUIRED|||NONE|||0\n\nS a\nwhat\nA 0 1|||R\n")
    blocks = m2.scan(spark, str(tmp_path / "bad.m2"))
    assert sorted((r.block, r.problem) for r in m2.violations(blocks).collect()) == [(0, "a span outside the source"), (1, "a block must begin with its source"), (2, "an unknown line"), (2, "not an M2 edit")]
    assert m2.violations(blocks, strict=False).count() == 3


def test_tables_that_break_a_rule(spark, tmp_path):
    from quillspark.operators import reports
    from quillspark.sources import tables

    (tmp_path / "p.tsv").write_text('\ufeffa "b\t"c ""d"" e"\n\nf\tg\th\n')
    assert [(r.id, r.source_tokens, r.targets) for r in tables.read_pairs_tsv(spark, str(tmp_path / "p.tsv")).orderBy("id").collect()] == [("1", ["a", '"b'], [["c", '"d"', "e"]]), ("3", ["f"], [["g"], ["h"]])]
    (tmp_path / "q.tsv").write_text("only one\n")
    with pytest.raises(Exception, match="a source and a target are expected in line 1"):
        tables.read_pairs_tsv(spark, str(tmp_path / "q.tsv")).collect()
    (tmp_path / "m.json").write_text('{"name": "a", "run": "x"}\n{"name": "a", "run": "y"}\n')
    with pytest.raises(ValueError, match="names repeat"):
        tables.read_manifest(spark, str(tmp_path / "m.json"), "name string, run string")
    assert reports.latex_escape("50% of a_b") == r"50\% of a\_b"
    shown = reports.markdown_table(spark.createDataFrame([("x|y", 1.5, None)], "a string, b double, c string"))
    assert shown.split("\n")[2] == "| x\\|y | 1.50 |  |"
    with pytest.raises(ValueError, match="at most 1"):
        reports.markdown_table(spark.range(3), limit=1)


def test_run_tables_keep_quotes(spark, tmp_path):
    from quillspark.sources import tables

    cells = ["1", 'say "x"', 'a\\b "', '"q"', "t", "", "t1", "s", "t2", "s", "t3"][:10]
    (tmp_path / "run.tsv").write_text("id\tsource\ttarget\tS1\tT0\tT1\tS2\tT2\tS3\tT3\n" + "\t".join('"' + c.replace('"', '""') + '"' for c in cells) + "\n")
    row = tables.read_run(spark, str(tmp_path / "run.tsv")).first()
    assert (row.id, row.source, row.target, row.S1) == (1, 'say "x"', 'a\\b "', '"q"')
