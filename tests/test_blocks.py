"""Blocks of files that are read in small splits, against the lines read in Python; M2 within rows."""

import random
import re

import pytest

from quillspark.sources import lines, m2


@pytest.mark.parametrize("seed", range(4))
def test_blocks_over_the_edges_of_splits(spark, tmp_path, seed):
    rng, want = random.Random(seed), {}
    (tmp_path / "in").mkdir()
    for name in ("a", "b", "c"):
        parts = [rng.choice(["\n", "  \t\n", "\r\n"]) if rng.random() < (0.05 if name == "c" else 0.4) else "x" * rng.randrange(1, 30) + rng.choice(["\n", "\r\n"]) for _ in range(400)]
        text = "﻿" * (name == "a") + "".join(parts) + rng.choice(["", "end"])
        (tmp_path / "in" / name).write_bytes(text.encode())
        rows = re.split("\r\n|\n", text.lstrip("﻿"))
        blocks, now = [], []
        for row in [*rows, ""]:
            if row.strip():
                now.append(row)
            elif now:
                blocks, now = [*blocks, now], []
        want |= {(name, k): b for k, b in enumerate(blocks)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97b", "1500b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for rows_ in ("3", "10000"):
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_)
                got = lines.blocks(spark, str(tmp_path / "in")).collect()
                assert len(got) == len(want) and {(r.file.rsplit("/", 1)[1], r.block): r.lines for r in got} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_and_their_edits_are_not_shuffled(spark, tmp_path):
    (tmp_path / "t.m2").write_text("S a b\nA 0 1|||R|||x|||REQUIRED|||NONE|||0\n\n" * 50)
    blocks = m2.scan(spark, str(tmp_path / "t.m2"))
    for df in (m2.rebuilt_targets(blocks), m2.edits(blocks), m2.violations(blocks)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 2 and "collect_list(struct(split" in plan and plan.count("collect_list") == 1


def test_what_is_no_m2_file(spark, tmp_path):
    (tmp_path / "t.m2").write_text("A 0 1|||R|||x|||REQUIRED|||NONE|||0\n\nS a\nS b\nodd\n\nS a\nA 0 2|||R|||x|||REQUIRED|||NONE|||0\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||1\n\nS a\nA 0|||R\n")
    got = lambda strict: sorted((r.block, r.line, r.problem) for r in m2.violations(m2.scan(spark, str(tmp_path / "t.m2")), strict).collect())
    want = [
        (0, "A 0 1|||R|||x|||REQUIRED|||NONE|||0", "a block must begin with its source"), (1, "S b", "a second source"), (1, "odd", "an unknown line"),
        (2, "A 0 2", "a span outside the source"), (3, "A 0|||R", "not an M2 edit"),
    ]
    assert got(True) == want and got(False) == [w for w in want if w[1] != "odd"]
