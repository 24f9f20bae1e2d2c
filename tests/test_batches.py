"""What is made and scored in batches, against the SQL and the operators that do it row by row."""

import numpy as np
import pytest

from quillspark.operators import score
from quillspark.plans import queries, report_queries, synth  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(synth.TABLES))
def test_batches_make_the_tables_of_the_sql(spark, tmp_path, name):
    texts = [(1, "a b\tc  d\r\ne é Ä f g h i j k l m n o p q", "en"), (2, None, "en"), (3, " \n", "de"), (4, "x", "fr"), (10, "Ab aB ab AB ab   Ab x y", "de"), (None, "a B c", "es"), (11, "", None), (33, "one two three. " * 40, None)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    want = synth.sql_view(spark, str(tmp_path), name)
    got = synth.view(spark, str(tmp_path), name).select(*want.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_batches_score_like_arrays(spark):
    nested = synth.sql_view(spark, SF, "nested").where("row_id % 7 = 0")
    keyed = lambda c, key: queries.F.transform(c, lambda x: queries.F.struct(x[key].alias(key), score.keyed_edits(x["edits"]).alias("edits")))
    rows = nested.select("row_id", keyed("refs", "ref_id").alias("refs"), queries.F.explode(keyed("outputs", "stage")).alias("o"))
    best = rows.select("row_id", "o.stage", queries.F.array_min(score.candidate_array(queries.F.col("o.edits"), queries.F.col("refs"))).alias("c")).select("row_id", "stage", "c.ref_id", "c.tp", "c.fp", "c.fn", "c.f")
    got = queries._best(spark, SF).where("row_id % 7 = 0").select(*best.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, best.collect()))


@pytest.mark.parametrize("name", ["micro_f05_by_stage", "edit_match_full_outer", "bootstrap_bca", "conversion_statistics", "scores_recomputed", "readable_edits"])
def test_edits_are_neither_made_by_lambdas_nor_shuffled(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan or name == "conversion_statistics"
    assert "Join" not in plan or name == "scores_recomputed"


def test_best_of_prefers_in_order():
    one = lambda *x: (np.array([x[0]], bool), *(np.array([v]) for v in x[1:]))
    assert [int(x[0]) for x in score.best_of([one(1, 0, 0, 3), one(1, 0, 0, 0)])][:4] == [1, 0, 0, 0]
    assert int(score.best_of([one(1, 2, 1, 1), one(1, 2, 1, 1)])[0][0]) == 0 and int(score.best_of([one(0, 9, 0, 0), one(1, 0, 9, 9)])[0][0]) == 1


def test_gleu_of_a_batch_is_that_of_its_rows(spark):
    import random

    from quillspark.operators import gleu
    from quillspark.operators.units import Sequences

    rng = random.Random(3)
    sides = [[[rng.randrange(5) for _ in range(rng.randrange(0, 12))] for _ in range(3000)] for _ in range(3)]
    padded = [Sequences(np.array([r + [-1] * (12 - len(r)) for r in side]), np.array([len(r) for r in side])) for side in sides]
    want = [gleu.gleu_of(*[(len(r), gleu.grams(r)) for r in rows]) for rows in zip(*sides)]
    assert np.abs(gleu.gleu_of_batch(*padded) - want).max() < 1e-12


def test_memo_counts_need_no_join(spark):
    from quillspark.operators import memo

    asked = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "a"), (1, "c"), (1, "c"), (2, "d"), (2, "e")], "stage int, cache_key string")
    out = memo.hits_and_misses(asked, "stage", queries.F.col("stage") == 0)
    assert sorted(map(tuple, out.collect())) == [(0, 3, 0), (1, 1, 1), (2, 0, 2)]
    assert "Join" not in queries.QUERIES["memo_hits_misses"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
