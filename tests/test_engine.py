import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import scores, text
from quillspark.operators import analysis, audit, edits, gleu, iterate, memo, score, stats
from quillspark.sources import m2, tables


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, "﻿我 爱\n飯　 \x1c", text.normalize_text) == "我爱飯"
    assert one(spark, "57 ##1 多 亿", lambda x: text.detokenize(x, True)) == "571多亿" and one(spark, "# #", lambda x: text.detokenize(x, True)) == "##"
    assert one(spark, "研究 生命 啊", text.boundaries) == [2, 4] and one(spark, "研究 生命 啊", text.boundaries_before) == [1, 3] and one(spark, "", text.boundaries) == []
    assert one(spark, "甲乙", lambda x: text.ngrams(text.characters(x), 2, "")) == ["甲乙"] and one(spark, "甲乙", lambda x: text.ngrams(text.characters(x), 1, "")) == ["甲", "乙"]
    assert one(spark, "我 喜欢 苹果", lambda x: text.ngrams(text.tokens(x), 2)) == ["我 喜欢", "喜欢 苹果"]
    assert one(spark, "LINK=w1;TO=8", text.link_comment).to == 8 and one(spark, "NONE", text.link_comment) is None
    with pytest.raises(Exception, match="malformed"):
        one(spark, "LINK=w0;TO=8", text.link_comment)
    assert [one(spark, t, text.is_punctuation) for t in ("can't", ",", "。️", "3.14")] == [False, True, True, False]
    assert one(spark, "```text\n修改后的句子：“我 爱 你”\n说明：改了\n```", text.clean_response) == "我爱你"
    assert one(spark, "", lambda x: text.response_error(F.lit("句子如下：abc"), x, x)) == "empty correction" and one(spark, "ok", lambda x: text.response_error(F.lit("句子如下：abc"), x, x)) is None
    assert one(spark, "abcd", lambda x: text.is_rotation(x, F.lit("cdab"))) and one(spark, "R:NOUN", text.coarse_label) == "R"
    spans = "array<struct<s0: int, s1: int>>"
    assert one(spark, [(1, 3), (4, 4)], lambda x: text.relevant_positions(x, F.lit(4)), spans) == [1, 2, 3, 4]
    assert one(spark, ["甲乙", "丙"], text.char_to_token, "array<string>") == [0, 0, 1]


def test_scores(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 0, 3), (0, 3, 0), (10, 5, 2), (2, 1, 1)], "tp long, fp long, fn long")
    got = [r.f for r in rows.select(scores.f_beta(F.col("tp"), F.col("fp"), F.col("fn")).alias("f")).collect()]
    assert got[:3] == [1.0, 0.0, 0.0] and abs(got[4] - 2 / 3) < 1e-12
    exact = rows.select(scores.exact_f05(F.col("tp"), F.col("fp"), F.col("fn")).alias("f")).collect()
    assert abs(exact[3].f - 12.5 / 18) < 1e-12


HYP = """S 甲 乙 丙 丁 戊
A 0 1|||U|||-NONE-|||REQUIRED|||LINK=w1;TO=5|||0
A 5 5|||M|||甲|||REQUIRED|||LINK=w1;FROM=0:1|||0

S 我 很 喜 欢 茶
A 4 5|||R|||咖啡|||REQUIRED|||NONE|||0
A 0 0|||M|||今天|||REQUIRED|||NONE|||0
"""
REF = HYP.replace("w1", "w7").replace("A 0 0|||M|||今天", "A 1 2|||U|||-NONE-")


def scored(spark, tmp_path, hyp, ref):
    sides = {}
    for name, body in (("hyp", hyp), ("ref", ref)):
        (tmp_path / f"{name}.m2").write_bytes(b"\xef\xbb\xbf" + body.replace("\n", "\r\n").encode())
        blocks = m2.scan(spark, str(tmp_path / f"{name}.m2"))
        sides[name] = m2.edits(blocks).withColumnRenamed("annotator", f"{name}_id")
    ids = {n: d.select("block", f"{n}_id").distinct() for n, d in sides.items()}
    cand = ids["hyp"].join(ids["ref"], "block")
    h, r = score.logical_edits(sides["hyp"], ["block", "hyp_id"]), score.logical_edits(sides["ref"], ["block", "ref_id"])
    outcomes = score.match_edits(cand, h, r, ["block"], ["hyp_id"], ["ref_id"])
    return outcomes, score.score_candidates(cand, outcomes, ["block", "hyp_id", "ref_id"])


def test_hand_calculated_score(spark, tmp_path):
    outcomes, table = scored(spark, tmp_path, HYP, REF)
    best = score.pooled(score.select_best(table, ["block"], ["hyp_id", "ref_id"]).withColumn("all", F.lit(1)), ["all"]).first()
    assert (best.tp, best.fp, best.fn) == (2, 1, 1) and abs(best.f - 2 / 3) < 1e-12
    labels = {r.label: (r.tp, r.fp, r.fn) for r in outcomes.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()}
    assert labels == {"WO": (1, 0, 0), "R": (1, 0, 0), "M": (0, 1, 0), "U": (0, 0, 1)}
    _, table = scored(spark, tmp_path, HYP, REF.replace("TO=5", "TO=4").replace("A 5 5|||M", "A 4 4|||M"))
    first = table.where("block = 0").first()
    assert (first.tp, first.fp, first.fn) == (0, 1, 1)


def test_arrays_score_like_tables(spark, tmp_path):
    sides = {}
    for name, body in (("hyp", HYP), ("ref", REF)):
        (tmp_path / f"{name}.m2").write_text(body)
        rows = m2.edits(m2.scan(spark, str(tmp_path / f"{name}.m2")))
        met = rows.groupBy("block").agg(F.collect_list(F.struct("s0", "s1", "kind", "correction", "comment")).alias("e"))
        sides[name] = met.select("block", score.keyed_edits(F.col("e")).alias(name))
    both = sides["hyp"].join(sides["ref"], "block")
    refs = F.array(F.struct(F.lit(0).alias("ref_id"), F.array().cast("array<struct<key: string, label: string>>").alias("edits")), F.struct(F.lit(1).alias("ref_id"), F.col("ref").alias("edits")))
    best = both.select(F.array_min(score.candidate_array(F.col("hyp"), refs)).alias("c")).select("c.*").collect()
    assert sum(b.tp for b in best) == 2 and sum(b.fp for b in best) == 1 and sum(b.fn for b in best) == 1 and {b.ref_id for b in best} == {1}
    assert sorted(x for b in best for x in b.outcome.tp) == ["R", "WO"]


def test_selection_depends_on_its_mode(spark):
    # sentence 0: five matches whatever the reference; sentence 1: six edits with one match, or a noop
    rows = [("d", 0, 0, 5, 0, 0), ("d", 1, 0, 1, 0, 5), ("d", 1, 1, 0, 1, 0)]
    table = spark.createDataFrame(rows, "ds string, row long, ref_id int, tp long, fp long, fn long")
    table = table.withColumn("f", scores.f_beta(F.col("tp"), F.col("fp"), F.col("fn")))
    best = score.pooled(score.select_best(table, ["row"], ["ref_id"]), ["ds"]).first()
    greedy = score.corpus_greedy(table, ["ds"], "row", ["ref_id"]).first()
    assert (best.tp, best.fp, best.fn) == (6, 0, 5) and (greedy.tp, greedy.fp, greedy.fn) == (5, 1, 0)


def test_m2_files(spark, tmp_path):
    path = tmp_path / "t.m2"
    path.write_text("S a b\nT0-A0 没有错误\nT1 a  c\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0\nA 1 2|||R||||||||REQUIRED|||NONE|||1\n\n \n\nS x\n")
    blocks = m2.scan(spark, str(path))
    assert [(r.block, r.source) for r in m2.sources(blocks).orderBy("block").collect()] == [(0, ["a", "b"]), (1, ["x"])]
    assert sorted((r.coder, r.alternative, r.target) for r in m2.targets(blocks).na.fill(-1).collect()) == [(0, 0, "a b"), (1, -1, "a  c")]
    got = m2.edits(blocks).orderBy("pos").collect()
    assert [(e.kind, e.annotator, e.s0, e.correction) for e in got] == [("noop", 0, -1, []), ("R", 1, 1, ["||"])]
    path.write_text("S a\nA 0 1|||R|||b\n")
    with pytest.raises(Exception, match="not an M2 edit"):
        m2.edits(m2.scan(spark, str(path))).collect()
    out = str(tmp_path / "out")
    rendered = m2.render(
        spark.createDataFrame([(1, ["a"]), (2, [])], "id long, source array<string>"), spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "id long, annotator int"),
        spark.createDataFrame([(1, 1, 0, 0, 1, "R", ["b"], "NONE")], "id long, annotator int, pos int, s0 int, s1 int, kind string, correction array<string>, comment string"), "id",
    )
    m2.write(rendered, out, "id", files=1)
    back = m2.scan(spark, out)
    assert back.count() == 2 and m2.edits(back).where("kind = 'R'").first().correction == ["b"]


def test_kernels_in_spark(spark):
    pairs = spark.createDataFrame([(1, list("旅游去陌生的地方"), list("去陌生的地方旅游")), (2, ["a"], ["a"]), (3, [], ["b"])], "id long, source array<string>, target array<string>")
    done = edits.convert_pairs(pairs)
    assert {r.id: len(r.edits) for r in done.collect()} == {1: 2, 2: 0, 3: 1}
    assert all(r.a == r.target for r in done.select("target", edits.apply_edits(F.col("source"), F.col("edits")).alias("a")).collect())
    moves = edits.movements(edits.explode_edits(done, ["id"]), ["id"]).first()
    assert (moves.envelope_start, moves.envelope_stop, moves.material, moves.agrees) == (0, 8, ["旅", "游"], True)
    assert edits.movement_violations(edits.explode_edits(done, ["id"]).where("kind = 'U'"), ["id"]).first().reason == "must occur exactly twice"
    edits.register(spark)
    assert spark.sql("select size(token_edits(array('a'), array('b'))) n").first().n == 1
    near = edits.anchors(lambda a, b: [[0.95 if {x, y} == {"see", "saw"} else 0.0 for y in b] for x in a])
    got = pairs.sparkSession.createDataFrame([("I see it".split(), "I saw it".split())], "s array<string>, t array<string>").select(near("s", "t").alias("a")).first().a
    assert [(x.t, x.s, x.kind) for x in got] == [(0, 0, "exact"), (1, 1, "similar"), (2, 2, "exact")]


def test_gleu(spark):
    chars = lambda s: list(s)
    rows = [("我爱饭。", "我爱吃饭。", 0, "我爱米饭。"), ("我爱饭。", "我爱吃饭。", 1, "我爱吃饭。"), ("甲", "甲", 0, "甲")]
    table = spark.createDataFrame([(k // 2, chars(s), chars(h), r, chars(x)) for k, (s, h, r, x) in enumerate(rows)], "id long, s array<string>, h array<string>, ref_id int, r array<string>")
    scored_rows = table.withColumn("gleu", gleu.sentence_gleu(F.col("s"), F.col("h"), F.col("r")))
    best = {r.id: (r.ref_id, round(r.gleu, 12)) for r in gleu.select_best(scored_rows, ["id"]).collect()}
    assert best == {0: (1, 1.0), 1: (0, 1.0)}
    assert [r.best for r in gleu.running_best(scored_rows.where("id = 0"), ["id"]).orderBy("k").collect()][1] == pytest.approx(1.0)


def test_statistics(spark):
    assert stats.bca_interval(np.ones(100), 1.0, np.ones(5)) == (1.0, 1.0)
    assert stats.micro_f05(np.array([10]), np.array([5]), np.array([2]))[0] == pytest.approx(12.5 / 18 * 100)
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"ds": ["a"] * 60 + ["b"] * 60, "row": range(120)} | {c: rng.integers(0, 4, 120).astype(float) for c in ("tp0", "fp0", "fn0", "tp1", "fp1", "fn1")})
    rows = spark.createDataFrame(frame)
    early, late = ("tp0", "fp0", "fn0"), ("tp1", "fp1", "fn1")
    draws = stats.bootstrap(rows, ["ds"], [*early, *late], replicates=300, chunk=70)
    assert draws.groupBy("ds").count().collect()[0]["count"] == 300 and draws.orderBy("ds", "draw").first() == draws.orderBy("ds", "draw").first()
    out = stats.edit_contrast(draws, rows, ["ds"], early, late).collect()
    assert len(out) == 2 and all(r.bca95_low <= r.bca90_low <= r.bca90_high <= r.bca95_high for r in out)
    cases = spark.createDataFrame([(-0.2, 0.2, -0.1, 0.1), (-3.0, -1.0, -2.8, -1.2), (1.0, 3.0, 1.2, 2.8), (-3.0, 3.0, -2.0, 2.0)], "a double, b double, c double, d double")
    assert [r.i for r in cases.select(stats.interpretation(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("i")).collect()] == ["equivalent", "gain excluded", "improvement", "inconclusive"]
    rest = stats.leave_one_out(spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "g int, n int"), ["g"], ["n"]).collect()
    assert sorted((r.n, r.rest_n) for r in rest) == [(2, 3), (3, 2), (4, 0)]


def test_audits(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "id int, v string")
    assert audit.duplicates(a, ["id"]).first().id == 2
    assert sorted((r.id, r.problem) for r in audit.coverage(a, b, ["id"]).collect()) == [(2, "extra"), (3, "missing")]
    assert audit.mismatches(a.distinct(), b, ["id"], "v").count() == 2 and audit.multiset_difference(a, a.distinct()).count() == 1
    with pytest.raises(audit.AuditError, match="repeat"):
        audit.expect_none(audit.duplicates(a, ["id"]), "ids repeat")
    bad = spark.createDataFrame([(t,) for t in (["ok"], ["two words"], [""], ["a|||b"], [None])], "t array<string>")
    assert [r.v for r in bad.select(audit.valid_tokens(F.col("t")).alias("v")).collect()] == [True, False, False, False, False]


def test_tables(spark, tmp_path):
    (tmp_path / "gold").write_text("1\t源\ta\t\tb\n2\t文\tc\n")
    gold = tables.read_gold(spark, str(tmp_path / "gold"))
    assert [r.refs for r in gold.orderBy("id").collect()] == [["a", "b"], ["c"]] and tables.references(gold).count() == 3
    record = '{"id": "1", "source_tokens": ["a"], "references": [{"annotator_id": 0, "target_tokens": [], "skipped_annotations": []}]}\n'
    (tmp_path / "p.jsonl").write_text(record)
    assert tables.read_pairs_jsonl(spark, str(tmp_path / "p.jsonl")).first().references[0].target_tokens == []
    (tmp_path / "q.jsonl").write_text(record * 2)
    with pytest.raises(audit.AuditError):
        tables.read_pairs_jsonl(spark, str(tmp_path / "q.jsonl"))
    (tmp_path / "p.tsv").write_text('a "b\tc\t\n')
    assert tables.read_pairs_tsv(spark, str(tmp_path / "p.tsv")).first().targets == [["c"], []]
    tables.write_raw_tsv(spark.createDataFrame([(1, 'say "x"')], "a int, b string"), str(tmp_path / "raw"), ["a", "b"])
    assert spark.read.text(str(tmp_path / "raw")).first().value == '1\tsay "x"'


def test_memo_and_rounds(spark):
    asked = spark.createDataFrame([("k1",), ("k1",), ("k2",)], "cache_key string")
    stored = spark.createDataFrame([("k1", 1)], "cache_key string, v int")
    answers, full = memo.convert(asked, stored, lambda m: m.withColumn("v", F.lit(2)))
    assert sorted((r.cache_key, r.v) for r in answers.collect()) == [("k1", 1), ("k1", 1), ("k2", 2)] and full.count() == 2
    journal = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False)], "key string, attempt int, ok boolean")
    assert memo.latest_ok(journal, "key", ["attempt"]).first().attempt == 2
    rows = spark.createDataFrame([(1, "a b"), (2, "a b c d")], "id long, source string")
    fixed = iterate.run_rounds(rows, lambda s, seg: F.upper(s), lambda t: F.when(F.length(t) > 4, F.lower(t)).otherwise(t), rounds=3)
    assert {r.id: (r.converged_at, r.T3) for r in fixed.collect()} == {1: (3, "A B"), 2: (2, "A B C D")}
    scores_table = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 2.0)], "k string, stage int, v double")
    assert analysis.best_stage(scores_table, ["k"], "stage", "v").first().stage == 1
    ranks = analysis.rank_summary(scores_table, "k", "stage", "v", [(1, 0), (2, 1)]).collect()
    assert [(r.wins, r.ties, r.losses) for r in ranks] == [(1, 0, 0), (0, 1, 0)]


def test_journal_stream(spark, tmp_path):
    from quillspark.streaming import journal

    (tmp_path / "in").mkdir()
    lines = ['{"cache_key": "%s", "attempt": %d, "timestamp": %d, "ok": %s}' % r for r in (("a", 1, 10, "false"), ("a", 2, 11, "true"), ("a", 3, 12, "true"), ("b", 1, 13, "true"))]
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    run = journal.append_to(journal.successes(journal.read_journal(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.cache_key for r in got.collect()) == ["a", "b"]


def test_runs_of_long_documents_keep_their_own_ids(spark, tmp_path):
    from quillspark.plans import synth

    texts = [(1, "a " * (16 * 10_002), "en"), (2, "b " * 40, "en")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = synth.view(spark, str(tmp_path), "gec").selectExpr("row_id", "toks[0] as first").collect()
    assert len(rows) == len({r.row_id for r in rows}) == 10_002 + 3
    assert sorted(r.row_id for r in rows if r["first"] == "b") == [2 * synth.RUNS + c for c in range(3)]
