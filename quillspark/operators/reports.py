"""Reports over runs, scores and segmentations: usage, audits, diagnostics and headline figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import exact_f05
from ..functions.text import boundaries, boundary_f1, detokenize, once


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).cast("long")


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


# ---- runs ------------------------------------------------------------------------------------------------------------


def api_usage(records: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens, format retries and fallbacks of each stage, from the calls that run records hold."""
    calls = records.select(*by, F.explode("meta.api").alias("c")).select(*by, F.col("c.T").alias("stage"), "c.usage.*", "c.format_retries", "c.content_filter_fallback")
    tokens = [_sum(F.col(c)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return calls.groupBy(*by, "stage").agg(F.count("*").alias("calls"), *tokens, _sum(F.col("format_retries")).alias("retries"), _n(F.col("content_filter_fallback")).alias("fallbacks"))


def convergence_records(records: DataFrame, by: list[str]) -> DataFrame:
    """How many records converged, at which round, and how many rounds were carried on."""
    c = F.col("meta.convergence")
    return records.groupBy(*by, c["at_S"].alias("round")).agg(F.count("*").alias("n"), _n(c["converged"]).alias("converged"), _sum(F.size(F.coalesce(c["carried_rounds"], F.array().cast("array<int>")))).alias("carried"))


def source_copies(outputs: DataFrame, by: list[str], source: str = "source", hyp: str = "hyp", previous: str = "previous") -> DataFrame:
    """How many outputs are their source, how many are the output before, and the mean character distance from the source."""
    far = F.levenshtein(F.col(source), F.col(hyp))
    return outputs.groupBy(*by).agg(F.count("*").alias("n"), _n(F.col(hyp) == F.col(source)).alias("source_copies"), _n(F.col(hyp) == F.col(previous)).alias("same_as_previous"), F.avg(far).alias("mean_distance"))


def tokenization_audit(rows: DataFrame, hyp: str, source: str, refs: str) -> DataFrame:
    """``rows`` with is_reference and is_source: whether the texts are the same once their tokenisation is taken away."""
    text = detokenize(F.col(hyp))
    same = F.exists(F.col(refs), lambda r: detokenize(r) == text)
    return rows.withColumn("text", text).withColumn("is_reference", same).withColumn("is_source", detokenize(F.col(source)) == text)


def tokenization_summary(audited: DataFrame, by: list[str]) -> DataFrame:
    return audited.groupBy(*by).agg(F.count("*").alias("n"), _n(F.col("is_reference")).alias("reference_texts"), _n(F.col("is_source")).alias("source_texts"), F.count_distinct("text").alias("distinct_texts"))


# ---- policies and lineage -------------------------------------------------------------------------------------------------


def policy_violations(declared: DataFrame, policy: DataFrame, key: str, value: str) -> DataFrame:
    """Declared rows whose ``value`` is not what the policy has for their ``key``; unknown keys are violations."""
    known = policy.select(F.col(key), F.col(value).alias("expected"))
    return declared.join(known, key, "left").where(~F.col(value).eqNullSafe(F.col("expected")))


def lineage_violations(predictions: DataFrame, receipts: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Predictions without a receipt, receipts without a prediction, and those whose digests differ."""
    a, b = predictions.select(*keys, F.col(digest).alias("said"), F.lit(True).alias("__p")), receipts.select(*keys, F.col(digest).alias("received"), F.lit(True).alias("__r"))
    problem = F.when(F.col("__r").isNull(), "no receipt").when(F.col("__p").isNull(), "no prediction").when(~F.col("said").eqNullSafe(F.col("received")), "digest differs")
    return a.join(b, keys, "full_outer").withColumn("problem", problem).where("problem is not null").select(*keys, "said", "received", "problem")


def movement_candidates(gold: DataFrame, other: DataFrame, third: DataFrame, keys: list[str], least: int, pair: str = "pair") -> DataFrame:
    """Movements of ``least`` and more units whose surface pair is the same in three files, keyed by block."""
    moved = gold.where(F.col("envelope_stop") - F.col("envelope_start") >= least)
    b, c = other.select(*keys, F.col(pair).alias("__b")), third.select(*keys, F.col(pair).alias("__c"))
    return moved.join(b, keys).join(c, keys).where((F.col(pair) == F.col("__b")) & (F.col(pair) == F.col("__c"))).drop("__b", "__c")


def pick_cases(rows: DataFrame, key: str, picks: list[tuple[str, Column, list[Column]]]) -> DataFrame:
    """One case for each (name, condition, order), in turn; a case that an earlier pick took is not taken again.

    Of each pick the first few rows are enough, as many as there are picks before
    it and one more, so all picks are read in one pass and a bounded table decides.
    """
    taken, out = [], None
    for k, (name, condition, order) in enumerate(picks):
        first = rows.where(condition).orderBy(*order).limit(k + 1)
        for r in first.select(key).collect():
            if r[key] not in taken:
                taken.append(r[key])
                one = rows.where(F.col(key) == r[key]).select(F.lit(name).alias("pick"), key)
                out = one if out is None else out.unionByName(one)
                break
    return out if out is not None else rows.select(F.lit("").alias("pick"), key).where("false")


# ---- scores ----------------------------------------------------------------------------------------------------------------


def subset_mean(scores: DataFrame, inside: Column, by: list[str], value: str) -> DataFrame:
    return scores.where(inside).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def contrast_range(contrasts: DataFrame, by: list[str], value: str = "delta") -> DataFrame:
    """The least and the greatest contrast, and what lies between."""
    return contrasts.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), (F.max(value) - F.min(value)).alias("range"))


def recomputed_differences(stored: DataFrame, computed: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """The largest difference of each metric between two score tables; a key that one lacks is counted."""
    a, b = (t.unpivot(keys, metrics, "metric", side) for t, side in ((stored, "stored"), (computed, "computed")))
    met = a.join(b, [*keys, "metric"], "full_outer")
    return met.groupBy("metric").agg(F.max(F.abs(F.col("stored") - F.col("computed"))).alias("largest"), _n(F.col("stored").isNull() != F.col("computed").isNull()).alias("missing"))


def selected_beyond(best: DataFrame, least: int, keys: list[str], ref_id: str = "ref_id") -> DataFrame:
    """How many distinct sentences have a selected reference of index ``least`` or more."""
    return best.where(F.col(ref_id) >= least).agg(F.count_distinct(*keys).alias("sentences"))


def density_table(buckets: DataFrame, by: str = "bucket", stage: str = "stage") -> DataFrame:
    """Each bucket's F0.5 from counts pooled again, its GLEU as the mean of rounded scores weighted by sentences, and the best stage.

    ``buckets`` has a row for each data set, bucket and stage: tp, fp, fn, gleu and
    sentences.  Scores are rounded to two decimals before they are averaged, which
    is part of the definition.  Of equally good stages the earliest is the best.
    """
    weighted = F.sum(F.round("gleu", 2) * F.col("sentences")) / F.sum("sentences")
    sums = buckets.groupBy(by, stage).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "sentences")], weighted.alias("gleu"))
    scored = sums.withColumn("f05", exact_f05(F.col("tp"), F.col("fp"), F.col("fn")))
    first = lambda c: F.min(F.struct((-F.round(c, 2)).alias("v"), F.col(stage).alias("s")))["s"]
    best = scored.groupBy(by).agg(first("f05").alias("best_f05_stage"), first("gleu").alias("best_gleu_stage"))
    return scored.join(best, by)


def headline(scores: DataFrame, key: str, stage: str, value: str, raw: int, direct: int, later: list[int]) -> DataFrame:
    """Over all data sets: the widest range of the later stages, how often the best later one beats the raw stage, and the best gain.

    ``later`` are the stages after the direct one.  Of equal gains the data set of
    the larger name is told.
    """
    wide = scores.groupBy(key).pivot(stage, sorted({raw, direct, *later})).agg(F.first(value))
    after = [F.col(str(k)) for k in later]
    top, low = (f(*after) if len(after) > 1 else after[0] for f in (F.greatest, F.least))
    gain = F.struct((top - F.col(str(direct))).alias("gain"), F.col(key).alias("name"))
    return wide.agg(F.max(top - low).alias("widest_range"), _n(top > F.col(str(raw))).alias("beats_raw"), F.max(gain)["gain"].alias("best_gain"), F.max(gain)["name"].alias("best_name"))


def conversion_stats(rows: DataFrame, by: list[str], edits: str = "edits", source: str = "source", target: str = "target") -> DataFrame:
    """Pairs, identical pairs, and edits by type; links count once, by their deletion."""

    def of(kind: str, linked: bool = False) -> Column:
        return _sum(F.size(F.filter(edits, lambda e: (e["kind"] == kind) & (e["comment"].startswith("LINK=") if linked else F.lit(True)))))

    kinds, linked = [of(k).alias(k) for k in "MRUW"], of("U", linked=True).alias("W_LD")
    return rows.groupBy(*by).agg(F.count("*").alias("pairs"), _n(F.col(source) == F.col(target)).alias("identical"), *kinds, linked)


# ---- segmentations ----------------------------------------------------------------------------------------------------------


def boundary_diagnostics(rows: DataFrame, by: list[str], early: str, late: str, fixed: str, early_out: str, late_out: str, relevant: str) -> DataFrame:
    """What changes between two segmentations, and whether it comes nearer to the fixed one.

    Pooled scores, closeness and overlap are over the sentences whose boundaries
    change.  ``relevant`` holds the positions that corrections touch, as
    :func:`..functions.text.relevant_positions` has them.
    """
    b = F.struct(boundaries(F.col(early)).alias("e"), boundaries(F.col(late)).alias("l"), boundaries(F.col(fixed)).alias("f"))

    def measured(v: Column) -> Column:
        added, removed = F.array_except(v["l"], v["e"]), F.array_except(v["e"], v["l"])
        return F.struct(
            (F.size(added) + F.size(removed) > 0).alias("changed"), F.size(added).alias("added"), F.size(removed).alias("removed"),
            F.size(v["e"]).alias("n_e"), F.size(v["l"]).alias("n_l"), F.size(v["f"]).alias("n_f"),
            F.size(F.array_intersect(v["e"], v["f"])).alias("hit_e"), F.size(F.array_intersect(v["l"], v["f"])).alias("hit_l"),
            boundary_f1(v["e"], v["f"]).alias("f1_e"), boundary_f1(v["l"], v["f"]).alias("f1_l"),
            F.size(F.array_intersect(F.array_union(added, removed), F.col(relevant))).alias("overlap"),
        )

    each = rows.select(*by, once(b, measured).alias("m"), (F.col(early_out) != F.col(late_out)).alias("out")).select(*by, "m.*", "out")
    ch = F.col("changed")
    of = lambda c: _sum(F.when(ch, F.col(c)))
    sums = each.groupBy(*by).agg(
        F.count("*").alias("sentences"), _n(ch).alias("changed"), of("added").alias("added"), of("removed").alias("removed"),
        _n(ch & F.col("out")).alias("changed_outputs"), _n(F.col("out")).alias("all_output_changes"),
        *[of(c).alias(c) for c in ("n_e", "n_l", "n_f", "hit_e", "hit_l")],
        *[_n(ch & c).alias(n) for n, c in (("closer", F.col("f1_l") > F.col("f1_e")), ("tied", F.col("f1_l") == F.col("f1_e")), ("farther", F.col("f1_l") < F.col("f1_e")))],
        F.avg(F.when(ch, 100 * (F.col("f1_l") - F.col("f1_e")))).alias("mean_f1_delta"),
        of("overlap").alias("overlap_positions"), _n(ch & (F.col("overlap") > 0)).alias("overlap_sentences"),
    )

    def ratio(a: str, b_: str) -> Column:
        return F.when(F.col(b_) > 0, F.col(a) / F.col(b_)).otherwise(1.0)

    out = sums
    for side in "el":
        p, r = ratio(f"hit_{side}", f"n_{side}"), ratio(f"hit_{side}", "n_f")
        out = out.withColumn(f"precision_{side}", 100 * p).withColumn(f"recall_{side}", 100 * r).withColumn(f"f1_{side}", F.when(p + r > 0, 200 * p * r / (p + r)).otherwise(0.0))
    share = lambda a, b_: F.when(F.col(b_) > 0, 100 * F.col(a) / F.col(b_)).otherwise(0.0)
    return out.withColumn("changed_percent", share("changed", "sentences")).withColumn("output_change_percent", share("changed_outputs", "changed")).drop("n_e", "n_l", "n_f", "hit_e", "hit_l")


def boundary_f1_changes(rows: DataFrame, by: list[str], early: str, late: str, fixed: str) -> DataFrame:
    """``(by, delta)``: of every sentence whose boundaries change, how its F1 against the fixed ones changes."""
    b = F.struct(boundaries(F.col(early)).alias("e"), boundaries(F.col(late)).alias("l"), boundaries(F.col(fixed)).alias("f"))
    delta = once(b, lambda v: F.when(v["e"] != v["l"], 100 * (boundary_f1(v["l"], v["f"]) - boundary_f1(v["e"], v["f"]))))
    return rows.select(*by, delta.alias("delta")).where("delta is not null")


# ---- names and tables for people ----------------------------------------------------------------------------------------------


def with_names(rows: DataFrame, names: DataFrame, key: str, name: str = "display") -> DataFrame:
    """``rows`` with a display name for ``key``; the key itself where there is none."""
    return rows.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.col(key).cast("string")))


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A table of at most ``limit`` rows as Markdown, for people; more rows fail."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"a table for people has at most {limit} rows")
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [" | ".join(rows.columns), " | ".join("-" for _ in rows.columns), *(" | ".join(map(cell, r)) for r in got)]
    return "\n".join(f"| {x} |" for x in lines)


# What LaTeX reads as more than a character.
_LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escape(text: str) -> str:
    return "".join(_LATEX.get(c, c) for c in text)

