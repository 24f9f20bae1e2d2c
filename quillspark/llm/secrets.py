"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary ones.

Two first-order Markov models over the characters of a token are counted from
labelled samples.  A token is a secret when random strings explain it better
than ordinary identifiers by more than a threshold, per character.  Of a token
that is none as a whole, each window of the least length is judged alike, for a
name or path joined to a secret dilutes its mean.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import cut_out, joined_spans, let, match_spans

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Characters the models know; all others count as one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
#: Tokens shorter than this are no candidates.  Threshold: natural log odds per character.
CANDIDATE_LEAST, THRESHOLD = 20, 0.6
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LEAST},}}"
#: A stretch is widened to a separator that stands within so many characters.
SEPARATORS, WIDEN = "=/_-", 256
#: Documents that the models learn from at most (about), and the shortest ordinary runs taken from them.
SAMPLE_ROWS, SAMPLE_LEAST = 4_000, 12
#: Words that ordinary identifiers are made of.
IDENTIFIER_WORDS = (
    "account active address agent array balance batch between buffer builder cache callback channel character client cluster "
    "column command config connection constructor container content context control convert counter create current customer "
    "database default delete description device dictionary directory document download element employee encoding engine "
    "environment error event exception execute export external factory feature field filter folder format function general "
    "generator global group handler header history identifier image import index information initial input instance integer "
    "interface internal invoice iterator keyboard language layout length level library listener location manager mapping "
    "matrix measure member memory message method minimum model module monitor network notification number object operation "
    "option order output package parameter parent parser partition password pattern payment performance permission pipeline "
    "platform position previous process product profile project property protocol provider query queue reader record reference "
    "region register release remote render report request resource response result return route runtime sample schedule schema "
    "scheme screen search section security segment select sequence server service session setting shadow signature simple "
    "snapshot source standard statement static status storage stream string structure subject summary support switch symbol "
    "system table target template terminal thread timeout timestamp token transaction transfer transform translation update "
    "upload utility validate value variable vector version viewer virtual widget window worker writer"
).split()


def labelled_samples(spark: SparkSession, each: int = 4000) -> DataFrame:
    """``(sample, is_random)``: strings by a fixed rule, ``each`` of either label.

    Random ones are hashes written in hexadecimal (either case) and base 64;
    ordinary ones join three to five words in the usual spellings.
    """
    n = len(IDENTIFIER_WORDS)
    vocabulary = F.array(*[F.lit(w) for w in IDENTIFIER_WORDS])
    ids = spark.range(each)
    digest = F.sha2(F.concat(F.lit("random"), F.col("id")), 256)
    random = ids.select(
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40))
        .when(F.col("id") % 4 == 1, F.upper(F.substring(digest, 1, 40)))
        .otherwise(F.regexp_replace(F.base64(F.unhex(digest)), "=+$", ""))
        .alias("sample"),
        F.lit(True).alias("is_random"),
    )

    def pick(k: int) -> Column:
        return F.get(vocabulary, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int"))

    parts = F.slice(F.array(*[pick(k) for k in range(5)]), F.lit(1), (3 + F.col("id") % 3).cast("int"))
    camel = F.array_join(F.transform(parts, F.initcap), "")
    style = F.col("id") % 6
    ordinary = ids.select(
        F.when(style == 0, camel)
        .when(style == 1, F.array_join(parts, "_"))
        .when(style == 2, F.array_join(parts, "-"))
        .when(style == 3, F.array_join(parts, "/"))
        .when(style == 4, F.upper(F.array_join(parts, "_")))
        .otherwise(F.array_join(parts, ""))
        .alias("sample"),
        F.lit(False).alias("is_random"),
    )
    return random.unionByName(ordinary)


def labelled_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(sample, is_random)`` from about ``rows`` documents, drawn by a hash of id and text.

    What the fixed patterns find is labelled random (of an assignment its value),
    every other run of SAMPLE_LEAST and more characters of the alphabet ordinary.
    Null and empty texts give nothing.
    """
    share = min(1.0, rows / max(1, docs.count()))
    text = F.col(text_col).cast("string")
    drawn = docs.where(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 30)) < int(share * (1 << 30))).select(text.alias("text"))
    assign = F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST)
    other = F.concat(
        F.regexp_extract_all("text", F.lit(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"), F.lit(0)),
        F.regexp_extract_all("text", F.lit(rf"[0-9a-f]{{{HEX_LEAST},}}"), F.lit(0)),
    )
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}|[0-9a-f]{{{HEX_LEAST},}}", " ")
    plain = F.regexp_extract_all(rest, F.lit(rf"[A-Za-z0-9+/_=-]{{{SAMPLE_LEAST},}}"), F.lit(0))
    random = drawn.select(F.explode(F.array_distinct(F.concat(assign, other))).alias("sample"), F.lit(True).alias("is_random"))
    return random.unionByName(drawn.select(F.explode(plain).alias("sample"), F.lit(False).alias("is_random")))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the models are trained on: samples by rule, and samples from the documents."""
    return labelled_samples(docs.sparkSession).unionByName(labelled_texts(docs, id_col, text_col))


def train(samples: DataFrame, sample_col: str = "sample", label_col: str = "is_random", smooth: float = 0.5) -> list[float]:
    """Log odds (random over ordinary) of each character after each, row-major; one more for all others.

    Counting is done by Spark; at most two counts for each pair of known
    characters reach the driver.  Null samples and labels teach nothing.
    """
    size = len(ALPHABET) + 1
    place = lambda c: F.instr(F.lit(ALPHABET), c)  # noqa: E731  0: none of them
    pairs = (
        samples.where(F.col(sample_col).isNotNull() & F.col(label_col).isNotNull() & (F.length(sample_col) > 1))
        .select(
            F.col(label_col).alias("label"),
            F.explode(
                F.transform(F.sequence(F.lit(1), F.length(sample_col) - 1), lambda i: F.substring(F.col(sample_col), i, F.lit(2)))
            ).alias("pair"),
        )
        .groupBy("label", "pair")
        .count()
    )
    coded = pairs.groupBy(
        "label", place(F.substring("pair", 1, 1)).alias("a"), place(F.substring("pair", 2, 1)).alias("b")
    ).agg(F.sum("count").alias("n"))
    counts = {True: [smooth] * size * size, False: [smooth] * size * size}
    for r in coded.collect():
        counts[bool(r["label"])][(r["a"] or 0) * size + (r["b"] or 0)] += r["n"]
    odds = []
    for a in range(size):
        rows = {k: v[a * size : (a + 1) * size] for k, v in counts.items()}
        totals = {k: sum(v) for k, v in rows.items()}
        odds += [math.log(rows[True][b] / totals[True]) - math.log(rows[False][b] / totals[False]) for b in range(size)]
    return odds


def _table(odds: list[float]) -> Column:
    return F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in odds) + "]"), "array<double>")


def _codes(token: Column) -> Column:
    """The place of each character in ALPHABET, from 1; 0 for others."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _steps(codes: Column, table: Column) -> Column:
    """The log odds of each character after the one before; of at least two characters."""
    size = len(ALPHABET) + 1
    return F.transform(
        F.sequence(F.lit(0), F.size(codes) - 2), lambda i: F.get(table, F.get(codes, i) * size + F.get(codes, i + 1))
    )


def log_odds(token: Column, odds: list[float]) -> Column:
    """Mean log odds per step of ``token`` (one character or none: 0)."""

    def score(codes: Column) -> Column:
        return F.aggregate(_steps(codes, _table(odds)), F.lit(0.0), lambda a, x: a + x) / (F.size(codes) - 1)

    return F.when(F.length(token) > 1, let(_codes(token), score)).otherwise(F.lit(0.0))


def _windows(token: Column, odds: list[float], threshold: float) -> Column:
    """``array<struct<start, stop>>`` of the stretches of ``token`` that windows above ``threshold`` cover.

    A window is CANDIDATE_LEAST characters.  What overlaps or touches is one
    stretch, which is widened to the separators (= / _ -) next to it, within WIDEN
    characters.  A part that shares a window with a secret may so go with it.
    """
    steps_each, table = CANDIDATE_LEAST - 1, _table(odds)
    none = F.expr("cast(array() as array<struct<start: int, stop: int>>)")
    apart = [ALPHABET.index(c) + 1 for c in SEPARATORS]

    def until_separator(codes: Column) -> Column:
        """How many of ``codes`` stand before the first separator."""
        places = F.filter(F.sequence(F.lit(0), F.size(codes) - 1), lambda k: F.get(codes, k).isin(*apart))
        return F.when(F.size(codes) > 0, F.coalesce(F.get(places, F.lit(0)), F.size(codes))).otherwise(0)

    def stretches(v: Column) -> Column:
        over = F.filter(
            F.sequence(F.lit(0), F.size(v["steps"]) - steps_each),
            lambda i: F.aggregate(F.slice(v["steps"], i + 1, steps_each), F.lit(0.0), lambda a, x: a + x) / steps_each > threshold,
        )
        raw = F.transform(over, lambda i: F.struct(i.alias("start"), (i + CANDIDATE_LEAST).alias("stop")))

        def wide(s: Column) -> Column:
            back = F.reverse(F.slice(v["codes"], F.greatest(s["start"] - WIDEN, F.lit(0)) + 1, F.least(s["start"], F.lit(WIDEN))))
            ahead = F.slice(v["codes"], s["stop"] + 1, WIDEN)
            return F.struct((s["start"] - until_separator(back)).alias("start"), (s["stop"] + until_separator(ahead)).alias("stop"))

        return joined_spans(F.transform(joined_spans(raw), wide))

    def scored(codes: Column) -> Column:
        return let(F.struct(codes.alias("codes"), _steps(codes, table).alias("steps")), stretches)

    return F.when(F.length(token) >= CANDIDATE_LEAST, let(_codes(token), scored)).otherwise(none)


def _named(spans: Column, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["stop"].alias("stop"), F.lit(kind).alias("kind")
        ),
    )


def find_secrets(docs: DataFrame, odds: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``secrets``: array<struct<start, order, stop, kind>>, by start and then kind.

    Offsets count code points from 0, stop exclusive.  ``markov`` spans are
    tokens that the models take for random, or stretches of a token between
    separators where its whole is no secret.  The models judge every token of the
    text, those within a span of the fixed patterns too: such a span then has a
    witness, and one without is more likely a placeholder.  Null and empty texts have
    no spans.  Repeated rows get the same spans, an empty table stays empty; a
    column named secrets is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = F.filter(
        match_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LEAST
    )
    # a run of a character class is maximal, so asking for its length in the pattern finds the same runs
    access = match_spans(text, rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
    hexes = match_spans(text, rf"[0-9a-f]{{{HEX_LEAST},}}")
    base = F.concat(_named(assign, "assign"), _named(access, "access"), _named(hexes, "hex"))

    whole = lambda s: F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    inside = lambda s: F.transform(
        _windows(s["match"], odds, threshold),
        lambda w: F.struct((s["start"] + w["start"]).alias("start"), (s["start"] + w["stop"]).alias("stop")),
    )
    taken = F.transform(
        match_spans(text, CANDIDATE), lambda s: F.when(log_odds(s["match"], odds) > threshold, whole(s)).otherwise(inside(s))
    )
    return docs.withColumn("secrets", F.sort_array(F.concat(base, _named(F.flatten(taken), "markov"))))


def digest_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``secrets`` in the text replaced by ``mark``; spans that overlap or touch are one.

    Texts without spans, null ones among them, stay as they are.
    """
    text = F.col(text_col)

    def clean(spans: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["stop"]))
        ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
        between = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
        return F.array_join(cut_out(text, between), mark)

    return docs.withColumn(text_col, F.when(F.size("secrets") > 0, let(joined_spans(F.col("secrets")), clean)).otherwise(text))
