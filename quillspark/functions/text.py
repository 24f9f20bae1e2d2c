r"""Text and segmentation functions as column expressions.

White space follows Python's str rules: ``(?U)\s`` and \x1c-\x1f.  Offsets count
code points; a segmentation is its tokens with single spaces between.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)[\s\x1c-\x1f]+"
BOM = "﻿"
_PUNCTUATION = r"^(?=.*[\p{P}\p{S}])[\p{P}\p{S}\p{M}\p{Cf}]+$"
LINK = r"^LINK=(w[1-9][0-9]*);(?:TO=(0|[1-9][0-9]*)|FROM=(0|[1-9][0-9]*):(0|[1-9][0-9]*))$"


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable, so it is computed once."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def strip_blank(x: Column) -> Column:
    return F.regexp_replace(x, BLANK, "")


def normalize_text(x: Column) -> Column:
    """Without byte order marks and white space."""
    return F.replace(strip_blank(x), F.lit(BOM), F.lit(""))


def clean_cell(x: Column) -> Column:
    """One line of a table cell: marks go, tabs and line ends become spaces, ends are trimmed."""
    return F.regexp_replace(F.translate(F.replace(x, F.lit(BOM), F.lit("")), "\t\r\n", "   "), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, BLANK), lambda t: t != "")


def characters(x: Column) -> Column:
    return F.when(F.length(x) > 0, F.split(x, "")).otherwise(F.array().cast("array<string>"))


def canonical(x: Column) -> Column:
    return F.array_join(tokens(x), " ")


def detokenize(x: Column, continued: bool = False) -> Column:
    """Tokens joined; with ``continued`` a leading ## of a token longer than it goes."""
    part = (lambda t: F.when(t.startswith("##") & (F.length(t) > 2), F.substring(t, 3, F.length(t))).otherwise(t)) if continued else (lambda t: t)
    return F.array_join(F.transform(tokens(x), part), "")


def is_rotation(a: Column, b: Column) -> Column:
    return (F.length(a) == F.length(b)) & (F.instr(F.concat(a, a), b) > 0)


def is_punctuation(token: Column) -> Column:
    return token.rlike(_PUNCTUATION)


def mixes_punctuation(arr: Column) -> Column:
    return F.size(F.array_distinct(F.transform(arr, is_punctuation))) > 1


def lengths_before(toks: Column) -> Column:
    """Running lengths: the offset after each token."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, t: Column) -> Column:
        at = acc["at"] + F.length(t)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(toks, start, add)["out"]


def boundaries(segmented: Column) -> Column:
    """Offsets after every token but the last."""
    return once(lengths_before(tokens(segmented)), lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))


def boundaries_before(segmented: Column) -> Column:
    """The other convention: offset of the character before each boundary."""
    return F.transform(boundaries(segmented), lambda p: p - 1)


def token_spans(toks: Column) -> Column:
    ends = lengths_before(toks)
    return F.zip_with(ends, toks, lambda e, t: F.struct((e - F.length(t)).alias("start"), e.alias("stop")))


def char_to_token(toks: Column) -> Column:
    return F.flatten(F.transform(toks, lambda t, i: F.array_repeat(i, F.length(t))))


def same_units(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same units, each as often, in any order."""
    return F.sort_array(a) == F.sort_array(b)


def boundary_error(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def boundary_f1(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def relevant_positions(edits: Column, length: Column) -> Column:
    """Closed span edges of edits (an insertion is a point), clamped to the text."""
    spans = F.transform(edits, lambda e: F.sequence(F.greatest(e["s0"], F.lit(0)), F.least(e["s1"], length)))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def coarse_label(label: Column) -> Column:
    return F.split_part(label, F.lit(":"), F.lit(1))


def readable_edit(kind: Column, s0: Column, s1: Column, source: Column, correction: Column) -> Column:
    """An edit in words."""
    old, new = F.array_join(F.slice(source, s0 + 1, s1 - s0), " "), F.array_join(correction, " ")
    return (
        F.when(kind == "noop", "no change")
        .when(kind == "M", F.concat(F.lit("insert "), new, F.lit(" at "), s0.cast("string")))
        .when(kind == "U", F.concat(F.lit("delete "), old, F.lit(" at "), s0.cast("string")))
        .otherwise(F.concat(F.when(kind == "W", "reorder ").otherwise(F.lit("replace ")), old, F.lit(" at "), s0.cast("string"), F.lit(" by "), new))
    )


def translated(text: Column, pairs: dict[str, str] | None = None) -> Column:
    """A target normaliser: characters replaced one for one; without pairs the text as it is."""
    return F.translate(text, "".join(pairs), "".join(pairs.values())) if pairs else text


def reference_bucket(n: Column) -> Column:
    return F.when(n > 3, F.lit(">3")).otherwise(n.cast("string"))


def link_comment(comment: Column) -> Column:
    """struct<link, to, from_start, from_stop> of a movement comment, null for others; malformed ones raise."""
    part = lambda k: F.nullif(F.regexp_extract(comment, LINK, k), F.lit(""))
    parsed = F.struct(
        part(1).alias("link"), part(2).cast("int").alias("to"), part(3).cast("int").alias("from_start"), part(4).cast("int").alias("from_stop")
    )
    broken = F.raise_error(F.concat(F.lit("malformed movement comment: "), comment)).cast(
        "struct<link: string, to: int, from_start: int, from_stop: int>"
    )
    return F.when(comment.rlike(LINK), parsed).when(comment.rlike(r"(^|;)\s*(LINK|TO|FROM)\s*="), broken)


def origin_comment(link: Column, to: Column) -> Column:
    return F.concat(F.lit("LINK="), link, F.lit(";TO="), to.cast("string"))


def destination_comment(link: Column, start: Column, stop: Column) -> Column:
    return F.concat(F.lit("LINK="), link, F.lit(";FROM="), start.cast("string"), F.lit(":"), stop.cast("string"))


def correction_units(kind: Column, text: Column, unit: str = "word") -> Column:
    """Units of a correction: none for a deletion or -NONE-."""
    units = tokens(text) if unit == "word" else characters(strip_blank(text))
    return F.when((kind == "U") | (text == "-NONE-"), F.array().cast("array<string>")).otherwise(units)


def pair_key(config: Column, source: Column, target: Column) -> Column:
    """SHA-256 identity of a (configuration, source, target) triple."""
    return F.sha2(F.concat_ws("\u0000", config, source, target).cast("binary"), 256)


def ngrams(units: Column, n: int, joiner: str = " ") -> Column:
    some = F.transform(F.sequence(F.lit(1), F.size(units) - (n - 1)), lambda i: F.array_join(F.slice(units, i, n), joiner))
    return F.when(F.size(units) >= n, some).otherwise(F.array().cast("array<string>"))


def ordered_unique(arr: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(arr, clean_cell), lambda x: x != ""))


def select_source_segmentation(stage: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """The segmentation that a stage's output is judged against: its own input's."""
    return F.when(stage.isin("T0", "T1"), s1).when(stage == "T2", s2).when(stage == "T3", s3)


def sentence_from_prompt(prompt: Column) -> Column:
    return F.element_at(F.split(prompt, "句子如下："), -1)


# Lead-ins after which a response holds the correction, markers of
# an explanation that follows it, and of a model talking to itself.
LEAD_INS = ("修改后的句子[：:]", "修改后[：:]", "改正后[：:]", "最终输出(?:（[^）]*）)?[：:]", "修改为[：:]", "修正后[：:]")
RATIONALE = r"\n+(?U:\s*)(?:修改说明|说明|理由|解释)[：:]"
SELF_TALK = ("等等，让我重新考虑", "重新分析：", "最终判断：", "我决定：")


def clean_response(x: Column) -> Column:
    """The correction within a model's response: fences, lead-ins, rationale, blanks and quotes go."""
    body = F.regexp_replace(F.replace(x, F.lit("\r"), F.lit("\n")), r"(?U)^\s+|\s+$", "")
    body = F.regexp_replace(body, r"(?iU)^```(?:text|txt|中文)?\s*", "")
    body = F.regexp_replace(body, r"(?U)\s*```$", "")
    led = body
    for mark in reversed(LEAD_INS):
        led = F.when(body.rlike(mark), F.regexp_replace(F.element_at(F.split(body, mark), -1), r"(?U)^\s+", "")).otherwise(led)
    short = F.element_at(F.split(led, RATIONALE, 2), 1)
    return F.regexp_replace(strip_blank(short), "^[\"'“”]+|[\"'“”]+$", "")


def response_error(prompt: Column, raw: Column, cleaned: Column) -> Column:
    """Why a response is no correction; null if it is one."""
    source = F.length(strip_blank(sentence_from_prompt(prompt)))
    most = F.greatest(F.lit(128), 4 * source)
    talk = F.lit(False)
    for mark in SELF_TALK:
        talk = talk | raw.contains(mark)
    return (
        F.when(cleaned == "", "empty correction")
        .when(F.length(cleaned) > most, F.format_string("correction has %d characters; at most %d fit a source of %d", F.length(cleaned), most, source))
        .when(talk, "the response argues with itself")
    )
