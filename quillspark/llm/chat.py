r"""Chat formatting of turns made of typed content parts.

A conversation is one string::

    <s>[INST]role[/INST]content</s>[INST]role[/INST]content</s>...

Content is visited in order: neighbouring texts are one text, which is escaped as
a whole, so parts that only make a control string together are escaped too; an
image, audio or document part leaves its placeholder and an entry in the
attachments, with the number of tokens that the placeholder will be expanded to.
A control string inside a text gets one backslash more after its first character
(``</s>`` is written ``<\/s>``, ``<\/s>`` is written ``<\\/s>``), so none is left
as it was and taking one backslash away restores every text.  A placeholder
begins and ends with characters that no control string goes on with, so what
stands next to it can't make one; and a bare placeholder is never text, so
content is read back as typed parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import cut_out, let

BEGIN, END, ROLE, CONTENT = "<s>", "</s>", "[INST]", "[/INST]"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
#: Tokens of an attachment: for each tile of an image, second of audio, page of a document; one at least.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
#: A content part; units: tiles, seconds or pages.
PART_TYPE = "struct<kind: string, text: string, ref: string, units: int>"

_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|image>|audio>|document>)"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|image>|audio>|document>)"


_PLACEHOLDER = "<(?:" + "|".join(PLACEHOLDERS) + ")>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    """A text column as the content of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("units")))


def _visit(parts: Column) -> Column:
    """The characters of a turn's parts.  An unknown kind stands for its text, a missing text for nothing.

    ``bounds`` are the places of the attachments with one before and one behind
    all parts; what lies between two of them is one text.
    """
    texts = F.transform(parts, lambda p: F.coalesce(p["text"], F.lit("")))
    places = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: _is_attachment(F.get(parts, i)))
    bounds = F.concat(F.array(F.lit(-1)), F.when(F.size(parts) > 0, places).otherwise(F.array().cast("array<int>")), F.array(F.size(parts)))

    def mark(kind: Column) -> Column:
        out = F.lit("")
        for name, placeholder in PLACEHOLDERS.items():
            out = F.when(kind == name, F.lit(placeholder)).otherwise(out)
        return out

    def pieces(v: Column) -> Column:
        def piece(k: Column) -> Column:
            begin, end = F.get(v["bounds"], k) + 1, F.get(v["bounds"], k + 1)
            text = escape(F.array_join(F.slice(v["texts"], begin + 1, end - begin), ""))
            closing = F.when(end < F.size(v["kinds"]), mark(F.get(v["kinds"], end))).otherwise(F.lit(""))
            return F.concat(text, closing)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(v["bounds"]) - 2), piece), "")

    kinds = F.transform(parts, lambda p: F.coalesce(p["kind"], F.lit("")))
    return let(F.struct(bounds.alias("bounds"), texts.alias("texts"), kinds.alias("kinds")), pieces)


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*PLACEHOLDERS), F.lit(False))


def _tokens(part: Column) -> Column:
    per = F.lit(0)
    for kind, n in TOKENS_PER_UNIT.items():
        per = F.when(part["kind"] == kind, F.lit(n)).otherwise(per)
    return per * F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1))


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``(conv_col, formatted, loss, attachments, n_tokens)``.

    loss: array<struct<start, stop>>, the code points of formatted that are the
    content of ``loss_role`` turns, in order.  attachments: array<struct<kind, ref,
    tokens>>, one for each placeholder, in order; n_tokens is their sum.  parts are
    ``PART_TYPE``; null parts and null roles are empty.  Turns are ordered by turn
    (null first), ties by role and content; repeated rows are repeated turns; a
    null conversation id is a conversation.  Other columns are ignored, an empty
    table gives an empty result.  A conversation is one string, so its turns meet
    in one task; that is the only group made.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART_TYPE}>"))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    seen = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        _visit(parts).alias("content"),
        F.transform(
            F.filter(parts, _is_attachment),
            lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
        ).alias("attached"),
    )
    head = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(CONTENT))
    written = seen.withColumn("head", head).withColumn("piece", F.concat("head", "content", F.lit(END)))
    order = Window.partitionBy("conv").orderBy("turn", "role", "content", "attached")
    placed = (
        written.withColumn("nr", F.row_number().over(order))
        .withColumn("at", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("start", len(BEGIN) + F.coalesce("at", F.lit(0)) + F.length("head"))
    )
    row = F.struct("nr", "piece", "attached", F.when(F.col("role") == loss_role, F.struct("start", (F.col("start") + F.length("content")).alias("stop"))).alias("span"))
    met = placed.groupBy("conv").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    attachments = F.flatten(F.col("rows.attached"))
    return met.select(
        F.col("conv").alias(conv_col),
        F.concat(F.lit(BEGIN), F.array_join(F.col("rows.piece"), "")).alias("formatted"),
        F.filter(F.col("rows.span"), lambda s: s.isNotNull()).alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, content, parts>>, unescaped.

    content is the turn's characters, placeholders among them; parts is
    array<struct<kind, text>>, where a placeholder is a part of its kind without
    text and what stands between is text.  Empty texts are no parts.
    """
    body = F.substring(formatted, len(BEGIN) + 1, F.length(formatted))
    pieces = F.filter(F.split(body, END), lambda p: p != "")

    def turn(piece: Column) -> Column:
        # no text holds a bare control string, so the first [/INST] ends the role
        end = F.instr(piece, CONTENT)
        role = F.substring(piece, len(ROLE) + 1, end - len(ROLE) - 1)
        content = F.substring(piece, end + len(CONTENT), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(content).alias("content"), _parts(content).alias("parts"))

    return F.transform(pieces, turn)


def _parts(content: Column) -> Column:
    """array<struct<kind, text>> of escaped content."""

    def typed(v: Column) -> Column:
        text = lambda t: F.struct(F.lit("text").alias("kind"), unescape(t).alias("text"))
        mark = lambda m: F.struct(F.substring(m, F.lit(2), F.length(m) - 2).alias("kind"), F.lit(None).cast("string").alias("text"))
        both = F.flatten(
            F.transform(
                v["texts"],
                lambda t, k: F.when(k < F.size(v["marks"]), F.array(text(t), mark(F.get(v["marks"], k)))).otherwise(F.array(text(t))),
            )
        )
        return F.filter(both, lambda p: (p["kind"] != "text") | (p["text"] != ""))

    marks = F.regexp_extract_all(content, F.lit(_PLACEHOLDER), F.lit(0))
    return let(F.struct(F.split(content, _PLACEHOLDER, -1).alias("texts"), marks.alias("marks")), typed)


def loss_text(formatted: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped, in order, nothing between.

    Each span is unescaped alone: two texts side by side make no escape.
    """
    return F.array_join(F.transform(cut_out(formatted, loss), unescape), "")
