"""The queries over the training-data tables, with their production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decision_list, decontaminate, gam, kd_shards, link_rank, secrets, simhash, token_archive
from .store import fresh_path, spread


def _tokenizer(name: str) -> str:
    """The place of a public tokenizer file; asked for only when a query runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to a token archive and read back from it."""
    path = fresh_path(spark, "archive")
    token_archive.write_archive(_table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_archive.read_archive(spark, path, {"ids_crc32": ("long", zlib.crc32)})


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: fingerprints link at two or fewer differing bits."""
    classes = simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"), width=3, radius=2)
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    rows = bpe.encode_texts(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document, within a fifth of the item's words as edits."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of a decision list learned from labels.quality."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rules = decision_list.learn_rules(decision_list.labelled_statistics(docs, labels))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    judged = decision_list.judge(docs.select("doc_id", "text"), rules)
    return judged.select("doc_id", *[F.col("stats")[c].alias(c) for c in counts], "kept", "rule")


#: The rules that the query's contract names.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op4_link_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    judged = link_rank.judge_pages(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what is read back from the strings."""
    said = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(
        f"select -1L conv_id, 0L turn, 'user' role, {said} text union all select -1L, 1L, 'assistant', {said}"
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    rows = chat.format_conversations(turns.withColumn("parts", chat.text_part(F.coalesce("text", F.lit("")))))
    back = rows.select("conv_id", "formatted", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("lost"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written.cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in forty shards of nearly equal bytes, read back from the shards."""
    path = fresh_path(spark, "shards")
    kd_shards.write_shards(_table(spark, sf_dir, "documents"), path, shards=40)
    return kd_shards.read_shards(spark, path).select(
        "doc_id",
        kd_shards.text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(kd_shards.LAW).alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: spans of the fixed patterns, and those that the Markov models add."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train(secrets.labelled(docs)))

    def of(kind: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"] == kind)

    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.digest_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.digest_text(F.col("secrets")).alias("spans"),
    )


def _remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a quarter of the labels is held out of training."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = gam.train(docs, labels, usable=_remainder() != 2)
    return gam.score_texts(docs, model).select(
        "doc_id",
        F.coalesce(_remainder() == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op3_quality_rules alone, which SQL can express."""
    judged = decision_list.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), [])
    return judged.select("doc_id", *[F.col("stats")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of each fixed pattern op9_secrets finds."""
    return op9_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_kd_shards must hold whatever the tree: all rows and bytes, slots without gaps, shards of nearly equal bytes."""
    rows = op8_kd_shards(spark, sf_dir)
    shards = rows.groupBy("shard").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("longest"), F.count_distinct("slot").alias("slots"),
        F.min("slot").alias("first"), F.max("slot").alias("last"),
    )
    gapless = (F.col("slots") == F.col("n")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1)
    return shards.agg(
        F.count("*").alias("shards"), F.sum("n").alias("documents"), F.sum("bytes").alias("bytes"), F.every(gapless).alias("gapless"),
        # a split may be off by the row that it falls on
        (F.max("bytes") - F.min("bytes") <= 2 * F.max("longest") + 0.02 * F.avg("bytes")).alias("balanced"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_archive": op1_token_archive,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_link_rank": op4_link_rank,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_chat": op7_chat,
    "op8_kd_shards": op8_kd_shards,
    "op9_secrets": op9_secrets,
    "op10_quality_gam": op10_quality_gam,
    "pipeline": pipeline,
    "quality_base_counts": quality_base_counts,
    "secret_base_counts": secret_base_counts,
    "shard_balance": shard_balance,
}

_CONTROL = r"[<\[]\\*(/?s>|/?INST\]|image>|audio>|document>)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rule_cases(value: int) -> str:
    """CASE branches of the longest rule first: its text (1) or its verdict (0)."""
    out = []
    for rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        name, _, rest = rule[1].partition("/")
        out.append(f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{rest}') then '{rule[value]}'")
    return "case " + " ".join(out) + " end"


#: DuckDB statements; queries without one are tested against brute force.
ORACLES: dict[str, str] = {
    "op7_chat": f"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
            union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sized as (
            select *, length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) + 17 as chars
            from turns
        ), met as (
            select conv_id, count(*) as n_turns,
                string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
                coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as lost,
                sum(chars) + 3 as chars
            from sized group by conv_id
        )
        select conv_id, cast(n_turns as bigint) as n_turns, sha256(said) as turns_sha256,
            cast(length(lost) as bigint) as loss_chars, sha256(lost) as loss_sha256, cast(chars as bigint) as formatted_chars
        from met
    """,
    # without links between hosts, as in the tables at hand, a rank is its seed's share
    "op4_link_rank": f"""
        with parted as (
            select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
        ), placed as (
            select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host,
                regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
            from parted
        ), ruled as (
            select *, {_rule_cases(1)} as rule, {_rule_cases(0)} as said from placed
        ), hosts as (
            select host, count(*) filter (where said = 'allow') - count(*) filter (where said = 'block') as lead from ruled where host <> '' group by host
        ), ranked as (
            select host, case when lead > 0 then 1.0::double / (select count(*) from hosts where lead > 0) else 0.0 end as trust,
                case when lead < 0 then 1.0::double / (select count(*) from hosts where lead < 0) else 0.0 end as distrust
            from hosts
        )
        select page_id, r.host, path, rule, coalesce(said, case when coalesce(distrust, 0) > coalesce(trust, 0) then 'block' else 'allow' end) as verdict,
            coalesce(trust, 0.0) as trust, coalesce(distrust, 0.0) as distrust
        from ruled r left join ranked k on r.host = k.host
    """,
    "quality_base_counts": r"""
        with worded as (
            select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
            from documents
        ), windows as (
            select doc_id, i, array_to_string(w[i:i + 7], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from worded where len(w) >= 8) q
        ), often as (
            select doc_id, i from (select *, count(*) over (partition by doc_id, x) as n from windows) q where n > 1
        ), covered as (
            select doc_id, count(distinct place) as n from (select doc_id, unnest(range(i, i + 8)) as place from often) q group by doc_id
        )
        select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
            coalesce(c.n, 0)::bigint as n_repeat_words, (len(w) < 20 or 100 * coalesce(c.n, 0) > 30 * len(w)) as base_failed
        from worded d left join covered c on d.doc_id = c.doc_id
    """,
    "secret_base_counts": r"""
        select doc_id,
            len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 8))::bigint as n_assign,
            len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 16))::bigint as n_access,
            len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 32))::bigint as n_hex
        from documents
    """,
    "shard_balance": """
        select 40::bigint as shards, count(*) as documents, sum(octet_length(encode(coalesce(text, ''))) + 16)::bigint as bytes, true as gapless, true as balanced from documents
    """,
}
