"""URL filters: host rules, and trust and distrust propagated over the link graph.

Trust is personalised PageRank from trusted hosts along links; distrust is the
same from blocked hosts against the direction of links, so that it reaches those
who link to them.  Hosts are judged by the difference of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, save

DAMPING, MAX_ROUNDS, SETTLED = 0.85, 200, 1e-9
#: A host is blocked when its distrust exceeds its trust by more than this share of a ranked host's mean rank.
THRESHOLD = 1e-7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; none: empty."""
    return F.translate(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; none: empty."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does.

    A rule ``(verdict, "host/path")`` fits its host and all subdomains when the
    path starts with the rule's.  Of equally long ones the first listed wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)`` of distinct hosts that pages of src link to, by absolute links."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(1))
    return (
        pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(found)).alias("dst"))
        .select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .distinct()
    )


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """``(node, rank)``: PageRank over ``edges(src, dst)`` that restarts at ``seeds(node, weight)``.

    Weights are shares of one.  The rank of a node without links out goes back to
    the seeds, which only scales what walks from the seeds collect; so each round
    carries one step of all walks further, and the sum is scaled to one in the end.
    Rounds go on until less than SETTLED is carried (unless ``rounds`` names their
    number); MAX_ROUNDS without that are an error.  Each round sums what links
    carry before it shuffles, and is written; only sums reach the driver.  Null or
    repeated edges count once or not at all; no seeds: no ranks.
    """
    seeds = seeds.where("node is not null and weight > 0").groupBy("node").agg(F.sum("weight").alias("weight"))
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return seeds.select("node", F.col("weight").alias("rank"))
    share = F.col("weight") / total
    state = save(seeds.select("node", share.alias("step"), share.alias("rank")), "ranks")
    clean = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    degree = clean.groupBy("src").agg(F.count("*").alias("degree"))
    links = save(clean.join(degree, "src").select("src", "dst", (damping / F.col("degree")).alias("share")), "links")
    for _ in range(rounds or MAX_ROUNDS):
        carried = links.join(state.select(F.col("node").alias("src"), "step"), "src").where("step > 0")
        # what arrives is the next step, and is added to what has arrived before
        met = carried.select(F.col("dst").alias("node"), (F.col("share") * F.col("step")).alias("step"), F.lit(0.0).alias("rank"))
        met = met.unionByName(state.select("node", F.lit(0.0).alias("step"), "rank")).groupBy("node")
        following = save(met.agg(F.sum("step").alias("step"), (F.sum("rank") + F.sum("step")).alias("rank")), "ranks")
        discard(state)
        state = following
        if (state.agg(F.sum("step")).first()[0] or 0.0) < SETTLED:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks did not settle in {MAX_ROUNDS} rounds")
    discard(links)
    whole = state.agg(F.sum("rank")).first()[0]
    return state.select("node", (F.col("rank") / whole).alias("rank"))


def judge_pages(
    pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD
) -> DataFrame:
    """``pages`` with host, path, rule, trust, distrust (per host; 0 without any) and verdict.

    A rule that fits decides.  Otherwise the page is blocked if its host's
    distrust exceeds its trust by more than ``threshold`` over the number of
    ranked hosts (so that a larger graph sets no higher bar), else allowed.  Trusted
    seeds are hosts by their share of pages that rules allow, blocked seeds by
    those that rules block.  Null urls and urls without a scheme have empty host
    and path, and are allowed.  Repeated rows are judged alike, an empty table
    stays empty; columns named like the new ones are replaced.
    """
    placed = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    ruled = placed.withColumn("rule", rule).withColumn("__said", said)
    seen = save(
        ruled.where("host <> ''").groupBy("host").agg(
            F.count_if(F.col("__said") == "allow").alias("allowed"), F.count_if(F.col("__said") == "block").alias("blocked")
        ),
        "hosts",
    )
    edges = save(host_edges(pages, url_col, html_col), "host_edges")
    # a host counts for the side that most of its ruled pages are on
    trusted = seen.where("allowed > blocked").select(F.col("host").alias("node"), F.lit(1.0).alias("weight"))
    blocked = seen.where("blocked > allowed").select(F.col("host").alias("node"), F.lit(1.0).alias("weight"))
    trust = propagate(edges, trusted).select(F.col("node").alias("host"), F.col("rank").alias("trust"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = propagate(back, blocked).select(F.col("node").alias("host"), F.col("rank").alias("distrust"))
    scores = trust.join(distrust, "host", "full_outer").select(
        F.col("host").alias("__host"), F.coalesce("trust", F.lit(0.0)).alias("__trust"), F.coalesce("distrust", F.lit(0.0)).alias("__distrust")
    )
    bar = threshold / max(1, scores.count())
    judged = ruled.join(scores, F.col("host") == F.col("__host"), "left")
    own = F.when(F.coalesce("__distrust", F.lit(0.0)) - F.coalesce("__trust", F.lit(0.0)) > bar, "block").otherwise("allow")
    return (
        judged.withColumn("trust", F.coalesce("__trust", F.lit(0.0)))
        .withColumn("distrust", F.coalesce("__distrust", F.lit(0.0)))
        .withColumn("verdict", F.coalesce("__said", own))
        .drop("__said", "__host", "__trust", "__distrust")
    )
