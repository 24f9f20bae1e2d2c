"""Shards by k-d tree partitioning of document metadata.

A node that must fill several shards is split along its widest dimension (its
extent as a share of the whole table's) at the weighted median, in general at
the share of bytes that its left shards are to get.  Splits come from
distributed histograms: for all nodes of a level at once, each pass sums bytes
over equal steps of the interval that holds the split and then narrows the
interval, until what a step holds is a negligible share of a shard.  Ties of a
dimension are parted by a hash of the id, so a value that a third of all rows
share splits like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import let
from .store import discard, save

LAW = "bytes"
#: What every document takes besides its text.
OVERHEAD = 16
DIMENSIONS = ("d_length", "d_lang", "d_source")
#: A histogram pass has 2**STEP_BITS steps for each node; a key is VALUE_BITS of value and TIE_BITS to part equal ones.
STEP_BITS, VALUE_BITS, TIE_BITS = 12, 16, 24
#: Bytes of the texts that one task writes, at most (one long text aside).
PART_BYTES = 128 << 20
#: A split is settled when the interval around it holds at most this share of one shard's bytes.
TOLERANCE = 0.0005


@dataclass
class Node:
    """A node of the tree; ``left`` and ``right`` are places in the tree's list, -1 for a leaf."""

    first: int
    shards: int
    weight: int = 0
    dim: int = -1
    cut: int = 0
    left: int = -1
    right: int = -1
    box: tuple[tuple[int, int], ...] = ()


@dataclass
class Tree:
    nodes: list[Node]
    depth: int = 0

    @property
    def shards(self) -> int:
        return self.nodes[0].shards

    def node_column(self) -> Column:
        """The place of the leaf, or open node, that a row falls into."""
        dims, cuts, lefts, rights = (longs([getattr(n, k) for n in self.nodes]) for k in ("dim", "cut", "left", "right"))
        if not self.depth:
            return F.lit(0).cast("long")

        def walk(v: Column) -> Column:
            def step(at: Column, _: Column) -> Column:
                key = F.get(v["keys"], F.get(v["dims"], at.cast("int")).cast("int"))
                below = F.when(key < F.get(v["cuts"], at.cast("int")), F.get(v["lefts"], at.cast("int"))).otherwise(F.get(v["rights"], at.cast("int")))
                return F.when(F.get(v["lefts"], at.cast("int")) < 0, at).otherwise(below)

            return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0).cast("long"), step)

        tables = F.struct(F.array(*DIMENSIONS).alias("keys"), dims.alias("dims"), cuts.alias("cuts"), lefts.alias("lefts"), rights.alias("rights"))
        return let(tables, walk)

    def leaves(self) -> list[Node]:
        return [n for n in self.nodes if n.left < 0]


def longs(values: list[int]) -> Column:
    """A constant array<bigint>, written as one string: a plan holds no node for each element."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _with_keys(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``(id, text, size, tie, d_length, d_lang, d_source)``: each dimension a key, value first and tie last.

    Length grows with the logarithm of the size; lang and source are hashed, null
    being a value of its own.
    """
    ties, values = 1 << TIE_BITS, 1 << VALUE_BITS
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")
    )
    sized = rows.withColumn("size", text_size(F.col("text")))
    tied = sized.withColumn("tie", F.pmod(F.xxhash64("id", "size"), F.lit(ties)))

    def key(value: Column) -> Column:
        return (value.cast("long") * ties + F.col("tie")).cast("long")

    log_size = F.least(F.log2("size") * (values / 48), F.lit(values - 1.0))
    return tied.select(
        "id", "text", "size", "tie",
        key(log_size).alias("d_length"),
        key(F.pmod(F.xxhash64("lang"), F.lit(values))).alias("d_lang"),
        key(F.pmod(F.xxhash64("source"), F.lit(values))).alias("d_source"),
    )


def build_tree(meta: DataFrame, shards: int, target_bytes: int | None = None) -> Tree:
    """The tree over ``metadata`` rows, with ``shards`` leaves, or as many as ``target_bytes`` asks for.

    Histograms are summed and searched in Spark: a pass returns one row for each
    node that is being split, the step that its split lies in.
    """
    extent = meta.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    total = extent["total"]
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    box = tuple((extent[f"lo_{d}"] or 0, (extent[f"hi_{d}"] or 0) + 1) for d in DIMENSIONS)
    whole = [hi - lo for lo, hi in box]
    tree = Tree([Node(0, shards, total, box=box)])
    nodes, settled = tree.nodes, TOLERANCE * total / max(1, shards)
    level = [0] if shards > 1 else []
    while level:
        for k in level:
            nodes[k].dim = max(range(len(DIMENSIONS)), key=lambda d: ((nodes[k].box[d][1] - nodes[k].box[d][0]) / whole[d], DIMENSIONS[d]))
        open_ = {k: (*nodes[k].box[nodes[k].dim], 0) for k in level}
        below: dict[int, int] = {}
        while open_:
            found = _crossings(meta.withColumn("node", tree.node_column()), nodes, open_)
            for k, (lo, hi, before) in list(open_.items()):
                n, wide, goal = nodes[k], _step(lo, hi), _goal(nodes[k])
                if k not in found:  # nothing here reaches the goal
                    n.cut, below[k] = hi, n.weight
                    del open_[k]
                    continue
                b, w, at = found[k]
                a, z = lo + b * wide, min(hi, lo + (b + 1) * wide)
                if wide > 1 and w > settled:
                    open_[k] = (a, z, at)
                    continue
                n.cut, below[k] = (a, at) if goal - at < at + w - goal else (z, at + w)
                del open_[k]
        following = []
        for k in level:
            n = nodes[k]
            half, (lo, hi) = n.shards // 2, n.box[n.dim]
            inside = lambda a, z: (*n.box[: n.dim], (a, z), *n.box[n.dim + 1 :])  # noqa: B023, E731
            n.left, n.right = len(nodes), len(nodes) + 1
            nodes.append(Node(n.first, half, below[k], box=inside(lo, n.cut)))
            nodes.append(Node(n.first + half, n.shards - half, n.weight - below[k], box=inside(n.cut, hi)))
            following += [n.left, n.right]
        tree.depth += 1
        level = [k for k in following if nodes[k].shards > 1]
    return tree


def _goal(n: Node) -> float:
    """The bytes that the left side of a node is to get."""
    return n.weight * (n.shards // 2) / n.shards


def _crossings(placed: DataFrame, nodes: list[Node], open_: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """For each open node (from, to, bytes before) the first step at which its goal is reached: (step, its bytes, bytes before it)."""
    order = sorted(open_)
    tables = {
        "dim": [nodes[k].dim for k in order], "lo": [open_[k][0] for k in order], "hi": [open_[k][1] for k in order],
        "step": [_step(*open_[k][:2]) for k in order], "before": [open_[k][2] for k in order],
    }
    goals = F.from_json(F.lit("[" + ",".join(f"{_goal(nodes[k])!r}" for k in order) + "]"), "array<double>")
    of = lambda name: F.get(longs(tables[name]), F.col("nth"))
    nth = {k: i for i, k in enumerate(order)}
    place = F.get(longs([nth.get(k, -1) for k in range(len(nodes))]), F.col("node").cast("int")).cast("int")
    rows = placed.withColumn("nth", place).where("nth >= 0")
    keyed = rows.select("nth", "size", F.get(F.array(*DIMENSIONS), of("dim").cast("int")).alias("v"), of("lo").alias("lo"), of("hi").alias("hi"), of("step").alias("step"))
    sums = keyed.where("v >= lo and v < hi").groupBy("nth", F.expr("(v - lo) div step").alias("bin")).agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("nth").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most 2**STEP_BITS + 1 sums
    running = sums.withColumn("upto", F.sum("size").over(upto) + of("before"))
    crossed = running.where(F.col("upto") >= F.get(goals, F.col("nth"))).groupBy("nth").agg(F.min(F.struct("bin", "size", "upto")).alias("m"))
    return {order[r["nth"]]: (r["m"]["bin"], r["m"]["size"], r["m"]["upto"] - r["m"]["size"]) for r in crossed.collect()}


def _step(lo: int, hi: int) -> int:
    return max(1, -(-(hi - lo) >> STEP_BITS))


def write_shards(
    docs: DataFrame, path: str, shards: int = 40, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", source_col: str = "source",
) -> None:
    """Write ``docs`` to ``path/rows`` as (shard, id, text, place), and ``path/offsets``.

    A shard is dealt to as many parts as its bytes ask for (PART_BYTES, or less
    where there would be fewer parts than shuffle partitions), each row by its tie;
    so tasks hold nearly equal bytes, and equal texts or ids need not meet.  Only
    copies of one row, equal in id and size, share a tie.  A row's slot is its
    place within its part of its shard plus the rows of the shard in earlier parts.
    Null texts are kept as null and weigh nothing but the overhead; null ids are
    ids like others; repeated rows each have a slot; an empty table makes empty
    shards; other columns stay behind.
    """
    spark = docs.sparkSession
    keyed = _with_keys(docs, id_col, text_col, lang_col, source_col)
    meta = save(keyed.select("size", *DIMENSIONS), "metadata")
    tree = build_tree(meta, shards, target_bytes)
    discard(meta)
    each = max(1, min(PART_BYTES, -(-tree.nodes[0].weight // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    parts, firsts, at = [], [], 0
    for n in tree.nodes:
        parts.append(max(1, round(n.weight / each)) if n.left < 0 else 0)
        firsts.append(at)
        at += parts[-1]
    node = F.col("node").cast("int")
    part = F.get(longs(firsts), node) + F.pmod(F.xxhash64("tie", F.lit(7)), F.get(longs(parts), node))
    placed = keyed.withColumn("node", tree.node_column())
    placed = placed.select("id", "text", F.get(longs([n.first for n in tree.nodes]), node).cast("int").alias("shard"), "tie", part.cast("int").alias("part"))
    dealt = placed.repartitionById(at, "part").sortWithinPartitions("tie", "id")
    dealt.select("shard", "id", "text", F.monotonically_increasing_id().alias("place")).write.parquet(f"{path}/rows")
    # a row for each part
    written = spark.read.parquet(f"{path}/rows").groupBy("shard", F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    written.select("shard", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")).coalesce(1).write.parquet(f"{path}/offsets")


def read_shards(spark, path: str) -> DataFrame:
    """``(shard, slot, doc_id, text)`` of every written row; slots of a shard have no gaps from 0."""
    rows = spark.read.parquet(f"{path}/rows").withColumn("part", F.shiftright("place", 33))
    offsets = spark.read.parquet(f"{path}/offsets")
    # a few numbers for each written part; Spark chooses the join by their size
    return rows.join(offsets, ["shard", "part"]).select(
        "shard", (F.col("place") + F.col("shift")).alias("slot"), F.col("id").alias("doc_id"), "text"
    )
