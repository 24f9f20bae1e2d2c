"""SimHash near-duplicate classes by multi-index hashing.

A 64-bit fingerprint is cut into SEGMENTS segments.  Of two fingerprints at
``radius`` or fewer differing bits one segment differs in at most radius //
SEGMENTS of them.  So a table holds every distinct fingerprint under (segment,
value of the segment); each fingerprint enumerates the Hamming ball of that
radius around each of its segments, fetches what the table holds under those
values, and the whole 64 bits of every match are verified.

A value that more than BUCKET fingerprints share, as large groups of near copies
make them, would be matched in all pairs.  Fingerprints that touch such a value
are matched by the rest of their bits too: both sides enumerate a ball around
the whole fingerprint of half the radius, and meet at a point between them.  Few
can meet at one point, and links run from each to the smallest there.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import save

SEGMENTS, SEGMENT_BITS = 2, 32
#: Fingerprints that one value of a segment may have before they are matched by all their bits.
BUCKET = 32
#: The seed of XXH64, as Spark's own xxhash64 has it.
SEED = 42


def text_fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the text's ``width``-word shingles, repeats included."""
    # bytes.lower() maps A-Z alone, bytes.split() cuts at \x20 and \x09-\x0D alone
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return fingerprint_of(shingle_digests(words, width))


def shingle_digests(words: list[bytes], width: int) -> list[bytes]:
    """XXH64 of every ``width``-word shingle, repeats included; fewer words are one shingle, none no shingle."""
    from xxhash import xxh64_digest

    if not words:
        return []
    flat = b" ".join(words)
    if len(words) <= width:
        return [xxh64_digest(flat, SEED)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[: len(words) - width]]
    return [xxh64_digest(flat[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


def fingerprint_of(digests: list[bytes]) -> int:
    """The bits that are set in over half the digests; of none zero."""
    import numpy as np

    if not digests:
        return 0
    counts, step = np.zeros(64, np.int64), 1 << 16
    for k in range(0, len(digests), step):
        block = np.frombuffer(b"".join(digests[k : k + step]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fingerprint)`` of every row, the fingerprint as a signed 64-bit long."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            values = [text_fingerprint(t, width) for t in b.column(1).to_pylist()]
            signed = [v - (1 << 64) if v >> 63 else v for v in values]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed, pa.int64())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint long")


def _flips(bits: range, radius: int) -> list[int]:
    """The masks, as signed longs, that change at most ``radius`` of ``bits``; none changed comes first."""
    masks = [sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in itertools.combinations(bits, n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _segment(value: Column, segment: int) -> Column:
    """The bits of one segment, in place."""
    low = segment * SEGMENT_BITS
    mask = ((1 << SEGMENT_BITS) - 1) << low
    return value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def segment_table(distinct: DataFrame) -> DataFrame:
    """``(segment, value, member)``: every fingerprint under the value of each of its segments."""
    entries = [F.struct(F.lit(s).cast("byte").alias("segment"), _segment(F.col("fingerprint"), s).alias("value")) for s in range(SEGMENTS)]
    return distinct.select(F.explode(F.array(*entries)).alias("e"), F.col("fingerprint").alias("member")).select("e.*", "member")


def ball_probes(distinct: DataFrame, radius: int) -> DataFrame:
    """``(segment, value, probe)``: the Hamming ball of ``radius`` around each segment of every fingerprint."""

    def ball(segment: int) -> Column:
        own, bits = _segment(F.col("fingerprint"), segment), range(segment * SEGMENT_BITS, (segment + 1) * SEGMENT_BITS)
        values = F.array(*[own.bitwiseXOR(F.lit(m)) for m in _flips(bits, radius)])
        return F.transform(values, lambda v: F.struct(F.lit(segment).cast("byte").alias("segment"), v.alias("value")))

    balls = F.concat(*[ball(s) for s in range(SEGMENTS)])
    return distinct.select(F.explode(balls).alias("e"), F.col("fingerprint").alias("probe")).select("e.*", "probe")


def _far(u: str, v: str) -> Column:
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v)))


def _links_of_crowds(crowd: DataFrame, radius: int) -> DataFrame:
    """Links within a table of ``fingerprint``, each met at a point between two.

    Of two at most ``radius`` apart, a point lies within radius // 2 of one and
    the rest of the other.  Those within radius // 2 of a point are linked to the
    smallest of them, and so are those further off.
    """
    near = radius // 2
    masks = _flips(range(64), radius - near)
    inner = sum(math.comb(64, n) for n in range(near + 1))  # so many masks, the first ones, stay within near
    point = F.posexplode(F.array(*[F.col("fingerprint").bitwiseXOR(F.lit(m)) for m in masks])).alias("nth", "point")
    met = crowd.select("fingerprint", point)
    least = F.min(F.when(F.col("nth") < inner, F.col("fingerprint"))).over(Window.partitionBy("point"))
    linked = met.select(F.col("fingerprint").alias("u"), least.alias("v"))
    return linked.where((F.col("u") != F.col("v")) & (_far("u", "v") <= radius))


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``(u, v)`` links of a table of distinct ``fingerprint``; the classes they make are complete for ``radius`` (0 to 3)."""
    if radius not in range(4):
        raise ValueError("radius must be from 0 to 3")
    if radius == 0:
        return distinct.select(F.col("fingerprint").alias("u"), F.col("fingerprint").alias("v")).where("false")
    table, probes = segment_table(distinct), ball_probes(distinct, radius // SEGMENTS)
    # the table is the smaller side by far, and no value of it is left with more than BUCKET rows
    counts = table.groupBy("segment", "value").agg(F.count("*").alias("n"))
    crowded = save(counts.where(F.col("n") > BUCKET).select("segment", "value"), "crowded")
    if crowded.isEmpty():
        met = probes.join(table.hint("shuffle_hash"), ["segment", "value"]).where((F.col("probe") < F.col("member")) & (_far("probe", "member") <= radius))
        return met.select(F.col("probe").alias("u"), F.col("member").alias("v"))
    calm = table.join(crowded, ["segment", "value"], "left_anti")
    met = probes.join(calm.hint("shuffle_hash"), ["segment", "value"]).where((F.col("probe") != F.col("member")) & (_far("probe", "member") <= radius))
    crowd = probes.join(crowded, ["segment", "value"], "left_semi").select(F.col("probe").alias("fingerprint")).distinct()
    return met.select(F.col("probe").alias("u"), F.col("member").alias("v")).unionByName(_links_of_crowds(crowd, radius))


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2
) -> DataFrame:
    """``(id_col, fingerprint, component_id)``, one row for each row of ``docs``.

    component_id is the smallest id reachable over links.  Null and empty texts
    have fingerprint zero and link like any other.  Repeated rows give repeated
    results; a null id gets its class but never names one unless alone.  An empty
    table gives an empty result; other columns are ignored.
    """
    own = save(fingerprints(docs, id_col, text_col, width), "fingerprints")
    first = save(own.groupBy("fingerprint").agg(F.min("id").alias("first_id")), "distinct")
    classed = first.join(fingerprint_classes(first.select("fingerprint"), radius), "fingerprint")
    names = classed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classed.join(names, "root").select("fingerprint", "component_id")
    return own.join(named, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def fingerprint_classes(distinct: DataFrame, radius: int) -> DataFrame:
    """``(fingerprint, root)`` of a table of distinct ``fingerprint``, classes closed over links of ``radius`` bits."""
    roots = connected_components(fingerprint_links(distinct, radius))
    joined = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    return joined.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))
