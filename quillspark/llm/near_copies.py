"""Near copies by the Jaccard similarity of word shingles: SimHash classes first, completed to a stated similarity.

SimHash over the shingles (:mod:`.simhash`, multi-index hashing) brings copies
of a few changed bits together.  At a similarity of 0.8 fingerprints differ in
about ten of 64 bits, far beyond what Hamming balls can enumerate; so what the
index names is completed by a MinHash filter and a prefix-filtered join:

1.  ``BANDS * ROWS`` minima of a text's distinct shingles, cut into bands.  Two
    texts of similarity s share a band with chance 1 - (1 - s**ROWS)**BANDS,
    which at 0.8 is all but 5 in 100 million.  Texts that share no band with
    another are done.
2.  The shingles of the others are ordered by how many of these texts hold them,
    rarest first.  Two texts of similarity ``least`` or more share a shingle
    within the first (1 - least) of either, at places from which enough is left
    on both sides.  So a passage that many texts share, though half of each, does
    not bring them together.
3.  What meets at a shingle is compared with the text for which it stands
    earliest, then with another, and only what is not yet in one class in pairs.

Every link, whatever named it, is checked on the shingles themselves, told apart
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import SEED, fingerprint_classes, fingerprint_of, shingle_digests
from .store import discard, give_back, save

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 32, 4
#: Differing bits up to which SimHash fingerprints name candidates.
RADIUS = 2
#: How often what meets at a shingle is compared with one text of it, before the rest is compared in pairs.
HUBS = 2


def text_words(text: str | None) -> list[bytes]:
    """Words as in SimHash: A-Z lower-cased, cut at \\x20 and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def distinct_tokens(digests: list[bytes]):
    """The distinct digests as sorted unsigned numbers."""
    import numpy as np

    return np.unique(np.frombuffer(b"".join(digests), ">u8").astype(np.uint64))


def _multipliers():
    import numpy as np

    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
    return (draw() | np.uint64(1))[:, None], draw()[:, None]


def bands_of(tokens, multipliers) -> list[int]:
    """A signed 64-bit entry for each band; no shingles: no entries."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not len(tokens):
        return []
    times, plus = multipliers
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(tokens), 2048):
        low = np.minimum(low, (tokens[None, k : k + 2048] * times + plus).min(axis=1))
    raw = low.tobytes()
    size = ROWS * 8
    return [_signed(xxh64_intdigest(raw[b * size : (b + 1) * size], SEED + b)) for b in range(BANDS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def row_key(id_col: str, text_col: str) -> Column:
    """A digest of id and text; rows with the same key are copies of one row."""
    key, text = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.md5(F.concat(F.length(key).cast("string"), F.lit(":"), key, text).cast("binary"))


def _marks(keyed: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(key, id, node, size, fingerprint, bands)`` of every row; node is the 64-bit hash of the text's words in order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        multipliers = _multipliers()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for b in batches:
            rows = []
            for value in b.column(2):
                words = text_words(value.as_py())
                digests = shingle_digests(words, width)
                tokens = distinct_tokens(digests)
                rows.append((_signed(xxh64_intdigest(b" ".join(words), SEED)), len(tokens), _signed(fingerprint_of(digests)), bands_of(tokens, multipliers)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], names=["key", "id", "node", "size", "fingerprint", "bands"]
            )
            del b, rows, columns
            give_back()

    rows = keyed.select(F.col("__key").alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"key string, id {kind}, node long, size long, fingerprint long, bands array<long>")


def _tokens(texts: DataFrame, width: int) -> DataFrame:
    """``(node, tokens)`` of ``texts(node, text)``: the distinct shingles as signed hashes."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            tokens = [distinct_tokens(shingle_digests(text_words(t.as_py()), width)).astype(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.list_(pa.int64()))], names=["node", "tokens"])
            del b, tokens
            give_back()

    return texts.select("node", "text").mapInArrow(run, "node long, tokens array<long>")


def fingerprint_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)``: every node of a SimHash class, and the smallest node of it."""
    classes = fingerprint_classes(nodes.select("fingerprint").distinct(), radius)
    named = nodes.select("node", "fingerprint").join(classes, "fingerprint").select("node", "root")
    hubs = named.groupBy("root").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return named.join(hubs, "root").where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))


def band_mates(nodes: DataFrame) -> DataFrame:
    """``node`` of those that share a band with another."""
    entries = nodes.select(F.explode("bands").alias("entry"), "node")
    shared = entries.groupBy("entry").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("entry")
    return entries.join(shared, "entry", "left_semi").select("node").distinct()


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """``(token, node, size, pos)``: of each node's shingles, rarest first, those that a similar node must share one of.

    Shingles of one node alone come first and are left out; they count in the places of the others.
    """
    rows = sets.select("node", F.size("tokens").cast("long").alias("size"), F.explode("tokens").alias("token"))
    held = rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(held, "token")
    each = Window.partitionBy("node")
    place = F.row_number().over(each.orderBy("n", "token")) - 1 + F.col("size") - F.count("*").over(each)
    return shared.select("token", "node", "size", place.alias("pos")).where(F.col("pos") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(u, v)`` that have a similarity of ``least`` or more."""
    one = sets.select(F.col("node").alias("u"), F.col("tokens").alias("x"))
    other = sets.select(F.col("node").alias("v"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y")) * (1 + least)
    return pairs.distinct().join(one, "u").join(other, "v").where(both >= least * (F.size("x") + F.size("y")) - 1e-9).select("u", "v")


def similar_classes(nodes: DataFrame, keyed: DataFrame, text_col: str, width: int, least: float) -> DataFrame:
    """``(node, root)`` of the nodes that have a near copy; root is the class's smallest node."""
    hinted = save(fingerprint_pairs(nodes), "fingerprint_pairs")
    mates = band_mates(nodes).unionByName(hinted.select(F.col("u").alias("node"))).unionByName(hinted.select(F.col("v").alias("node")))
    keys = nodes.join(mates.distinct(), "node", "left_semi").select(F.col("key").alias("__key"), "node")
    # copies of a row are one before anything is moved
    texts = keyed.groupBy("__key").agg(F.first(F.col(text_col).cast("string")).alias("text")).join(keys, "__key")
    sets = save(_tokens(texts, width), "sets")
    live = save(prefixes(sets, least).withColumn("root", F.col("node")), "prefixes")
    # enough is left from both places on, and neither is too long for the other
    a, c, i, j = F.col("size"), F.col("other_size"), F.col("pos"), F.col("other_pos")
    fits = (F.least(a - i, c - j) >= (a + c) * (least / (1 + least)) - 1e-6) & (F.least(a, c) >= F.greatest(a, c) * least - 1e-6)
    links, roots = [], None
    for turn in range(HUBS + 1):
        if turn < HUBS:
            order = F.xxhash64("node", F.lit(turn))
            hub = F.min(F.struct(*([F.col("pos").alias("first")] if turn == 0 else []), order.alias("order"), "node", "size", "pos", "root"))
            met = live.groupBy("token").agg(hub.alias("hub")).select("token", *[F.col(f"hub.{n}").alias(f"other{m}") for n, m in (("node", ""), ("size", "_size"), ("pos", "_pos"), ("root", "_root"))])
            pairs = live.join(met, "token").where("root <> other_root").where(fits)
        else:
            other = live.select("token", *[F.col(n).alias(f"other{m}") for n, m in (("node", ""), ("size", "_size"), ("pos", "_pos"), ("root", "_root"))])
            pairs = live.join(other, "token").where("root <> other_root and node < other").where(fits)
        pairs = pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"))
        found = save(_verified(pairs.unionByName(hinted) if turn == 0 else pairs, sets, least), "links")
        if found.isEmpty():
            continue
        links.append(found)
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        roots = connected_components(every)
        if turn < HUBS:
            named = live.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            split = named.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("token")
            following = save(named.join(split, "token", "left_semi"), "unsettled")
            discard(live)
            live = following
    for done in (sets, live, hinted):
        discard(done)
    return roots if roots is not None else nodes.select("node", F.col("node").alias("root")).where("false")


def keep_first_of_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST
) -> DataFrame:
    """``docs`` with one row of each class of near copies: the one with the smallest id, null ids last, then by a digest.

    Texts are linked when the Jaccard similarity of their distinct ``width``-word
    shingles is ``least`` or more; classes are closed over links.  Texts without a
    word are one class.  Rows are chosen as rows: a repeated or null id does not
    remove a row whose text has no near copy.  Exact copies of a row leave one.
    An empty table stays empty.
    """
    keyed = docs.withColumn("__key", row_key(id_col, text_col))
    marks = save(_marks(keyed, id_col, text_col, width), "marks")
    same = [F.first(c).alias(c) for c in ("size", "fingerprint", "bands")]  # rows of one node agree in them
    nodes = save(marks.groupBy("node").agg(F.min("key").alias("key"), *same), "nodes")
    roots = similar_classes(nodes, keyed, text_col, width, least)
    discard(nodes)
    classed = marks.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = classed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("m")).select(F.col("m.key").alias("__key"))
    return keyed.join(first, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
