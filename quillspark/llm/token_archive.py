"""Token-id archive: documents as separately compressed zstandard frames with one shared dictionary.

An archive is a folder of three tables that any store Spark reads can hold:

``dictionary``  one row: dict_hash (sha256 hex), dict_bytes, id_width, end_id
``blocks``      shard, block, first_id, last_id, n_docs, n_tokens, payload
``shards``      shard, start: ids in all shards before it

A payload is a binary block::

    b"QTK1" | sha256 of the dictionary (32) | width u8 | n u32
    valid u8[n] | doc ids i64[n] | ids before, in this shard u64[n]
    n_tokens u64[n] | frame offsets u64[n + 1] | frames

All numbers are little-endian.  Each frame holds one document's ids, so a short
document is read by its block's offset index and one frame alone.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import compress
from operator import not_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"QTK1"
#: Dictionary training reads at most this many texts, of a longer one a stretch of this many characters from anywhere in it.
DICT_SAMPLE_ROWS, DICT_SAMPLE_CHARS, DICT_BYTES = 600, 8_192, 65_536
#: A block ends at so many compressed bytes or so many bytes of ids, whichever comes first (one document aside).
BLOCK_BYTES, BLOCK_RAW_BYTES = 1 << 20, 16 << 20
#: Bytes of texts that a shard is to hold; there are as many shards as that asks for, and at least the shuffle partitions.
SHARD_BYTES = 256 << 20
#: Texts are encoded in parts of about so many characters.
PART_CHARS = 500_000
#: Unseen chunks are encoded in texts of so many.
LEARN_TOGETHER = 200
#: What a worker remembers of chunks' ids: at most so many bytes, then it starts anew; chunks of more characters than
#: KEEP_CHARS are never remembered.  ENTRY_BYTES is what an entry takes besides its texts.
CACHE_BYTES, KEEP_CHARS, ENTRY_BYTES = 384 << 20, 48, 150
#: Texts of which more than this share of chunks is new are encoded as they are: remembering them would not pay.
NEW_SHARE = 0.75
#: So are texts with a new chunk of more characters than this, as scripts without spaces have them.
LONG_CHUNK = 2_000


class ChunkEncoder:
    """Encodes whole texts with the tokenizers library, each distinct chunk of a text once.

    A byte-level tokenizer cuts before a space that stands alone between other
    characters, so a text may be cut there without changing its ids.  Ids of
    chunks come from the library and are remembered within a bound; unseen chunks
    are encoded together as one text and parted at the tokens that carry a space.
    """

    def __init__(self, path: str, width: int):
        import os
        import re

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype(f"<u{width}")
        self.spaced = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for token, i in self.tok.get_vocab().items():
            self.spaced[i] = token.startswith("Ġ")
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.known: dict[str, bytes] = {}
        self.held = 0
        #: Whether the last texts were encoded whole because most of their chunks were new.
        self.new_ones = False

    def _ids(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of a space and each chunk, remembered within the bound; b"" for what can't stand between two cuts."""
        import numpy as np

        width = self.dtype.itemsize
        good = [c for c in chunks if c and not (c[0].isspace() or c[-1].isspace())]
        out = dict.fromkeys(set(chunks).difference(good), b"")
        for k in range(0, len(good), LEARN_TOGETHER):
            some = good[k : k + LEARN_TOGETHER]
            together = self.tok.encode_batch_fast(["a " + " ".join(some)], add_special_tokens=False)[0]
            ids = np.array(together.ids, self.dtype)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(some):
                raw, at = ids.tobytes(), (at * width).tolist()
                out.update(zip(some, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]))
            else:
                out.update((c, self._ids(" " + c)) for c in some)
        kept = out if not out or max(map(len, out)) <= KEEP_CHARS else {c: x for c, x in out.items() if len(c) <= KEEP_CHARS}
        size = 2 * sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY_BYTES * len(kept)
        if self.held + size > CACHE_BYTES:
            self.known, self.held = {}, 0
        if size <= CACHE_BYTES:
            self.known.update(kept)
            self.held += size
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """For each whole text its ids, little-endian."""
        get = self.known.get
        if self.new_ones and len(texts) > 8:
            # the last texts were mostly new: a few of these tell whether it goes on so
            probe = [c for text in texts[::8] for c in text.split(" ")]
            if len({c for c in probe if c not in self.known}) > NEW_SHARE * len(probe):
                return self._whole(texts)
        met, unknown, chunks = [], set(), 0
        for text in texts:
            parts = text.split(" ")
            found = list(map(get, parts))
            open_ = list(compress(range(len(parts)), map(not_, found)))  # unseen, or known not to stand between cuts
            unknown.update([parts[i] for i in open_])
            chunks += len(parts)
            met.append((parts, found, open_))
        new = [c for c in unknown if c not in self.known]
        self.new_ones = len(new) > NEW_SHARE * chunks
        if self.new_ones or (new and max(map(len, new)) > LONG_CHUNK):
            return self._whole(texts)
        fresh = self._learn(new) if new else {}
        out = []
        for text, (parts, found, open_) in zip(texts, met):
            for i in open_:
                found[i] = fresh.get(parts[i])
            if len(parts) > 1 and all([found[i] for i in open_]):
                found[0] = self._ids(parts[0])
                out.append(b"".join(found))
            else:
                out.append(self._apart(text))
        return out

    def _apart(self, text: str) -> bytes:
        """A text in which white space meets white space, cut only where a space stands alone."""
        parts = self.cut.split(text)
        found = list(map(self.known.get, parts[1:]))
        if new := {p for p, x in zip(parts[1:], found) if x is None}:
            fresh = self._learn(list(new))
            found = [fresh[p] if x is None else x for p, x in zip(parts[1:], found)]
        return self._ids(parts[0]) + b"".join(found) if all(found) else self._ids(text)

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


_loaded: dict[tuple[str, int], ChunkEncoder] = {}


def load(path: str, width: int) -> ChunkEncoder:
    """One encoder per worker process; later tasks find its memory filled."""
    if (path, width) not in _loaded:
        _loaded[path, width] = ChunkEncoder(path, width)
    return _loaded[path, width]


def id_width(tokenizer_path: str, end_id: int | None) -> int:
    from tokenizers import Tokenizer

    top = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), (end_id or 0) + 1)
    return 2 if top <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, width: int, n_rows: int) -> bytes:
    """Dictionary bytes from a bounded sample spread over all rows by a hash of the id.

    Any text may be drawn; of one longer than DICT_SAMPLE_CHARS a stretch of that
    length is read, from a place that the hash gives.  Too few samples to train
    on: the samples themselves become raw content.
    """
    import zstandard

    # a share of the rows that holds a few times as many as are wanted, so what reaches the driver does not grow
    share = min(1.0, 4 * DICT_SAMPLE_ROWS / max(1, n_rows))
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    begin = F.pmod(F.shiftright(F.col("h"), 20), F.greatest(F.length("t") - DICT_SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    rows = (
        docs.where(F.length(text_col) > 0)
        .select(order.alias("h"), F.col(text_col).alias("t"))
        .where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
        .select("h", F.substring("t", begin, F.lit(DICT_SAMPLE_CHARS)).alias("t"))
        .orderBy("h", "t")
        .limit(DICT_SAMPLE_ROWS)
        .collect()
    )
    coder = load(tokenizer_path, width)
    samples = [coder.encode(r["t"]) for r in rows]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def pack_block(dict_hash: bytes, width: int, docs: list[tuple[int | None, int, int, bytes]]) -> bytes:
    """docs: (id, ids before it in the shard, number of ids, frame)."""
    import numpy as np

    n, at = len(docs), np.zeros(len(docs) + 1, "<u8")
    at[1:] = np.cumsum([len(d[3]) for d in docs])
    return b"".join(
        [
            MAGIC, dict_hash, struct.pack("<BI", width, n),
            np.array([d[0] is not None for d in docs], "u1").tobytes(),
            np.array([d[0] or 0 for d in docs], "<i8").tobytes(),
            np.array([d[1] for d in docs], "<u8").tobytes(),
            np.array([d[2] for d in docs], "<u8").tobytes(),
            at.tobytes(), *(d[3] for d in docs),
        ]
    )


def unpack_block(payload: bytes, dict_bytes: bytes, only: int | None = None) -> Iterator[tuple[int | None, int, bytes]]:
    """(id, ids before it in the shard, ids as little-endian u32); ``only``: that document alone."""
    import numpy as np
    import zstandard

    if payload[:4] != MAGIC or payload[4:36] != hashlib.sha256(dict_bytes).digest():
        raise ValueError("not a block of this dictionary")
    width, n = struct.unpack_from("<BI", payload, 36)
    at = 41
    valid = np.frombuffer(payload, "u1", n, at)
    ids = np.frombuffer(payload, "<i8", n, at := at + n)
    before = np.frombuffer(payload, "<u8", n, at := at + 8 * n)
    counts = np.frombuffer(payload, "<u8", n, at := at + 8 * n)
    offsets = np.frombuffer(payload, "<u8", n + 1, at := at + 8 * n)
    at += 8 * (n + 1)
    undo = zstandard.ZstdDecompressor(dict_data=_dictionary(dict_bytes))
    for k in range(n) if only is None else np.flatnonzero(valid.astype(bool) & (ids == only)):
        frame = payload[at + int(offsets[k]) : at + int(offsets[k + 1])]
        raw = undo.decompress(frame, max_output_size=max(1, int(counts[k]) * width))
        yield (int(ids[k]) if valid[k] else None), int(before[k]), np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()


def write_archive(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, level: int = 3,
) -> None:
    """Write ``docs`` to the archive ``path`` in ascending id order (ties by a hash of the text; null ids first).

    Null texts are empty documents.  Rows that repeat an id each have their own
    frame.  An empty table gives an archive without blocks.  Other columns are
    ignored.  Rows are dealt by ranges of (id, hash of the text), so neither
    one id nor one text can fill a shard alone unless its rows are equal.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer_path, end_id)
    counted = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted["bytes"] // SHARD_BYTES))
    trained = train_dictionary(docs, id_col, text_col, tokenizer_path, width, counted["n"])
    dict_hash = hashlib.sha256(trained).digest()
    spark.createDataFrame(
        [(dict_hash.hex(), bytearray(trained), width, end_id)],
        "dict_hash string, dict_bytes binary, id_width int, end_id int",
    ).coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        coder = load(tokenizer_path, width)
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(trained))
        end = b"" if end_id is None else np.array([end_id], coder.dtype).tobytes()
        names = ["shard", "block", "first_id", "last_id", "n_docs", "n_tokens", "payload"]
        held, size, raw, block, before = [], 0, 0, 0, 0

        def flush():
            nonlocal held, size, raw, block
            known = [d[0] for d in held if d[0] is not None]
            row = [shard, block, min(known, default=None), max(known, default=None), len(held), sum(d[2] for d in held), pack_block(dict_hash, width, held)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            held, size, raw, block = [], 0, 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for b in batches:
            at, keys = 0, b.column(0).to_pylist()
            while at < b.num_rows:  # parts of bounded length, whatever the batch holds
                texts, chars, begin = [], 0, at
                while at < b.num_rows and (chars < PART_CHARS or not texts):
                    texts.append(b.column(1)[at].as_py() or "")
                    chars, at = chars + len(texts[-1]), at + 1
                for key, ids in zip(keys[begin:at], coder.encode_many(texts)):
                    ids += end
                    frame = squeeze.compress(ids)
                    held.append((key, before, len(ids) // width, frame))
                    before, size, raw = before + len(ids) // width, size + len(frame) + 33, raw + len(ids)
                    if size >= BLOCK_BYTES or raw >= BLOCK_RAW_BYTES:
                        yield flush()
        if held:
            yield flush()

    # range bounds are drawn from a sample of the sort key on the driver, so no text may be part of the key
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
    (
        rows.repartitionByRange(shards, "id", "tie")
        .sortWithinPartitions("id", "tie", "text")
        .select("id", "text")
        .mapInArrow(run, "shard int, block int, first_id long, last_id long, n_docs int, n_tokens long, payload binary")
        .write.option("compression", "uncompressed")
        .parquet(f"{path}/blocks")
    )
    # a number for each shard; their running sum is one task's work
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")).write.parquet(f"{path}/shards")


def _opened(spark: SparkSession, path: str) -> tuple[bytes, DataFrame]:
    head = spark.read.parquet(f"{path}/dictionary").first()
    return bytes(head["dict_bytes"]), spark.read.parquet(f"{path}/blocks")


def read_archive(spark: SparkSession, path: str, derive: dict[str, tuple[str, Callable[[bytes], object]]] | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document; ids is binary, little-endian u32.

    With ``derive`` ({column: (type, function of the ids)}) those columns stand in
    the place of ids, which then never leave the task that reads them.
    """
    trained, blocks = _opened(spark, path)
    placed = blocks.join(spark.read.parquet(f"{path}/shards"), "shard").select("start", "payload")
    derive = {"ids": ("binary", bytes)} if derive is None else derive

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        made = [(f, kinds[kind]) for kind, f in derive.values()]
        types = [pa.int64(), pa.int64(), pa.int64(), *(kind for _, kind in made)]

        def batch(rows: list[list]):
            columns = list(zip(*rows)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "start", "n_tokens", *derive])

        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1)):
                rows: list[list] = []
                for key, before, ids in unpack_block(payload.as_py(), trained):
                    rows.append([key, start + before, len(ids) // 4, *(f(ids) for f, _ in made)])
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    more = "".join(f", {name} {kind}" for name, (kind, _) in derive.items())
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long{more}")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (a list for each row that had this id), by the offset index."""
    trained, blocks = _opened(spark, path)
    found = blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("shard", "block")
    return [
        list(array("I", ids))
        for row in found.select("payload").toLocalIterator()
        for _, _, ids in unpack_block(bytes(row["payload"]), trained, only=doc_id)
    ]
