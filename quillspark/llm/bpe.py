"""Byte-pair encoding and decoding of word-end vocabularies, merged by a segment tree.

Over the symbols of one word a segment tree holds the rank of every adjacent
pair.  Its root is the lowest rank, leftmost among equals, so it names the next
merge; a merge changes two pairs and removes one, each a point update of
logarithmic cost.  The word is done when the root holds no rank.
"""

from __future__ import annotations

import itertools
import json
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import give_back

#: What a worker remembers of the ids of texts between white space: at most so many bytes, then it starts anew;
#: texts of more characters than KEEP_CHARS are never remembered.  ENTRY_BYTES is what an entry takes besides its texts.
CACHE_BYTES, KEEP_CHARS, ENTRY_BYTES = 96 << 20, 64, 180
#: Characters that Python's tables and the library's agree on, as a test tells for each; others go through the library's own steps.
KNOWN_ALIKE = "\x00-\u02ff\u0370-\u0377\u0384-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5"
#: Words of up to so many bytes are merged in arrays of at most so many rows; longer ones singly.
BATCH_WORD_BYTES, BATCH_ROWS = 48, 8192
#: Texts are encoded in parts of about so many characters.
PART_CHARS = 2_000_000
_POSITION_BITS = 40
_NONE = 1 << 62


def byte_symbols() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairTree:
    """Segment tree over the adjacent pairs of a symbol sequence."""

    def __init__(self, symbols: list[int], pairs: dict[int, tuple[int, int]]):
        self.symbols, self.pairs = symbols, pairs

    def merged(self) -> list[int]:
        symbols, pairs, none, shift = self.symbols, self.pairs, _NONE, _POSITION_BITS
        n = len(symbols)
        if n < 2:
            return symbols
        leaves = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            pair = pairs.get(symbols[i] << 20 | symbols[i + 1])
            if pair is not None:
                tree[leaves + i] = pair[0] << shift | i
        for k in range(leaves - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        if tree[1] == none:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        mask = (1 << shift) - 1
        while (top := tree[1]) != none:
            i = top & mask
            j = after[i]
            symbols[i] = pairs[symbols[i] << 20 | symbols[j]][1]
            symbols[j] = -1
            k = after[i] = after[j]
            changed = [(j, none)] if j < n - 1 else []
            if k < n:
                before[k] = i
                pair = pairs.get(symbols[i] << 20 | symbols[k])
                changed.append((i, none if pair is None else pair[0] << shift | i))
            else:
                changed.append((i, none))
            h = before[i]
            if h >= 0:
                pair = pairs.get(symbols[h] << 20 | symbols[i])
                changed.append((h, none if pair is None else pair[0] << shift | h))
            for at, value in changed:
                at += leaves
                if tree[at] == value:
                    continue
                tree[at] = value
                while at > 1:
                    at >>= 1
                    a, b = tree[2 * at], tree[2 * at + 1]
                    low = a if a < b else b
                    if tree[at] == low:
                        break
                    tree[at] = low
        return [s for s in symbols if s >= 0]


class BatchPairTrees:
    """The same trees for many words of one length at once, a row of an array each."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        import numpy as np

        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()] + [0], np.int64)
        self.made = np.zeros(len(pairs) + 1, np.int64)
        for rank, new in pairs.values():
            if rank >= len(self.made):
                self.made = np.append(self.made, np.zeros(rank + 1 - len(self.made), np.int64))
            self.made[rank] = new

    def _leaf(self, left, right, at):
        """What the tree holds for the pairs (left, right) that begin at ``at``."""
        import numpy as np

        key = left << 20 | right
        k = np.searchsorted(self.keys, key)
        return np.where(self.keys[k] == key, self.ranks[k] << _POSITION_BITS | at, _NONE)

    def merged(self, symbols):
        """symbols: int64 array, a word in each row.  Returns it merged, -1 where a symbol went."""
        import numpy as np

        rows, n = symbols.shape
        if n < 2 or not rows:
            return symbols
        leaves = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = np.full((rows, 2 * leaves), _NONE, np.int64)
        tree[:, leaves : leaves + n - 1] = self._leaf(symbols[:, :-1], symbols[:, 1:], np.arange(n - 1))
        level = leaves
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = tree[:, 2 * level : 4 * level].reshape(rows, level, 2).min(axis=2)
        # column n stands for "no symbol" on either side, so that every index is good
        after = np.tile(np.arange(1, n + 2), (rows, 1))
        after[:, n] = n
        before = np.tile(np.append(np.arange(-1, n - 1), n), (rows, 1))
        before[:, 0] = n
        ext = np.concatenate([symbols, np.full((rows, 1), (1 << 20) - 1)], axis=1)
        row = np.arange(rows)
        while len(row := row[tree[row, 1] != _NONE]):
            top = tree[row, 1]
            i = top & ((1 << _POSITION_BITS) - 1)
            j = after[row, i]
            k, h = after[row, j], before[row, i]
            new = self.made[top >> _POSITION_BITS]
            ext[row, i], ext[row, j] = new, -1
            after[row, i] = k
            inside = k < n
            before[row[inside], k[inside]] = i[inside]
            tree[row, leaves + i] = np.where(inside, self._leaf(new, ext[row, k], i), _NONE)
            paths = [(row, i)]
            got = j < n - 1
            tree[row[got], leaves + j[got]] = _NONE
            paths.append((row[got], j[got]))
            got = h < n
            tree[row[got], leaves + h[got]] = self._leaf(ext[row[got], h[got]], new[got], h[got])
            paths.append((row[got], h[got]))
            r, at = np.concatenate([p[0] for p in paths]), np.concatenate([p[1] for p in paths]) + leaves
            for _ in range(leaves.bit_length() - 1):
                at = at >> 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])
        return ext[:, :n]


class WordBpe:
    """A lower-casing word-end BPE tokenizer, read from its tokenizers file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or max(vocab.values()) >> 20:
            raise ValueError("this tokenizer's steps are not known")
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [named.get(i, "") for i in range(max(named) + 1)]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.strange = re.compile(f"[^{KNOWN_ALIKE}]")
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = pre_tokenizers.Split(Regex(split), "removed", invert=True)
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.blank = regex.compile(r"\p{White_Space}+")
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.suffix] for s in symbols]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.trees = BatchPairTrees(self.pairs)
        self._forget()

    def _forget(self) -> None:
        """Start anew, with the special tokens alone."""
        self.known: dict[str, bytes] = {u: array("I", [i]).tobytes() for u, i in self.special.items()}
        self.held = 0

    def word(self, word: str) -> list[int]:
        """Ids of one piece that the split pattern made."""
        data = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data[:-1]]
        symbols.append(self.final[data[-1]])
        return PairTree(symbols, self.pairs).merged()

    def word_many(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian u32) of many distinct pieces; those of equal length share an array."""
        import numpy as np

        data = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = list(map(len, data))
        out: dict[str, bytes] = {}
        inner, final = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        for n, group in itertools.groupby(sorted(range(len(words)), key=lengths.__getitem__), key=lengths.__getitem__):
            if n > BATCH_WORD_BYTES:
                out.update((words[k], array("I", self.word(words[k])).tobytes()) for k in group)
                continue
            while part := list(itertools.islice(group, BATCH_ROWS)):
                raw = np.frombuffer(b"".join([data[k] for k in part]), np.uint8).reshape(-1, n)
                symbols = inner[raw]
                symbols[:, -1] = final[raw[:, -1]]
                got = self.trees.merged(symbols)
                left = got >= 0
                ends = (4 * np.cumsum(left.sum(axis=1))).tolist()
                flat = got[left].astype("<u4").tobytes()
                out.update(zip([words[k] for k in part], [flat[a:b] for a, b in zip([0, *ends], ends)]))
        return out

    def _encoded(self, units: list[str]) -> dict[str, bytes]:
        """Ids of distinct texts between white space, which are remembered within the bound.

        Letters alone are one word; others are split by the library's own pattern.
        """
        strange = self.strange.search("".join(units))
        parted = {}
        for u in units:
            if strange and self.strange.search(u):
                parted[u] = [piece for piece, _ in self.splitter.pre_tokenize_str(u)]
            elif not u.isalpha():
                parted[u] = self.words.findall(u)
        ids = self.word_many(list({w for ws in parted.values() for w in ws}.union(u for u in units if u not in parted)))
        out = {u: ids[u] for u in units if u not in parted} if parted else ids
        out.update((u, b"".join([ids[w] for w in ws])) for u, ws in parted.items())
        kept = out if max(map(len, out)) <= KEEP_CHARS else {u: x for u, x in out.items() if len(u) <= KEEP_CHARS}
        size = 2 * sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY_BYTES * len(kept)
        if self.held + size > CACHE_BYTES:
            self._forget()
        if size <= CACHE_BYTES:
            self.known.update(kept)
            self.held += size
        return out

    def _plain(self, text: str) -> list[str]:
        import unicodedata

        if text.isascii():
            # str.split() also cuts at \x1c-\x1f, which are no white space to the tokenizer
            if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return text.lower().split()
        elif self.strange.search(text) or not unicodedata.is_normalized("NFC", text):
            return [u for u in self.normalizer.normalize_str(text).split(" ") if u]
        # each character is lowered for itself: a final sigma has no form of its own
        return [u for u in self.blank.split(text.replace("Σ", "σ").lower()) if u]

    def units(self, text: str) -> list[str]:
        """What stands between white space in the normalised text; special tokens stand alone."""
        if "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._plain(text[at:])

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each whole text its ids as little-endian u32, and what they decode to, in UTF-8."""
        parted = [self.units(t) for t in texts]
        get = self.known.get
        found = [list(map(get, units)) for units in parted]
        need = {u for units, ids in zip(parted, found) if None in ids for u, x in zip(units, ids) if x is None}
        fresh = self._encoded(list(need)) if need else {}
        out = []
        for units, ids in zip(parted, found):
            whole = b"".join([fresh[u] if x is None else x for u, x in zip(units, ids)] if need else ids)
            out.append((whole, self.decode(whole)))
        return out

    def encode(self, text: str) -> tuple[bytes, bytes]:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """What the ids (little-endian u32) decode to: their tokens with spaces between."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids))).encode()


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One tokenizer per worker process; later tasks find its memory filled."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_texts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_array: bool = False
) -> DataFrame:
    """``(id_col, *carry, n_tokens, ids, decoded)`` of every row; decoded is the decoded text.

    ids are binary (little-endian u32), or an array of int with ``as_array``.

    Null texts are empty; empty texts have no ids and decode to nothing.  Repeated
    rows give repeated results, an empty table an empty one; other columns are
    ignored, and so is a carried one that is named like a new one.
    """
    carry = tuple(c for c in carry if c not in ("n_tokens", "ids", "decoded", id_col))

    rows = docs.select(F.col(id_col), *carry, F.col(text_col).cast("string").alias("__text"))
    kept = rows.columns[:-1]
    last = len(kept)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = load(path)
        for b in batches:
            at = 0
            while at < b.num_rows:  # parts of bounded length, whatever the batch holds
                texts, size, begin = [], 0, at
                while at < b.num_rows and (size < PART_CHARS or not texts):
                    texts.append(b.column(last)[at].as_py() or "")
                    size, at = size + len(texts[-1]), at + 1
                got = bpe.encode_many(texts)
                counts = [len(g[0]) // 4 for g in got]
                if as_array:
                    flat = np.frombuffer(b"".join(g[0] for g in got), "<i4")
                    ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat))
                else:
                    ids = pa.array([g[0] for g in got], pa.binary())
                decoded = pa.array([g[1] for g in got], pa.binary()).cast(pa.string())
                carried = [c.slice(begin, at - begin) for c in b.columns[:last]]
                yield pa.RecordBatch.from_arrays([*carried, pa.array(counts, pa.int64()), ids, decoded], names=[*kept, "n_tokens", "ids", "decoded"])
                del texts, got, ids, decoded, carried
                give_back()
            del b
        give_back()

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.mapInArrow(run, f"{kinds}n_tokens long, ids {'array<int>' if as_array else 'binary'}, decoded string")


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``out_col``, the text that ``ids_col`` (binary u32; null: null) decodes to."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        bpe = load(path)
        return ids.map(lambda x: None if x is None else bpe.decode(x).decode())

    return rows.withColumn(out_col, run(F.col(ids_col)))
