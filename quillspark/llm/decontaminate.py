"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may be met with k = floor(ERROR_RATE * n) word edits.  Cut
into k + 1 pieces, one piece at least stands in any such passage unchanged.  So
exact hits of the pieces, found in one pass of an Aho-Corasick automaton over a
text's normalised words, name every place worth looking at; Myers' bit-parallel
distance then decides how near the item comes there.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import save

ERROR_RATE = 0.2
#: Items are matched in blocks of at most about so many characters, each a pass over the documents.
BLOCK_CHARS = 8_000_000
_APART = re.compile(r"[\W_]+")
#: Scripts written without spaces: each character is a word.
_DENSE = re.compile("([⺀-鿿가-힯豈-﫿\U00020000-\U0003ffff])")


def normal_words(text: str | None) -> list[str]:
    """Case-folded runs of letters and digits."""
    if not text:
        return []
    folded = text.casefold()
    if not folded.isascii() and _DENSE.search(folded):
        folded = _DENSE.sub(r" \1 ", folded)
    return _APART.sub(" ", folded).split()


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """Where n words are cut into budget + 1 pieces of nearly equal length."""
    bounds = [n * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(bounds, bounds[1:]))


def myers(masks: dict[str, int], n: int, words: list[str]) -> tuple[int, int]:
    """(least distance, first end of it) of an n-word item to any stretch of ``words``.

    masks: for each word of the item the bits of its places.  A bit vector of n
    bits holds a column of the distance table; each word of the text costs a few
    operations on it.
    """
    full, high = (1 << n) - 1, 1 << (n - 1)
    plus, minus, distance = full, 0, n
    best, end = n, 0
    for at, w in enumerate(words):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & high:
            distance += 1
        elif mh & high:
            distance -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if distance < best:
            best, end = distance, at + 1
    return best, end


def _masks(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Matcher:
    """The pieces of a block of items, and what it takes to verify them."""

    def __init__(self, items: list[tuple[int, str | None]], error_rate: float = ERROR_RATE):
        import ahocorasick

        self.items = []
        where: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            words = normal_words(text)
            if not words:
                continue
            budget = int(error_rate * len(words))
            for a, b in pieces(len(words), budget):
                where.setdefault(" " + " ".join(words[a:b]) + " ", []).append((len(self.items), a))
            self.items.append((key, words, budget, _masks(words), _masks(words[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def match(self, text: str | None, any_will_do: bool = False) -> list[tuple[object, int, int, int, int, int]]:
        """(item, its words, budget, distance, first word, word after the last) of the best passage of each item found.

        ``any_will_do``: one item is enough.
        """
        words = normal_words(text) if self.items else []
        if not words:
            return []
        flat = " " + " ".join(words) + " "
        windows: dict[int, list[tuple[int, int]]] = {}
        counted, nth = 0, 0
        for last, (length, at) in sorted(self.automaton.iter(flat), key=lambda h: h[0] - h[1][0]):
            begin = last - length + 1
            nth += flat.count(" ", counted, begin)
            counted = begin
            for item, offset in at:
                _, own, budget, _, _ = self.items[item]
                a, b = max(0, nth - offset - budget), min(len(words), nth - offset + len(own) + budget)
                seen = windows.setdefault(item, [])
                if seen and a <= seen[-1][1]:
                    seen[-1] = (min(a, seen[-1][0]), max(b, seen[-1][1]))
                else:
                    seen.append((a, b))
        out = []
        for item, spans in windows.items():
            key, own, budget, masks, reverse = self.items[item]
            best = (budget + 1, 0, 0)
            for a, b in spans:
                distance, end = myers(masks, len(own), words[a:b])
                if distance < best[0]:
                    back = words[max(a, a + end - len(own) - distance) : a + end][::-1]
                    _, length = myers(reverse, len(own), back)
                    best = (distance, a + end - length, a + end)
            if best[0] <= budget:
                out.append((key, len(own), budget, *best))
                if any_will_do:
                    break
        return sorted(out, key=lambda m: (m[0] is not None, m[0], m[1:]))


def _blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in order of their id, block by block; the driver holds one block and one row beyond it."""
    block, size = [], 0
    for row in items.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        text = row[text_col] or ""
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row[id_col], text))
        size += len(text)
    if block:
        yield block


_built: dict[str, Matcher] = {}


def matcher(name: str, block: list[tuple[object, str | None]], error_rate: float) -> Matcher:
    """A worker process builds the automaton of a block once; ``name`` tells blocks apart."""
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(block, error_rate)
    return _built[name]


def _passes(
    items: DataFrame, item_col: str, item_text: str, block_chars: int, start: DataFrame | None, one_pass: Callable[[DataFrame | None, str, list], DataFrame]
) -> DataFrame | None:
    """``one_pass(what the last pass made, name, block)`` for every block of items.

    With more than one block each pass is written before the next block is
    drawn, so neither the driver nor a plan ever holds two.
    """
    blocks, made = _blocks(items, item_col, item_text, block_chars), start
    block = next(blocks, None)
    while block is not None:
        made = one_pass(made, uuid.uuid4().hex, block)
        following = next(blocks, None)
        if following is not None:
            made = save(made, "matched")
        block = following
    return made


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(id_col, item_col, n_words, budget, distance, first_word, last_word)`` for each item found in each document.

    Of several passages of an item in one document the nearest is told, the
    first among equals; words are counted in the normalised text, last exclusive.
    Ids keep their types; a null id is told as null.  Null and empty texts and
    items without a word match nothing.  Repeated rows give repeated results,
    empty tables an empty one, other columns are ignored.  Items go to the
    executors in blocks of bounded size, each block a pass.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = rows.schema["id"].dataType, items.schema[item_col].dataType
    names = [id_col, item_col, "n_words", "budget", "distance", "first_word", "last_word"]
    schema = f"`{id_col}` {kind.simpleString()}, `{item_col}` {item_kind.simpleString()}, " + ", ".join(f"{n} int" for n in names[2:])
    item_type = to_arrow_type(item_kind)

    def one_pass(before: DataFrame | None, name: str, block: list) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            found_in = matcher(name, block, error_rate)
            kinds = [item_type, *[pa.int32()] * 5]
            for b in batches:
                found = [(k, m) for k, t in enumerate(b.column(1)) for m in found_in.match(t.as_py())]
                ids = b.column(0).take(pa.array([k for k, _ in found], pa.int64()))
                columns = list(zip(*[m for _, m in found])) or [()] * 6
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

        found = rows.mapInArrow(run, schema)
        return found if before is None else before.unionByName(found)

    out = _passes(items, item_col, item_text, block_chars, None, one_pass)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` without the rows whose own text holds an item.

    Every row is judged where it is read, by nothing but its text, so ids may be
    null, shared or of any type, and no text is shuffled.  Rows with null and
    empty texts stay; so do all rows if there are no items.  All columns are kept.
    """
    at = docs.columns.index(text_col)

    def one_pass(before: DataFrame | None, name: str, block: list) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            found_in = matcher(name, block, error_rate)
            for b in batches:
                yield b.filter(pa.array([not found_in.match(t.as_py(), any_will_do=True) for t in b.column(at)], pa.bool_()))

        return before.mapInArrow(run, before.schema)

    return _passes(items, item_col, item_text, block_chars, docs, one_pass)
