"""The tables of ``synth`` made in batches: a document's runs as matrices of token numbers.

Tokens are numbered once for a stretch of documents, so equal tokens have equal
numbers and every rule on token places is an operation on whole columns.  What
``synth.tables`` says in SQL is said here in numpy; a test compares both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..operators.units import Sequences, Vocabulary

RUN, RUNS = 16, 1 << 26
#: Bytes of text that are numbered together (a longer text is by itself), and runs that are made at once.
STRETCH, AT_ONCE = 4 << 20, 8192

_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])


def _numbered(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(token numbers, the tokens they stand for, first token of each text and of what follows) of texts without nulls."""
    texts = texts.cast(pa.large_string())
    _, at, body = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    word = ~_BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    offsets = np.append(np.cumsum(word)[starts] - 1, word.sum())
    tokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[word])).dictionary_encode()
    return tokens.indices.to_numpy(), tokens.dictionary.cast(pa.string()), np.searchsorted(starts, at)


def turned(of: Sequences) -> Sequences:
    """Every row with its first token at the end."""
    at = np.arange(1, of.ids.shape[1] + 1)[None, :]
    return Sequences(np.where(at < of.n[:, None], np.roll(of.ids, -1, axis=1), np.where(at == of.n[:, None], of.ids[:, :1], -1)), of.n)


class Runs:
    """Some runs and all that the rules make of them; every table's column is made when it is asked for.

    ``row_id`` is -1 where the document has no id; the column is null there.
    """

    def __init__(self, row_id: np.ndarray, ds: pa.Array, words: Vocabulary, toks: Sequences):
        self.row_id, self.ds, self.words, self.toks = row_id, ds, words, toks
        self.r0 = self.q0 = toks

    def __len__(self) -> int:
        return len(self.row_id)

    def _rest(self, k: int) -> np.ndarray:
        """The row number's rest; -1 where there is no number, as no rule holds there."""
        return np.where(self.row_id < 0, -1, self.row_id % k)

    def _shout(self, of: Sequences, places: list[int]) -> Sequences:
        ids = of.ids.copy()
        ids[:, places] = self.words.upper[ids[:, places]]
        return Sequences(ids, of.n)

    def _choose(self, condition: np.ndarray, yes: Sequences, no: Sequences) -> Sequences:
        width = max(yes.ids.shape[1], no.ids.shape[1])
        a, b = yes.widened(width), no.widened(width)
        return Sequences(np.where(condition[:, None], a.ids, b.ids), np.where(condition, a.n, b.n))

    def _kept(self, of: Sequences, places: list[int]) -> Sequences:
        """Tokens at ``places``, which do not decrease."""
        return Sequences(of.ids[:, places], np.searchsorted(places, of.n, "left"))

    def _corrupt(self, drop: bool, double: bool, shout: bool) -> Sequences:
        places, loud = [], []
        for i in range(RUN):
            if drop and i % 7 == 3:
                continue
            twice = double and i % 11 == 5
            if shout and not twice and i % 5 == 2:
                loud.append(len(places))
            places += [i, i] if twice else [i]
        flat = self._shout(self._kept(self.sw, places), loud)
        return self._choose(self._rest(10) == 0, turned(flat), flat)

    @cached_property
    def distinct(self) -> np.ndarray:
        """Which rows have no token twice."""
        ids = np.sort(self.toks.ids, axis=1)
        return ~((ids[:, 1:] == ids[:, :-1]) & (ids[:, 1:] >= 0)).any(1)

    @cached_property
    def sw(self) -> Sequences:
        p, ids, rows = self._rest(6), self.toks.ids.copy(), np.flatnonzero((self.row_id >= 0) & (self.toks.n > self._rest(6) + 1))
        a, b = p[rows], p[rows] + 1
        ids[rows, a], ids[rows, b] = self.toks.ids[rows, b], self.toks.ids[rows, a]
        return Sequences(ids, self.toks.n)

    src = cached_property(lambda self: self._corrupt(True, True, True))
    t0 = cached_property(lambda self: self.src)
    t1 = cached_property(lambda self: self._corrupt(True, True, False))
    u2 = cached_property(lambda self: self._corrupt(True, False, False))
    u3 = cached_property(lambda self: self._corrupt(False, False, False))
    t2 = cached_property(lambda self: self._choose(self._rest(4) > 0, self.u2, self.t1))
    t3 = cached_property(lambda self: self._choose(self._rest(8) == 1, self.u3, self.t2))
    esrc = cached_property(lambda self: self._shout(self.sw, [i for i in range(RUN) if i % 5 == 2]))
    e0 = cached_property(lambda self: self.esrc)
    e1 = cached_property(lambda self: self._shout(self.sw, [i for i in range(RUN) if i % 5 == 2 and i % 2 == 1]))
    e2 = cached_property(lambda self: self._choose(self._rest(4) > 0, self.sw, self.e1))
    e3 = cached_property(lambda self: self._choose(self._rest(8) == 1, self.toks, self.e2))
    q1 = cached_property(lambda self: self._shout(self.toks, [i for i in range(RUN) if i % 9 == 1]))
    q2 = cached_property(lambda self: self._shout(self.toks, [i for i in range(RUN) if i % 9 == 2]))
    r1 = cached_property(lambda self: self._kept(self.toks, [i for i in range(RUN) if i % 9 != 1]))
    r2 = cached_property(lambda self: self._kept(self.toks, [i for i in range(RUN) if i % 9 != 2]))

    def _segmented(self, rule: np.ndarray) -> pa.Array:
        """Tokens as a text: the one at a place of the row's ``rule`` is glued to the next."""
        at = np.arange(RUN)[None, :]
        spaced = (at % 4 != rule[:, None]) & (at + 1 < self.toks.n[:, None])
        glued = Sequences(np.where(spaced, self.toks.ids + len(self.words), self.toks.ids), self.toks.n)
        return pc.binary_join(glued.lists(self.words.with_spaces), "")

    s1 = cached_property(lambda self: self._segmented(self._rest(4)))
    s2 = cached_property(lambda self: self._segmented(self._later(self._rest(5) == 0)))
    s3 = cached_property(lambda self: self._segmented(self._later(np.where(self._rest(5) == 0, np.where(self._rest(2) == 0, 2, 1), 0))))

    def _later(self, by: np.ndarray) -> np.ndarray:
        return np.where(self.row_id < 0, -1, (self.row_id + by) % 4)

    def column(self, name: str) -> pa.Array:
        if name == "row_id":
            return pa.array(self.row_id, mask=self.row_id < 0)
        value = getattr(self, name)
        return value.lists(self.words.tokens) if isinstance(value, Sequences) else value

    def taken(self, rows: np.ndarray, name: str) -> pa.Array:
        """A column of the given rows."""
        value = getattr(self, name)
        if isinstance(value, Sequences):
            return Sequences(value.ids[rows], value.n[rows]).lists(self.words.tokens)
        return (self.column(name) if name == "row_id" else value).take(pa.array(rows))

    def has_ref(self, k: int) -> np.ndarray:
        return self._rest(3) >= k

    def edits(self, name: str, has: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, correction, is a matter of case alone) of what an equal-length side changes in ``esrc``, by rows."""
        new, old = getattr(self, name).ids, self.esrc.ids
        differs = new != old
        row, i = np.nonzero(differs if has is None else differs & has[:, None])
        corr = new[row, i]
        return row, i, corr, self.words.lower[corr] == self.words.lower[old[row, i]]


def runs_of(batch: pa.RecordBatch) -> Iterator[Runs]:
    """The runs of documents (doc_id, text, lang), some thousand at a time; null texts have none."""
    batch = batch.filter(pc.is_valid(batch.column("text")))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + STRETCH, "right")))
        some = batch.slice(begin, end - begin)
        begin = end
        ids, tokens, first = _numbered(some.column("text"))
        if not len(ids):
            continue
        words = Vocabulary(tokens)
        ids = words.of_tokens[ids]
        doc_id = some.column("doc_id")
        numbers = pc.fill_null(doc_id.cast(pa.int64()), -1).to_numpy()
        if doc_id.null_count < len(doc_id) and (pc.min(doc_id).as_py() < 0 or numbers.max() >= 1 << 37):
            raise ValueError("document ids go from 0 to 2**37 - 1")
        runs = -(-np.diff(first) // RUN)
        doc = np.repeat(np.arange(len(runs)), runs)
        c = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
        row_id = np.where(numbers[doc] < 0, -1, numbers[doc] * RUNS + c)
        start = first[doc] + RUN * c
        n = np.minimum(RUN, first[doc + 1] - start)
        for a in range(0, len(doc), AT_ONCE):
            part = slice(a, a + AT_ONCE)
            places = start[part, None] + np.arange(RUN)[None, :]
            toks = np.where(np.arange(RUN)[None, :] < n[part, None], ids[np.minimum(places, len(ids) - 1)], -1)
            yield Runs(row_id[part], some.column("lang").take(pa.array(doc[part])), words, Sequences(toks, n[part]))


def _stacked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(parts)


def _gec(runs: Runs, columns: list[str]) -> pa.RecordBatch:
    return pa.record_batch([runs.column(c) for c in columns], columns)


def _sides(key: str, count: int, names: dict[str, str], refs: bool) -> Callable[[Runs, list[str]], pa.RecordBatch]:
    def make(runs: Runs, columns: list[str]) -> pa.RecordBatch:
        parts = []
        for k in range(count):
            rows = np.flatnonzero(runs.has_ref(k)) if refs else np.arange(len(runs))
            of = {key: lambda: pa.array(np.full(len(rows), k, np.int32))} | {c: (lambda p=p: runs.taken(rows, f"{p}{k}")) for c, p in names.items()}
            parts.append(pa.record_batch([of[c]() if c in of else runs.taken(rows, c) for c in columns], columns))
        return _stacked(parts)

    return make


def _edits(key: str, count: int, prefix: str, refs: bool) -> Callable[[Runs, list[str]], pa.RecordBatch]:
    def make(runs: Runs, columns: list[str]) -> pa.RecordBatch:
        parts = []
        for k in range(count):
            row, i, corr, same = runs.edits(f"{prefix}{k}", runs.has_ref(k) if refs else None)
            of = {
                key: lambda: pa.array(np.full(len(row), k, np.int32)), "i": lambda: pa.array(i.astype(np.int32)), "corr": lambda: runs.words.tokens.take(pa.array(corr)),
                "cat": lambda: pa.array(["W", "R"]).take(pa.array(same.astype(np.int8))),
            }
            parts.append(pa.record_batch([of[c]() if c in of else runs.taken(row, c) for c in columns], columns))
        return _stacked(parts)

    return make


def _cand(runs: Runs, columns: list[str]) -> pa.RecordBatch:
    parts = []
    for k in range(3):
        rows = np.flatnonzero(runs.has_ref(k))
        for stage in range(4):
            of = {"stage": stage, "ref_id": k}
            parts.append(pa.record_batch([pa.array(np.full(len(rows), of[c], np.int32)) if c in of else runs.taken(rows, c) for c in columns], columns))
    return _stacked(parts)


def _edit_lists(runs: Runs, name: str, has: np.ndarray | None = None) -> pa.Array:
    row, i, corr, same = runs.edits(name, has)
    one = pa.array(np.arange(len(row) + 1, dtype=np.int32))
    fields = {
        "s0": pa.array(i.astype(np.int32)), "s1": pa.array((i + 1).astype(np.int32)), "kind": pa.array(["W", "R"]).take(pa.array(same.astype(np.int8))),
        "correction": pa.ListArray.from_arrays(one, runs.words.tokens.take(pa.array(corr))), "comment": pa.array(["NONE"]).take(pa.array(np.zeros(len(row), np.int8))),
    }
    at = np.append(0, np.cumsum(np.bincount(row, minlength=len(runs)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def _nested(runs: Runs, columns: list[str]) -> pa.RecordBatch:
    """A row for each sentence: its outputs and its references, each with its edits, as arrays."""

    def side(key: str, count: int, prefix: str, refs: bool) -> pa.Array:
        has = np.stack([runs.has_ref(k) if refs else np.ones(len(runs), bool) for k in range(count)], axis=1)
        row, k = np.nonzero(has)
        lists = pa.concat_arrays([_edit_lists(runs, f"{prefix}{j}", has[:, j]) for j in range(count)]).take(pa.array(k * len(runs) + row))
        at = np.append(0, np.cumsum(has.sum(1))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(k.astype(np.int32)), lists], names=[key, "edits"]))

    of = {"outputs": lambda: side("stage", 4, "e", False), "refs": lambda: side("ref_id", 3, "q", True)}
    return pa.record_batch([of[c]() if c in of else runs.column(c) for c in columns], columns)


_WORDS = "array<string>"
_EDITED = "array<struct<s0: int, s1: int, kind: string, correction: array<string>, comment: string>>"
_GEC = {"row_id": "long", "ds": "string"} | {c: _WORDS for c in "toks sw src esrc t0 t1 t2 t3 e0 e1 e2 e3 r0 r1 r2 q0 q1 q2".split()} | {c: "string" for c in ("s1", "s2", "s3")}

#: Every table's columns, those that it has if none are chosen, and what makes it.
TABLES: dict[str, tuple[dict[str, str], list[str], Callable[[Runs, list[str]], pa.RecordBatch]]] = {
    "gec": (_GEC, [c for c in _GEC if c != "sw"], _gec),
    "outputs": (_GEC | {"stage": "int", "hyp": _WORDS, "eq": _WORDS}, ["row_id", "ds", "stage", "hyp", "eq"], _sides("stage", 4, {"hyp": "t", "eq": "e"}, False)),
    "refs": (_GEC | {"ref_id": "int", "ref": _WORDS, "eq": _WORDS}, ["row_id", "ds", "ref_id", "ref", "eq"], _sides("ref_id", 3, {"ref": "r", "eq": "q"}, True)),
    "cand": (_GEC | {"stage": "int", "ref_id": "int"}, ["row_id", "ds", "stage", "ref_id"], _cand),
    "hyp_edit": (_GEC | {"stage": "int", "i": "int", "corr": "string", "cat": "string"}, ["row_id", "ds", "stage", "i", "corr", "cat"], _edits("stage", 4, "e", False)),
    "ref_edit": (_GEC | {"ref_id": "int", "i": "int", "corr": "string", "cat": "string"}, ["row_id", "ds", "ref_id", "i", "corr", "cat"], _edits("ref_id", 3, "q", True)),
    "nested": (_GEC | {"outputs": f"array<struct<stage: int, edits: {_EDITED}>>", "refs": f"array<struct<ref_id: int, edits: {_EDITED}>>"}, ["row_id", "ds", "outputs", "refs"], _nested),
}
