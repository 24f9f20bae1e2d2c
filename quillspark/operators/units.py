"""Sequences of units as matrices of numbers, for kernels that take a whole batch at once."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Vocabulary:
    """The distinct units of a batch with their numbers, and the numbers of their upper and lower case (ASCII letters alone).

    Number -1 stands for no unit and stays what it is.
    """

    def __init__(self, units: pa.Array):
        coded = pa.concat_arrays([units, pc.ascii_upper(units), pc.ascii_lower(units)]).dictionary_encode()
        self.tokens: pa.Array = coded.dictionary
        of = coded.indices.to_numpy()
        self.of_tokens, up, low = of[: len(units)], of[len(units) : 2 * len(units)], of[2 * len(units) :]
        self.upper, self.lower = np.full(len(self.tokens) + 1, -1, np.int32), np.full(len(self.tokens) + 1, -1, np.int32)
        for side in (self.of_tokens, up, low):
            self.upper[side], self.lower[side] = up, low

    def __len__(self) -> int:
        return len(self.tokens)

    @cached_property
    def with_spaces(self) -> pa.Array:
        """The units, and after them each with a space at its end."""
        return pa.concat_arrays([self.tokens, pc.binary_join_element_wise(self.tokens, "", " ")])


class Sequences:
    """``ids[k, :n[k]]`` are the numbers of row k's units, -1 stands beyond its end."""

    def __init__(self, ids: np.ndarray, n: np.ndarray):
        self.ids, self.n = ids, n

    def __len__(self) -> int:
        return len(self.n)

    def widened(self, width: int) -> Sequences:
        more = width - self.ids.shape[1]
        return Sequences(np.pad(self.ids, ((0, 0), (0, more)), constant_values=-1), self.n) if more > 0 else self

    def lists(self, units: pa.Array) -> pa.Array:
        """The rows as lists of ``units``."""
        at = np.append(0, np.cumsum(self.n)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), units.take(pa.array(self.ids[self.ids >= 0])))
