"""Cut texts at plain single spaces, so that each distinct unit is encoded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units kept by a worker before it starts anew; bounds memory, never results.
UNIT_LIMIT = 500_000
#: Begins a unit that follows the one before it without a space.
GLUE = "\x02"
#: Units of one text that are put together at a time.
SLICE = 1 << 18
#: Bytes of texts that are cut and looked up together.
BLOCK_BYTES = 4_000_000


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring texts of about BLOCK_BYTES in all."""
    at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(at):
        end = max(start + 1, int(np.searchsorted(at, (at[start - 1] if start else 0) + BLOCK_BYTES, "right")))
        yield start, end
        start = end


class Runs:
    """Growing arrays of runs of ids, each known by a key."""

    def __init__(self):
        self.index: dict = {}
        self.starts = np.zeros(1024, np.int64)
        self.sizes = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.used = 0

    def add(self, keys: list, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Keys not known so far, with their runs in a row."""
        first, n = len(self.index), len(self.index) + len(keys)
        self.starts, self.sizes = _room(self.starts, n), _room(self.sizes, n)
        self.pool = _room(self.pool, self.used + len(flat))
        self.sizes[first:n] = sizes
        self.starts[first:n] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.index.update(zip(keys, range(first, n)))

    def at(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def take(self, at: np.ndarray) -> np.ndarray:
        return gather(self.pool, self.starts[at], self.sizes[at])


class UnitEncoder:
    """Token ids of whole texts for tokenizers whose splits never cross "one space before a word".

    A unit is a space or a line feed and what follows up to the next of them; a mark between
    a letter and one of them is a unit of its own. If no unit of a text is empty, or begins
    or ends with white space, the text's ids are its units' ids in a row, after those of
    its head, which is what stands before the first unit. All other texts, and those that
    hold GLUE, are encoded whole. `encode_many` gives the ids of texts in a row, and how
    many each has. Arrow cuts the texts and finds the distinct units.
    """

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode_many = encode_many
        self.runs, self.edges = Runs(), set()

    def learn(self, units: list[str], heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the units, all different, and of the heads are; -1 for those that may not stand alone."""
        if len(self.runs.index) > UNIT_LIMIT:
            self.runs, self.edges = Runs(), set()
        index = self.runs.index
        at = np.fromiter(map(index.get, units, repeat(-1)), np.int64, len(units))
        places = np.flatnonzero(at < 0)
        new = list(map(units.__getitem__, places.tolist()))
        edge = np.fromiter((not u.isalpha() and (u in self.edges or _edge(u)) for u in new), bool, len(new))
        self.edges.update(compress(new, edge))
        new = list(compress(new, ~edge))
        first = list({h: None for h in heads if (h,) not in index})
        if new or first:
            at[places[~edge]] = len(index) + np.arange(len(new))
            self.runs.add([*new, *((h,) for h in first)], *self.encode_many([u if u[0] == "\n" else u[1:] if u[0] == GLUE else " " + u for u in new] + first))
        return at, np.fromiter((-1 if h[-1:].isspace() else index[h,] for h in heads), np.int64, len(heads))

    def cut(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each unit's ids are, where each text's units end, and which texts are to be encoded whole."""
        whole = pc.match_substring(part, GLUE).to_numpy(zero_copy_only=False)
        pieces = pc.split_pattern(pc.replace_substring_regex(pc.replace_substring(part, "\n", " \n"), r"(\pL)([.,;:!?]) ", rf"\1 {GLUE}\2 "), " ")
        ends = pieces.offsets.to_numpy()
        values = pieces.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends = ends - ends[0]
        units, heads = self.learn(_strings(values.dictionary), _strings(pieces.values.take(pieces.offsets[:-1])))
        at = units[values.indices.to_numpy()]
        at[ends[:-1]] = heads
        bad = np.concatenate([[0], np.cumsum(at < 0)])
        return at, ends, whole | (bad[ends[1:]] > bad[ends[:-1]])

    def encode_block(self, texts: pa.Array) -> Iterator[Iterator[np.ndarray]]:
        """For each text its ids, in pieces."""
        for a, b in blocks(texts):
            part = texts.slice(a, b - a)
            at, ends, whole = self.cut(part)
            for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                yield iter([self.encode_many([part[i].as_py()])[0]]) if whole[i] else self._slices(at[lo:hi])

    def encode_rows(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For neighbouring texts their ids in a row, and how many each has."""
        for a, b in blocks(texts):
            part = texts.slice(a, b - a)
            at, ends, whole = self.cut(part)
            alone = np.flatnonzero(whole)
            own, own_n = self.encode_many(part.take(pa.array(alone)).to_pylist()) if len(alone) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            at = at[np.repeat(~whole, np.diff(ends))]
            sizes = self.runs.sizes[at]
            sums = np.concatenate([[0], np.cumsum(sizes)])
            kept = np.concatenate([[0], np.cumsum(np.where(whole, 0, np.diff(ends)))])
            counts = np.diff(sums[kept])
            counts[alone] = own_n
            flat = np.empty(int(counts.sum()), np.uint32)
            from_own = np.repeat(whole, counts)
            flat[from_own] = own
            flat[~from_own] = gather(self.runs.pool, self.runs.starts[at], sizes)
            yield flat, counts

    def _slices(self, at: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(0, len(at), SLICE):
            yield self.runs.take(at[i : i + SLICE])


def _strings(a: pa.Array) -> list[str]:
    """`a` without nulls, by one conversion of the whole array."""
    return a.to_numpy(zero_copy_only=False).tolist()


def _edge(unit: str) -> bool:
    word = unit.removeprefix("\n").removeprefix(GLUE)
    return not word or word[0].isspace() or word[-1].isspace()


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + size] in a row."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out
