"""Byte-level BPE by segment trees: the leftmost pair of lowest rank is always at the root."""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_units import Runs, UnitEncoder, gather

NONE = np.iinfo(np.int64).max
#: Cells of the trees that are worked on together.
CELLS = 1 << 19


class SegmentTreeBpe:
    """Encoder and decoder for a vocabulary of ranks (token bytes to id).

    A leaf of a piece's tree stands for a byte position where a live token begins, and
    holds (rank of the pair with the next live token, position). Inner nodes hold the
    minimum, so the root names the leftmost best pair. A merge changes three leaves and
    their paths. Pieces of like length are worked on together, one tree for each.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        pairs = [
            (ranks[b[:i]] * self.size + ranks[b[i:]], r)
            for b, r in ranks.items()
            for i in range(1, len(b))
            if b[:i] in ranks and b[i:] in ranks
        ]
        pairs.sort()
        self.pairs = np.array([p for p, _ in pairs] or [-1], np.int64)
        self.merged = np.array([r for _, r in pairs] or [0], np.int64)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.sizes = np.zeros(self.size, np.int64)
        for b, r in ranks.items():
            self.sizes[r] = len(b)
        self.starts = np.cumsum(self.sizes) - self.sizes
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        self.bytes = np.frombuffer(b"".join(b for b, _ in by_id), np.uint8)
        self.units = UnitEncoder(self.encode_texts)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> SegmentTreeBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.size + right
        at = np.minimum(self.pairs.searchsorted(pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.merged[at], -1)

    def merge_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty pieces by merges alone, in a row, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        counts = np.zeros(len(pieces), np.int64)
        parts, order = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for w in np.unique(width).tolist():
            ks = np.flatnonzero(width == w)
            step = max(1, CELLS // w)
            for i in range(0, len(ks), step):
                part = ks[i : i + step]
                ids, counts[part] = self._merge([pieces[k] for k in part.tolist()], sizes[part], w)
                parts.append(ids)
                order.append(part)
        at = np.concatenate(order)
        starts = np.zeros(len(pieces), np.int64)
        starts[at] = np.cumsum(counts[at]) - counts[at]
        return gather(np.concatenate(parts), starts, counts), counts

    def _merge(self, pieces: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        m, bits = len(pieces), width.bit_length() - 1
        at = np.arange(width)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(m, width)
        ids = self.byte_ids[raw]
        alive = at < size[:, None]
        tree = np.full((m, 2 * width), NONE)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        tree[:, width:-1] = np.where((rank >= 0) & alive[:, 1:], (rank << bits) | at[:-1], NONE)
        for level in range(bits - 1, -1, -1):
            a = 1 << level
            np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2], out=tree[:, a : 2 * a])
        # from here on all cells are numbered through: piece * width + position
        end = (np.arange(m) * width + size).repeat(width)
        following = np.arange(1, m * width + 1)
        previous = np.arange(-1, m * width - 1)
        previous[::width] = -1
        ids, alive, tree = ids.ravel(), alive.ravel(), tree.ravel()
        rows = np.flatnonzero(tree[1 :: 2 * width] != NONE)
        while len(rows):
            best = tree[rows * 2 * width + 1]
            i = rows * width + (best & (width - 1))
            ids[i] = best >> bits
            j = following[i]
            k = following[j]
            following[i] = k
            alive[j] = False
            inside = k < end[i]
            previous[k[inside]] = i[inside]
            self._set(tree, j, NONE, bits)
            leaf = np.full(len(i), NONE)
            a = i[inside]
            rank = self._rank(ids[a], ids[k[inside]])
            leaf[inside] = np.where(rank >= 0, (rank << bits) | (a & (width - 1)), NONE)
            self._set(tree, i, leaf, bits)
            h = previous[i]
            back = h >= 0
            h = h[back]
            rank = self._rank(ids[h], ids[i[back]])
            self._set(tree, h, np.where(rank >= 0, (rank << bits) | (h & (width - 1)), NONE), bits)
            rows = rows[tree[rows * 2 * width + 1] != NONE]
        return ids[alive].astype(np.uint32), alive.reshape(m, width).sum(axis=1)

    @staticmethod
    def _set(tree: np.ndarray, cell: np.ndarray, value, bits: int) -> None:
        """Point update: the leaf and the minima on its path."""
        width = 1 << bits
        root = (cell >> bits) * (2 * width)
        node = (cell & (width - 1)) + width
        tree[root + node] = value
        for _ in range(bits):
            node >>= 1
            at = root + 2 * node
            tree[root + node] = np.minimum(tree[at], tree[at + 1])

    def split(self, text: str) -> list[str]:
        """The matches of the pattern; a word of letters, with a mark behind it or not, needs no search."""
        if text[:1] == " ":
            if text[1:].isalpha():
                return [text]
            if text[-1] in ".,;:!?" and text[1:-1].isalpha():
                return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; a piece that is a vocabulary entry is that entry."""
        found = list(map(self.split, texts))
        pieces = list(chain.from_iterable(found))
        known = Runs()
        new = list(set(pieces))
        raw = [p.encode("utf-8") for p in new]
        whole = np.fromiter((self.ranks.get(b, -1) for b in raw), np.int64, len(raw))
        known.add([p for p, w in zip(new, whole) if w >= 0], whole[whole >= 0], np.ones(int((whole >= 0).sum()), np.int64))
        known.add([p for p, w in zip(new, whole) if w < 0], *self.merge_pieces([b for b, w in zip(raw, whole) if w < 0]))
        at = known.at(pieces)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        total = np.concatenate([[0], np.cumsum(known.sizes[at])])
        return known.take(at), np.diff(total[ends], prepend=0)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.starts[ids], self.sizes[ids]).tobytes()


@functools.lru_cache(2)
def _encoder(path: str, pattern: str) -> SegmentTreeBpe:
    return SegmentTreeBpe.from_file(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256, and ids if kept.

    The ranks are read by each worker from `path`, which every machine must have. All other
    columns pass through; columns named like a result are replaced. Null and empty texts
    have no ids, and so the digests of no bytes. Long texts are encoded whole, their
    units in slices. Repeated rows give repeated results; an empty table gives none.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    through = [c for c in docs.columns if c not in (*names, text)]
    src = docs.select(*[F.col(f"`{c}`") for c in through], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = src.drop("__text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if keep_ids:
        schema = schema.add("ids", "binary")

    def run(batches):
        bpe = _encoder(path, pattern)
        for batch in batches:
            counts, digests, back, kept = [], [], [], []
            for parts in bpe.units.encode_block(batch.column("__text")):
                n, ids_hash, text_hash, own = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in parts:
                    n += len(ids)
                    raw = ids.astype("<u4").tobytes()
                    ids_hash.update(raw)
                    text_hash.update(bpe.decode(ids))
                    if keep_ids:
                        own.append(raw)
                counts.append(n)
                digests.append(ids_hash.hexdigest())
                back.append(text_hash.hexdigest())
                kept.append(b"".join(own))
            cols = [batch.column(c) for c in through] + [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_ids, names=through + names)

    return src.mapInArrow(run, schema)
