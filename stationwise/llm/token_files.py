"""Token ids as raw shard files with a minimal perfect hash index beside each."""

from __future__ import annotations

import functools
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .text_units import UnitEncoder

#: First bytes of an index file (fixed value).
MAGIC = b"MPHIDX01"
#: Bits of a level for each key that is still without a place.
GAMMA = 2
#: Texts that the library gets as one.
JOINED = 2000
#: Bytes of text that a shard has on average.
SHARD_BYTES = 64_000_000
#: Bytes that are read from or written to a shard at a time.
IO_BYTES = 4_000_000
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the public splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Hash of (document key, how many equal keys came before it)."""
    return mix(keys.astype(np.int64).view(np.uint64) * C1 + mix(turn.astype(np.uint64) + C2))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: levels of bits, each key in the first level that it has to itself.

    A key's number is how many bits are set before its own, so lookups take constant time.
    Keys that 64 levels don't part (two equal hashes) would be an error.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # arrays of 64-bit words
        words = np.concatenate([*levels, np.zeros(0, np.uint64)])
        self.words = words
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self.first = np.cumsum([0, *map(len, levels)])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, rest = [], hashes
        while len(rest):
            if len(levels) == 64:
                raise ValueError("equal keys have no perfect hash")
            words = -(-GAMMA * len(rest) // 64)
            bit = cls._bit(rest, len(levels), words)
            alone = np.bincount(bit, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = rest[~alone[bit]]
        return cls(levels)

    @staticmethod
    def _bit(hashes: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix(hashes + np.uint64((level + 1) * int(C1) % 2**64)) % np.uint64(64 * words)).astype(np.int64)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each key; an arbitrary one, or -1, for others."""
        out = np.full(len(hashes), -1, np.int64)
        rest = np.arange(len(hashes))
        for level, words in enumerate(self.levels):
            bit = self._bit(hashes[rest], level, len(words))
            word = self.first[level] + (bit >> 6)
            low = (bit & 63).astype(np.uint64)
            here = (self.words[word] >> low) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))
            out[rest[here]] = (self.rank[word] + below)[here]
            rest = rest[~here]
            if not len(rest):
                break
        return out


def index_bytes(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray, id_bytes: int) -> bytes:
    """An index file: MAGIC; bytes of an id, keys, levels, words of each level; the words; start, count and fingerprint by number."""
    h = PerfectHash.build(hashes)
    at = h.lookup(hashes)
    by_start, by_count, prints = np.zeros(len(at), "<i8"), np.zeros(len(at), "<i8"), np.zeros(len(at), "<u4")
    by_start[at], by_count[at], prints[at] = starts, counts, (hashes >> np.uint64(32)).astype(np.uint32)
    head = struct.pack("<III", id_bytes, len(hashes), len(h.levels)) + np.array([len(x) for x in h.levels], "<u4").tobytes()
    return MAGIC + head + h.words.astype("<u8").tobytes() + by_start.tobytes() + by_count.tobytes() + prints.tobytes()


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, files: pafs.FileSystem, path: str):
        raw = io.BytesIO(files.open_input_stream(path + ".idx").read())
        if raw.read(8) != MAGIC:
            raise ValueError(f"{path}.idx is no index")
        self.id_bytes, n, levels = struct.unpack("<III", raw.read(12))
        sizes = np.frombuffer(raw.read(4 * levels), "<u4").astype(np.int64)
        words = np.frombuffer(raw.read(8 * int(sizes.sum())), "<u8").astype(np.uint64)
        self.hash = PerfectHash(np.split(words, np.cumsum(sizes)[:-1]) if levels else [])
        self.starts, self.counts = np.frombuffer(raw.read(8 * n), "<i8"), np.frombuffer(raw.read(8 * n), "<i8")
        self.prints = np.frombuffer(raw.read(4 * n), "<u4")
        self.payload = files.open_input_file(path + ".bin")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of ids of each key; start -1 for keys whose fingerprint says that they aren't here."""
        at = self.hash.lookup(hashes)
        if not len(self.prints):
            return at, np.zeros(len(at), np.int64)
        here = (at >= 0) & (self.prints[at] == (hashes >> np.uint64(32)).astype(np.uint32))
        return np.where(here, self.starts[at], -1), np.where(here, self.counts[at], 0)

    def read(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids of one document, in pieces of bounded size."""
        step = IO_BYTES // self.id_bytes
        for i in range(start, start + count, step):
            n = min(step, start + count - i)
            yield np.frombuffer(self.payload.read_at(n * self.id_bytes, i * self.id_bytes), f"<u{self.id_bytes}").astype("<u4")


@functools.lru_cache(2)
def _encoder(path: str) -> UnitEncoder:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    marks = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    mark = min(marks, key=marks.get, default=None)  # stands between texts that are encoded together

    def together(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special strings, JOINED at a time, cut at the mark."""
        joined = (mark.join([*texts[i : i + JOINED], ""]) for i in range(0, len(texts), JOINED))
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for j in joined for e in tokenizer.encode_batch_fast([j], add_special_tokens=False))])
        ends = np.flatnonzero(flat == marks[mark])
        return flat[flat != marks[mark]], np.diff(ends, prepend=-1) - 1

    def encode_many(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if mark is not None and not any(m in t for t in texts for m in marks):
            return together(texts)
        ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(ids)), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    return UnitEncoder(encode_many)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """The shared folder as every task sees it: by its URI, or a plain path in tests on one machine."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _shard_of(key: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """Null keys come first, in the first shard."""
    n = np.searchsorted(cuts, key.fill_null(0).to_numpy(zero_copy_only=False), "right")
    return np.where(key.is_null().to_numpy(zero_copy_only=False), 0, n).astype(np.int32)


def _turns(keys: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each, in sorted keys with the nulls first."""
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (empty[1:] != empty[:-1])])[: len(keys)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)
    return np.arange(len(keys)) - first + (empty.astype(np.int64) << 40)


class TokenFiles:
    """A folder of shards, its cut points and its manifest (shard, n_docs, n_ids)."""

    def __init__(self, spark: SparkSession, folder: str, cuts: np.ndarray):
        self.spark, self.folder, self.cuts = spark, folder, cuts

    def manifest(self) -> DataFrame:
        """One row per shard that has documents, with `base`, the ids in all shards before it."""
        rows = self.spark.read.parquet(f"{self.folder}/manifest")
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
        return rows.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))

    def read_back(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """Keyed access: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

        `keys` may hold any keys; the k-th row of a key gets the k-th document with it. Keys
        that aren't in the files give no row.
        """
        folder, cuts = self.folder, self.cuts

        def shard(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_shard_of(b.column(0), cuts))], names=["doc_id", "shard"])

        asked = keys.select(F.col(f"`{key}`").cast("long").alias("doc_id")).mapInArrow(shard, "doc_id long, shard int")
        asked = asked.join(self.manifest().select("shard", "base"), "shard").select("shard", "doc_id", "base")
        asked = asked.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"))

        def look_up(batches):
            files, root = _open(folder)
            for number, table in _by_shard(batches):
                reader = ShardReader(files, f"{root}/{number:08d}")
                empty = table.column("doc_id").is_null().to_numpy()
                doc = table.column("doc_id").fill_null(0).to_numpy()
                starts, counts = reader.find(key_hash(doc, _turns(doc, empty)))
                here = np.flatnonzero(starts >= 0)
                crc = np.zeros(len(here), np.int64)
                for k, i in enumerate(here.tolist()):
                    for ids in reader.read(int(starts[i]), int(counts[i])):
                        crc[k] = zlib.crc32(ids.tobytes(), int(crc[k]))
                base = table.column("base").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(doc[here], mask=empty[here]), pa.array(base[here] + starts[here]), pa.array(counts[here]), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return asked.mapInArrow(look_up, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _by_shard(batches) -> Iterator[tuple[int, pa.Table]]:
    """Neighbouring rows of one shard: keys only, so a shard's rows fit in memory."""
    now, held = None, []
    for b in batches:
        n = b.column("shard").to_numpy()
        edges = np.flatnonzero(np.diff(n)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(n)]):
            if hi == lo:
                continue
            if now is not None and n[lo] != now:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = int(n[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_bytes: int = 2, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Encode every whole text, add `end_id` to each, and write ids in ascending key order.

    Each shard is a range of keys: a `.bin` of little-endian unsigned ids of `id_bytes`
    bytes and an `.idx` that maps a key to its place. Ids that don't fit are an error. The
    folder is new, under the shared folder of the cluster. A task writes under names of
    its own and moves a file into place when it is whole, so lost or repeated tasks do no
    harm. Cut points are quantiles of the keys, one per shard.

    Null texts are empty and have the end id only; null keys come first; rows with equal
    keys go by their ids and are told apart by their place among their equals. An empty
    table gives no shards.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    total = src.agg(F.sum(F.octet_length("__text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_bytes))
    marks = [i / shards for i in range(1, shards)]
    cuts = src.agg(F.percentile_approx("doc_id", marks, max(10_000, 20 * shards)).alias("c")).first()["c"] if marks else None
    cuts = np.unique(np.array(cuts or [], np.int64))
    folder = scratch_path(spark, "token-files")
    kind = f"<u{id_bytes}"

    def encode(batches):
        """Rows of neighbouring documents share one buffer of ids, cut by offsets."""
        units = _encoder(tokenizer)
        for b in batches:
            shard, at = _shard_of(b.column("doc_id"), cuts), 0
            for flat, counts in units.encode_rows(b.column("__text")):
                if max(end_id, int(flat.max(initial=0))) >= 1 << (8 * id_bytes):
                    raise ValueError(f"id {max(end_id, int(flat.max(initial=0)))} needs more than {id_bytes} bytes")
                ends = np.cumsum(counts + 1)
                ids = np.full(int(ends[-1]), end_id, kind)
                text_id = np.ones(len(ids), bool)
                text_id[ends - 1] = False
                ids[text_id] = flat
                cells = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]) * id_bytes), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(shard[at : at + len(ends)]), b.column("doc_id").slice(at, len(ends)), cells.cast(pa.binary())], names=["shard", "doc_id", "ids"])
                at += len(ends)

    def write(batches):
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        now = None
        for b in batches:
            for shard, doc, ids in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids")):
                if shard != now:
                    if now is not None:
                        yield close(files, root, now, temp, out, docs_, counts)
                    now, docs_, counts = shard, [], []
                    temp = f"{root}/{shard:08d}.{uuid.uuid4().hex}"
                    out = files.open_output_stream(temp + ".bin", buffer_size=IO_BYTES)
                raw = ids.as_buffer()
                out.write(raw)
                docs_.append(doc)
                counts.append(raw.size // id_bytes)
        if now is not None:
            yield close(files, root, now, temp, out, docs_, counts)

    def close(files, root, shard, temp, out, docs_, counts):
        out.close()
        empty = np.array([d is None for d in docs_])
        keys = np.array([d or 0 for d in docs_], np.int64)
        n = np.array(counts, np.int64)
        with files.open_output_stream(temp + ".idx") as f:
            f.write(index_bytes(key_hash(keys, _turns(keys, empty)), np.cumsum(n) - n, n, id_bytes))
        for end in (".idx", ".bin"):
            files.move(temp + end, f"{root}/{shard:08d}{end}")
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["shard", "n_docs", "n_ids"])

    encoded = src.mapInArrow(encode, "shard int, doc_id long, ids binary")
    ordered = encoded.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
    ordered.mapInArrow(write, "shard int, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return TokenFiles(spark, folder, cuts)
