"""Exact Jaccard self-join of word shingle sets: rare-first blocks, and a signature tree in each block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text_units import blocks
from .token_files import mix

#: A shingle of at least max(COMMON_LEAST, documents / COMMON_PART) documents goes last in the order of shingles.
#: At most COMMON_PART * (mean shingles of a document) shingles can be so common, whatever the number of documents.
COMMON_PART, COMMON_LEAST = 4096, 32
#: Shingles in a chunk of a block; larger blocks are cut, and each pair of chunks is a task of its own.
CHUNK_SHINGLES = 1 << 20
#: Children of a tree's node, and documents of a leaf.
FAN = 16
#: Bits of a signature for each shingle, and at most.
BITS_PER, BITS_MOST = 4, 1 << 16
#: A key of more than 1 / HOT_PART of a join's rows is cut into SALTS parts.
HOT_PART, SALTS = 1024, 64
#: Bytes of text hashed at a time.
SEGMENT = 1_000_000

_RANDOM = np.random.default_rng(20250101)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = _RANDOM.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x2545F4914F6CDD1D)


def placed(byte: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """64 bits for a byte at its place in a word; no sum over places is linear in the bytes, so no two long words collide by their build."""
    return mix(_BYTE[byte] + offset.astype(np.uint64) * _STEP)


#: Places of a word that are looked up; further ones are computed.
_NEAR = 64
_PLACED = placed(np.tile(np.arange(256), _NEAR), np.repeat(np.arange(_NEAR), 256))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word, A-Z lower-cased; words are what white space leaves."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    begin = 0
    while begin < len(raw):
        end = min(len(raw), begin + SEGMENT)
        while end < len(raw):  # up to the next white space
            gap = np.flatnonzero(_SPACE[raw[end : end + SEGMENT]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(raw), end + SEGMENT)
        part = raw[begin:end]
        inside = ~_SPACE[part]
        first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if len(first):
            at = np.flatnonzero(inside)
            bounds = np.searchsorted(at, first)
            offset = np.arange(len(at)) - np.repeat(bounds, np.diff(np.append(bounds, len(at))))
            value = _PLACED[np.minimum(offset, _NEAR - 1) * 256 + part[at]]
            far = np.flatnonzero(offset >= _NEAR)
            value[far] = placed(part[at[far]], offset[far])
            hashes.append(mix(np.add.reduceat(value, bounds)))
            starts.append(first + begin)
        begin = end
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of `size` words; the whole text is one if it has fewer."""
    for a, b in blocks(texts):
        part = texts.slice(a, b - a)
        n = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer(b" ".join([*(x.as_buffer() for x in part), b""]), np.uint8)
        ends = np.cumsum(n + 1)
        words, starts = word_hashes(raw)
        bounds = np.searchsorted(starts, np.concatenate([[0], ends])).tolist()
        window = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            window += words[k : k + len(window)] * _PLACE[k]
        window = mix(window)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= size:
                yield np.unique(window[lo : hi - size + 1])
            elif hi > lo:
                yield mix(np.array([(words[lo:hi] * _PLACE[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64))
            else:
                yield window[:0]


def node_of(tokens: np.ndarray) -> int:
    """64 bits that name a set; equal sets are one node."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


class Rule:
    """Two sets match if their intersection times `den` is at least their union times `num`."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least_overlap(self, n: np.ndarray) -> np.ndarray:
        """Of two sizes summing to n."""
        return -(-self.num * n // (self.num + self.den))

    def prefix(self, n: int) -> int:
        """So many first shingles, in an order that all sets share, meet those of each match."""
        return n - -(-self.num * n // self.den) + 1

    def class_starts(self, most: int) -> np.ndarray:
        """Sizes at which classes begin; a match is in the same class or a neighbour."""
        starts = [1]
        while starts[-1] <= most:
            starts.append(starts[-1] * self.den // self.num + 1)
        return np.array(starts)


def signature(tokens: np.ndarray) -> bytes:
    """Bitmap of a set: the low bits of each shingle's hash number a bit."""
    bits = min(BITS_MOST, max(64, 1 << (BITS_PER * max(len(tokens), 1) - 1).bit_length()))
    flags = np.zeros(bits, bool)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def bitmap_matrix(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of sets as rows; longer ones are folded to the shortest, half on half."""
    words = min(len(m) for m in maps) // 8
    out = np.zeros((len(maps), words), np.uint64)
    for k, m in enumerate(maps):
        out[k] = np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, words), axis=0)
    return out


class SignatureTree:
    """Sets under nodes that hold the OR of their bitmaps, the least size, and most shingles beyond one a bit."""

    def __init__(self, maps: np.ndarray, n: np.ndarray):
        self.levels = [(maps, n, n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            maps, low, excess = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(excess, at)))

    def may_match(self, level: int, i: slice, j: slice, rule: Rule) -> np.ndarray:
        """Node pairs whose largest possible overlap is enough for the least sizes under them."""
        maps, low, excess = self.levels[level]
        common = np.bitwise_count(maps[i, None] & maps[None, j]).sum(axis=2, dtype=np.int64)
        most = common + np.minimum(excess[i, None], excess[None, j])
        return most >= rule.least_overlap(low[i, None] + low[None, j])


def tree_links(maps: list[bytes], n: np.ndarray, place: np.ndarray, rule: Rule, own: np.ndarray, chunk: np.ndarray, sets: list[np.ndarray] | None) -> Iterator[tuple[int, int]]:
    """Links that join all that matches join, without those between sets already joined.

    Without `sets`, a match is what the bitmaps can't rule out. Only pairs with at least one
    `own` set count, and if there are two chunks, pairs across them. `place` orders the
    leaves. The dual traversal starts with the top node and itself and descends to node
    pairs whose overlap bound suffices; pairs under one component are skipped.
    """
    back = np.lexsort([place, chunk])
    n, own, chunk = n[back], own[back], chunk[back]
    tree = SignatureTree(bitmap_matrix([maps[k] for k in back]), n)
    across = len(np.unique(chunk)) > 1
    group = np.arange(len(n))
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        span = FAN**level
        a, b = group[i * span : (i + 1) * span], group[j * span : (j + 1) * span]
        if a[0] == b[0] and (a == a[0]).all() and (b == b[0]).all():
            continue
        below = len(tree.levels[level - 1][0])
        si, sj = slice(i * FAN, min(below, (i + 1) * FAN)), slice(j * FAN, min(below, (j + 1) * FAN))
        if level > 1:
            for x, y in zip(*np.nonzero(tree.may_match(level - 1, si, sj, rule))):
                if si.start + x <= sj.start + y:
                    stack.append((level - 1, si.start + x, sj.start + y))
            continue
        good = tree.may_match(0, si, sj, rule) & (group[si, None] != group[None, sj]) & (own[si, None] | own[None, sj])
        good &= np.minimum(n[si, None], n[None, sj]) >= rule.least_overlap(n[si, None] + n[None, sj])
        if across:
            good &= chunk[si, None] != chunk[None, sj]
        for x, y in zip(*np.nonzero(good)):
            x, y = int(si.start + x), int(sj.start + y)
            if x < y and group[x] != group[y]:
                if sets is not None:
                    one, two = sets[back[x]], sets[back[y]]
                    overlap = len(np.intersect1d(one, two, assume_unique=True))
                    if rule.den * overlap < rule.num * (len(one) + len(two) - overlap):
                        continue
                group[group == group[y]] = group[x]
                yield int(back[x]), int(back[y])


def block_links(members: DataFrame, facts: DataFrame, payload: DataFrame, rule: Rule, exact: bool) -> DataFrame:
    """Links (a, b) between nodes of the same block, by a signature tree in each part of a block.

    `members` has block and node, `facts` n and kind of each node, `payload` what a task needs of
    it: low and map, or tokens if `exact`. A block is cut by size class (kind): a set also
    visits the class below its own, to meet sets one class smaller. Parts of more than
    CHUNK_SHINGLES shingles are cut to chunks, and each pair of chunks is a part.
    """
    visits = members.join(facts, "node").select("block", "node", "n", "kind", F.explode(F.array(F.lit(0), F.lit(1))).alias("guest")).withColumn("kind", F.col("kind") - F.col("guest"))
    totals = visits.groupBy("block", "kind").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.min("guest").alias("guest")).filter("rows > 1 and guest = 0")
    visits = visits.join(totals.select("block", "kind", F.ceil(F.col("total") / CHUNK_SHINGLES).cast("int").alias("chunks")), ["block", "kind"])
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    visits = visits.withColumn("chunk", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    visits = visits.select("block", "kind", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "chunk", "guest", "node")
    by = ["block", "kind", "one", "two"]
    parts = visits.join(payload, "node").repartition(*by).sortWithinPartitions(*by)

    def link(batches):
        held, now = {}, None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in (*by, "node", "chunk", "guest")]
            sent = [b.column(c) for c in (("tokens",) if exact else ("n", "low", "map"))]
            found = []
            for k, row in enumerate(zip(*cols)):
                if row[:4] != now:
                    found += part_links(held)
                    held, now = {}, row[:4]
                held[row[4]] = (*row[5:], *(c[k].as_py() for c in sent))
            yield edges(found)
        yield edges(part_links(held))

    def part_links(held):
        if len(held) < 2:
            return []
        names, rows = list(held), list(zip(*held.values()))
        chunk, guest = np.array(rows[0]), np.array(rows[1])
        if guest.all():
            return []
        if exact:
            sets = [np.frombuffer(t, np.uint64) for t in rows[2]]
            n, low, maps = np.array([len(t) for t in sets]), np.array([int(t[0]) for t in sets], np.uint64), [signature(t) for t in sets]
        else:
            sets, n, low, maps = None, np.array(rows[2]), np.array(rows[3]), list(rows[4])
        return [(names[x], names[y]) for x, y in tree_links(maps, n, low, rule, guest == 0, chunk, sets)]

    def edges(found):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return parts.mapInArrow(link, "a long, b long")


def attach(rows: DataFrame, table: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """rows left-joined on `key` with a table of one row per key; a key of many rows, and null keys, go to many tasks.

    The table is a written one, and its column `held` counts the rows of each key, `total`
    at most together. Keys of more than total / HOT_PART rows are hot, so there are fewer
    than HOT_PART of these, and their list goes along with the tasks. Their rows are cut into
    SALTS parts by a hash of the column `spread`, and the table's row comes once a part.
    """
    is_hot = F.col("held") > total // HOT_PART
    hot = F.broadcast(table.filter(is_hot).select(F.col(key).alias("__key")))
    salt = F.when(F.col(key).isNull() | F.col("__key").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0))
    left = rows.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", salt.cast("int")).drop("__key")
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(table.withColumn("__salt", F.explode(parts)).drop("held"), [key, "__salt"], "left").drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of each node on an edge (a, b): large and small stars in turn until nothing changes."""
    held = F.count("*").alias("held")
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    before, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), held), "low")
        large = attach(both.filter("b > a"), low, "a", "b", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), held), "low")
        small = attach(large, low, "a", "b", n).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = written(small.filter("a != b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, n = now, now[0]
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach, its own included).

    A document's set is its distinct shingles of `size` words (fewer words: all of them as
    one). Documents link when intersection / union >= num / den; the join is exact on
    64-bit shingle hashes.

    1. Equal sets are one node, named by 64 bits of a digest.
    2. Shingles are ordered by hash, the most common last. Matching sets share a shingle
       among their first few (prefix filter), so those are shuffled, and each shingle's
       nodes join the block of their smallest node. A shingle is in a document once, so
       the most common of them is a small share of the rows.
    3. In each block, cut by size class and where large by chunk pairs, the dual traversal of
       a signature tree over bitmaps joins all pairs that the bitmaps can't rule out.
    4. The components of these bring their whole sets together, again in parts with a
       tree each, whose traversal now verifies pairs that aren't joined yet exactly.
    5. Connected components of the verified links, by stars, in written rounds.

    Null and empty texts have no shingles and stand alone. Null keys take no part as
    smallest; a document without a key has its component's. Rows of one key with
    different texts are in one component each, by their texts. Extra columns are ignored;
    an empty table gives no rows.
    """
    rule = Rule(num, den)
    src = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    starts = rule.class_starts(1 << 40)

    def sign(batches):
        """A row per document (with the bitmap of each set once in a task), and one per shingle that several sets of a batch share."""
        known = set()
        for b in batches:
            n, nodes, low, maps, seen, parts = [], [], [], [], set(), [np.zeros(0, np.uint64)]
            for s in shingle_sets(b.column("text"), size):
                node = node_of(s) if len(s) else None
                new = len(s) and node not in known
                known.add(node)
                n.append(len(s))
                nodes.append(node)
                low.append(int(s[:1].view(np.int64)[0]) if new else None)
                maps.append(signature(s) if new else None)
                if node not in seen:
                    seen.add(node)
                    parts.append(s)
            token, count = np.unique(np.concatenate(parts), return_counts=True)
            token, count = token[count > 1], count[count > 1]
            kind = pa.array(np.searchsorted(starts, n, "right").astype(np.int64))
            no_token = pa.nulls(len(n), pa.int64())
            docs_ = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), kind, pa.array(low, pa.int64()), pa.array(maps, pa.binary()), no_token, no_token]
            yield pa.RecordBatch.from_arrays(docs_, names=SIGNED)
            none = [pa.nulls(len(token), c.type) for c in docs_[:6]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(token.view(np.int64)), pa.array(count)], names=SIGNED)

    signed = written(src.mapInArrow(sign, ", ".join(f"{c} {'binary' if c == 'map' else 'long'}" for c in SIGNED)), "signed")
    own = signed.filter("n is not null").select("doc_id", "n", "node")
    total = own.filter("node is not null").count()
    least = max(COMMON_LEAST, total // COMMON_PART)
    common = signed.filter("token is not null").groupBy("token").agg(F.sum("count").alias("count")).filter(F.col("count") >= least).select("token")
    common = np.sort(common.toPandas()["token"].to_numpy(np.int64).view(np.uint64))  # bounded, see COMMON_PART

    def firsts(batches):
        """(token, node) of the prefix of each set, once in a task."""
        seen = set()
        for b in batches:
            tokens, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s in shingle_sets(b.column("text"), size):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                late = _among(s, common)
                first = np.concatenate([s[~late], s[late]])[: rule.prefix(len(s))]
                tokens.append(first)
                nodes.append(np.full(len(first), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], names=["token", "node"])

    def meet(batches):
        """(block, node) for each token with several nodes; the block is the smallest of them. Rows come by token and node."""
        last_token = last_block = None
        for b in batches:
            token, node = b.column("token").to_numpy(), b.column("node").to_numpy()
            if not len(token):
                continue
            new = np.concatenate([[token[0] != last_token], token[1:] != token[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            block = np.where(at >= 0, node[at], last_block if last_block is not None else 0)
            last_token, last_block = token[-1], block[-1]
            pairs = np.unique(np.stack([block, node], axis=1)[block != node], axis=0)
            if len(pairs):
                heads = np.unique(pairs[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[:, 0], heads])), pa.array(np.concatenate([pairs[:, 1], heads]))], names=["block", "node"])

    shared = src.mapInArrow(firsts, "token long, node long").repartition("token").sortWithinPartitions("token", "node")
    members = written(shared.mapInArrow(meet, "block long, node long").distinct(), "members")

    facts = signed.filter("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("kind").alias("kind"))
    bitmaps = signed.filter("map is not null").select("node", "n", "low", "map")  # again in another task is harmless
    likely = components(block_links(members, facts, bitmaps, rule, exact=False))

    # one document of each node that has a likely partner brings its whole set
    nodes = own.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("held"))
    some = nodes.join(likely.select("node"), "node", "left_semi").select(F.col("low").alias("doc_id")).filter("doc_id is not null").distinct()

    def whole(batches):
        for b in batches:
            sets = [s for s in shingle_sets(b.column("text"), size) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])

    sets = src.join(some, "doc_id", "left_semi").select("text").mapInArrow(whole, "node long, tokens binary")
    # nodes that only documents without a key have: no doc_id names them, so those documents are asked for their node
    unnamed = likely.join(nodes.filter("low is null"), "node", "left_semi").select("node")
    keyless = src.filter("doc_id is null").select("text").mapInArrow(whole, "node long, tokens binary")
    sets = sets.unionByName(keyless.join(unnamed, "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens")))
    roots = components(block_links(likely.withColumnRenamed("root", "block"), facts, sets, rule, exact=True))
    nodes = written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")
    least_id = written(nodes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("held")), "roots")
    named = written(attach(nodes, least_id, "root", "node", total).select("node", "component_id", "held"), "named")
    return attach(own, named, "node", "doc_id", total).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


SIGNED = ["doc_id", "n", "node", "kind", "low", "map", "token", "count"]


def _among(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stand for their component: one row of its smallest key.

    Rows are told apart by a number of their own, so a key may repeat, with equal or
    different texts, and equal rows leave one. Documents without shingles, and rows without a
    key, all stay.
    """
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    keys = numbered.select("__row", F.col(f"`{key}`").cast("long").alias("__key"))
    found = near_duplicates(numbered, "__row", text).select(F.col("doc_id").alias("__row"), "component_id")
    keyed = found.join(keys.filter("__key is not null"), "__row")
    first = keyed.groupBy("component_id").agg(F.min(F.struct("__key", "__row")).alias("first")).select("first.__row")
    stay = first.unionByName(keys.filter("__key is null").select("__row"))
    return numbered.join(stay, "__row", "left_semi").drop("__row")
