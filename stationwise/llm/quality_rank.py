"""Quality scores by Bradley-Terry ranking of document pairs."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Labelled rows that a model is fitted on at most; those of the smallest hashes are taken.
TRAIN_ROWS = 20_000
#: Each preferred document is compared with so many others.
PAIRS_EACH = 4
RIDGE = 1e-3
#: Character classes whose shares of a text are features (fixed values).
CLASSES = ("A-Z", "a-z", "0-9", " ", "\n", ".", ",", "!?", "|", "#$%&*", "@/:;=_+~^", "()[]{}<>", "\"'`-")
FEATURES = len(CLASSES) + 10
#: Bytes of texts whose features are made together.
BLOCK_BYTES = 1_000_000


def _class_of_byte() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.int64)  # everything else, also bytes beyond ASCII
    for k, chars in enumerate(CLASSES):
        for a in re.findall(r"\w-\w|.", chars, re.S):
            for b in range(ord(a[0]), ord(a[-1]) + 1):
                out[b] = k
    return out


CLASS_OF_BYTE = _class_of_byte()


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers per text, from the whole text; an empty text has zeros but for the last.

    Shares of character classes, length, word and line lengths, words that repeat, words
    all in capitals, words that end in a symbol, lines that repeat.
    """
    size = np.array(pc.binary_length(texts).to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(texts), FEATURES))
    n_class = len(CLASSES) + 1
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK_BYTES, "right")))
        part = texts.slice(start, stop - start)
        n = size[start:stop]
        raw = np.frombuffer(b"".join(x.as_buffer() for x in part), np.uint8) if n.sum() else np.zeros(0, np.uint8)
        row = np.repeat(np.arange(stop - start), n)
        counts = np.bincount(row * n_class + CLASS_OF_BYTE[raw], minlength=(stop - start) * n_class).reshape(-1, n_class)
        per = 1.0 / np.maximum(n, 1)
        block = out[start:stop]
        block[:, :n_class] = counts * per[:, None]
        words, row_w, n_w = _cut(pc.ascii_split_whitespace(part))
        lines, row_l, n_l = _cut(pc.split_pattern(part, "\n"))
        per_w, per_l = 1.0 / np.maximum(n_w, 1), 1.0 / np.maximum(n_l, 1)
        plain = words.dictionary
        caps = np.array(pc.match_substring_regex(plain, r"^[^a-z]*[A-Z]{2,}[^a-z]*$").to_numpy(zero_copy_only=False), float)
        marked = np.array(pc.match_substring_regex(plain, r"[^0-9A-Za-z.,;:'\")\x{80}-\x{10FFFF}]$").to_numpy(zero_copy_only=False), float)
        bare = np.array(pc.match_substring_regex(plain, r"^[^0-9A-Za-z\x{80}-\x{10FFFF}]+$").to_numpy(zero_copy_only=False), float)
        code = words.indices.to_numpy()
        k = n_class
        block[:, k] = np.log1p(n)
        block[:, k + 1] = n * per_w / 10
        block[:, k + 2] = np.log1p(n * per_l)
        for j, flag in enumerate((caps, marked, bare)):
            block[:, k + 3 + j] = np.bincount(row_w, flag[code], stop - start) * per_w
        block[:, k + 6] = _distinct(row_w, code, stop - start) * per_w
        block[:, k + 7] = 1 - _distinct(row_l, lines.indices.to_numpy(), stop - start) * per_l
        block[:, k + 8] = n == 0
        block[n == 0, : k + 8] = 0
        start = stop
    return out


def _cut(lists: pa.ListArray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Values, the list of each, and how many each list has."""
    ends = lists.offsets.to_numpy()
    n = np.diff(ends)
    return lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode(), np.repeat(np.arange(len(n)), n), n


def _distinct(row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
    both = np.unique(row * (int(code.max(initial=0)) + 1) + code)
    return np.bincount(both // (int(code.max(initial=0)) + 1), minlength=rows)


@dataclass
class RankModel:
    """Score of features x: logistic(slope * (weights . (x - mean) / scale - cut) + offset)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; at least `threshold` exactly for raw scores of at least `cut`."""
        z = self.slope * (self.raw(x) - self.cut) + np.log(self.threshold / (1 - self.threshold))
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return np.where(self.raw(x) >= self.cut, np.maximum(p, self.threshold), np.minimum(p, np.nextafter(self.threshold, 0)))


def fit_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> RankModel:
    """Bradley-Terry: P(a preferred to b) = logistic(w . (x_a - x_b)), by Newton's method on pairs of a 1 and a 0.

    Each row is paired with PAIRS_EACH rows of the other label, at even strides, so ties
    and order don't matter. The cut is a quantile of the raw scores: the one that agrees
    with most labels, each label weighing the same. With one label only, or no rows, every score is the threshold's side of
    that label (1 without rows).
    """
    width = x.shape[1]
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(width), np.ones(width))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return RankModel(mean, scale, np.zeros(width), 1.0 if len(bad) else -1.0, 1.0, threshold)
    z = np.clip((x - mean) / scale, -8, 8)
    n = PAIRS_EACH * max(len(good), len(bad))
    k = np.arange(n)
    d = z[good[k % len(good)]] - z[bad[(k * 7919 + k // len(good)) % len(bad)]]
    w = np.zeros(width)
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # chance that the pair is ranked wrongly
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(width), d.T @ p / n - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    raw = ((x - mean) / scale) @ w
    order = np.argsort(raw, kind="stable")
    s, one = raw[order], y[order] == 1
    # label 0 below the cut, label 1 from it on
    right = np.concatenate([[0], np.cumsum(~one)]) / len(bad) + (len(good) - np.concatenate([[0], np.cumsum(one)])) / len(good)
    edge = np.concatenate([[True], s[1:] > s[:-1], [False]])
    at = int(np.argmax(np.where(edge, right, -1)))
    cut = s[at] if at == 0 else (s[at - 1] + s[at]) / 2
    spread = max(np.quantile(raw, 0.9) - np.quantile(raw, 0.1), 1e-6)
    return RankModel(mean, scale, w, float(cut), float(8 / spread), threshold)


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with `features`; null texts are empty."""
    src = docs.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit(""))).drop(text, "features")
    names = [c for c in src.columns if c != "__text"]

    def run(batches):
        for batch in batches:
            x = features(batch.column("__text"))
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [lists], names=names + ["features"])

    return src.mapInArrow(run, src.drop("__text").schema.add("features", ArrayType(DoubleType())))


def fit(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> RankModel:
    """Fit on at most `rows` labelled documents, those with the smallest hash of their key.

    Null keys and labels other than 0 and 1 are left out; of a key's labels the largest counts.
    Keys with several texts count with each.
    """
    own = labels.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").cast("int").alias("__label")).filter("__key is not null and __label in (0, 1)")
    own = own.groupBy("__key").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__key"), "__key").limit(rows)
    picked = docs.select(F.col(f"`{key}`").alias("__key"), "text").join(F.broadcast(own), "__key")  # at most `rows` rows of two numbers
    got = with_features(picked).orderBy(F.xxhash64("__key"), "__key", "features").limit(rows).collect()
    x = np.array([r["features"] for r in got]).reshape(-1, FEATURES)
    return fit_pairs(x, np.array([r["__label"] for r in got]), threshold)


def score_documents(docs: DataFrame, model: RankModel, text: str = "text") -> DataFrame:
    """docs without text, with score and predicted (1 if score >= the model's threshold).

    Only the text is an input. Null texts are empty; repeated rows score alike; an empty
    table gives none. Columns named like a result are replaced.
    """
    names = [c for c in docs.columns if c not in (text, "score", "predicted")]
    src = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))

    def run(batches):
        for batch in batches:
            score = model.score(features(batch.column("__text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(score), pa.array((score >= model.threshold).astype(np.int32))], names=names + ["score", "predicted"]
            )

    return src.mapInArrow(run, src.drop("__text").schema.add("score", "double").add("predicted", "integer"))


def keep_good(docs: DataFrame, model: RankModel, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the model accepts."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{text}`").alias("__scan"))
    return score_documents(whole, model, "__scan").filter("predicted = 1").select("__doc.*")
