"""Token counts with a whole-token shortcut for a BPE with word ends."""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_units import blocks

#: Words whose counts a worker keeps before it starts anew; bounds memory, never results.
UNIT_LIMIT = 400_000


class WholeTokenCounter:
    """Counts tokens of words (runs without white space), whose tokens never cross white space.

    At the start it proves which vocabulary strings, given alone, encode as exactly one
    token. A word is normalised and cut to pre-tokens as the tokenizer file says;
    pre-tokens among the proven ones count as one, the library merges only the rest.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        # each step of the file's normaliser other than this and white space would need its own rule here
        assert [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.whole = self.prove(spec["model"]["vocab"], spec["model"]["end_of_word_suffix"])
        self.index: dict[str, int] = {}

    def prove(self, vocab: dict[str, int], suffix: str) -> frozenset[str]:
        """Pre-tokens, as text, that the library encodes as one token."""
        alphabet = _byte_alphabet()
        texts = []
        for token in vocab:
            if token.endswith(suffix) and all(c in alphabet for c in token[: -len(suffix)]):
                raw = bytes(alphabet[c] for c in token[: -len(suffix)])
                try:
                    texts.append(raw.decode())
                except UnicodeDecodeError:
                    continue
        texts = [t for t in texts if self.pattern.fullmatch(t)]
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert all("<|" in s for s in self.special)
        return frozenset(t for t, e in zip(texts, found) if len(e.ids) == 1)

    def _lower(self, word: str) -> str:
        if word.isascii():
            return word.lower()
        return "".join(c.lower() for c in unicodedata.normalize("NFC", word))

    def split(self, word: str) -> list[str] | None:
        """Pre-tokens, or none if a special string is inside."""
        if "<|" in word and any(s in word for s in self.special):
            return None
        word = self._lower(word)
        if word.isalpha():
            return [word]
        if word and word[-1] in ".,;:!?" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pattern.findall(word)

    def learn(self, words: list[str]) -> np.ndarray:
        """Tokens of each of these distinct words."""
        if len(self.index) > UNIT_LIMIT:
            self.index.clear()
        new = [w for w in words if w not in self.index]
        cut = [self.split(w) for w in new]
        rest = list({p for ps in cut if ps for p in ps if p not in self.whole} | {w for w, ps in zip(new, cut) if ps is None})
        merged = dict(zip(rest, (len(e.ids) for e in self.tokenizer.encode_batch(rest, add_special_tokens=False))))
        for w, ps in zip(new, cut):
            self.index[w] = merged[w] if ps is None else sum(1 if p in self.whole else merged[p] for p in ps)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; Arrow cuts at ASCII white space and finds the distinct words."""
        out = [np.zeros(0, np.int64)]
        for a, b in blocks(texts):
            cut = pc.ascii_split_whitespace(texts.slice(a, b - a))
            ends = cut.offsets.to_numpy()
            words = cut.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
            total = np.concatenate([[0], np.cumsum(self.learn(words.dictionary.to_pylist())[words.indices.to_numpy()])])
            out.append(np.diff(total[ends - ends[0]]))
        return np.concatenate(out)


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: the rule of the public format."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(2)
def _counter(path: str) -> WholeTokenCounter:
    return WholeTokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """Per row: n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    The tokenizer file is read by each worker from `path`. Other columns pass through;
    columns named like a result are replaced. Null and empty texts have 0 bytes and
    tokens. Special strings inside texts count as the library counts them by default.
    Repeated rows give repeated results; an empty table gives none.
    """
    names = ["n_bytes", "n_tokens", "over_limit"]
    through = [c for c in docs.columns if c not in (*names, text)]
    src = docs.select(*[F.col(f"`{c}`") for c in through], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    src = src.withColumn("n_bytes", F.octet_length("__text").cast("long"))
    schema = src.drop("__text").schema.add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            n = counter.count(batch.column("__text"))
            cols = [batch.column(c) for c in [*through, "n_bytes"]] + [pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(cols, names=through + names)

    return src.mapInArrow(run, schema)
