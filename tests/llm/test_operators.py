"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from stationwise.llm import (
    chat_trees,
    decontaminate,
    jaccard_join,
    learned_partitions,
    pii_bootstrap,
    quality_rank,
    segment_bpe,
    text_units,
    token_counts,
    token_files,
    url_filter,
)
from tests.oracle import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
ODD = ["", None, " ", "\n\n", "a", "a  b", " lead", "trail ", "x\x02y, z", "<|endoftext|> it's 日本 😀,", "Ünï é\u0301 \x1c ok", "one two three four five six", "one two three four five six", LONG, "z" * 3000]


def rows(texts):
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(ODD) + [(0, "", "en", "s", 0)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")


def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}


def test_segment_tree_equals_the_library(spark, docs, empty):
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    clash = docs.selectExpr("*", "1 as n_tokens", "'x' as ids")
    out = segment_bpe.encode_documents(clash, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True)
    got = out.collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        text = ODD[r.doc_id] or ""
        want = np.array(e.encode_ordinary(text), "<u4").tobytes()
        assert bytes(r.ids) == want and r.n_tokens == len(want) // 4
        assert r.ids_sha256 == hashlib.sha256(want).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert segment_bpe.encode_documents(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_counts_equal_the_library(docs, empty):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in token_counts.count_tokens(docs, P.path("word_bpe_49k.json"), 3).collect():
        n = len(t.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((ODD[r.doc_id] or "").encode()), n > 3)
    assert token_counts.count_tokens(empty, P.path("word_bpe_49k.json"), 3).count() == 0


def test_token_files_round_trip(spark, docs, empty, given):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    both = docs.unionByName(given.withColumn("doc_id", given.doc_id + 100)).unionByName(spark.createDataFrame([(None, "no key", "", "", 0)], DOCS))
    files = token_files.write_token_files(both, P.path("byte_bpe_50k.json"), 2, shard_bytes=100_000)
    assert files.manifest().count() > 2
    got = sorted(files.read_back(both.unionByName(spark.createDataFrame([(99999, "", "", "", 0)], DOCS))).collect(), key=lambda r: (r.start, r.n_tokens))
    texts = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in both.collect()), key=lambda r: r[0])
    at = 0
    assert len(got) == len(texts)
    for (key, text), r in zip(texts, got):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens) == (key, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.write_token_files(empty, P.path("byte_bpe_50k.json"), 2).read_back(docs).count() == 0


def test_perfect_hash_is_minimal():
    keys = token_files.key_hash(np.arange(5000), np.zeros(5000, np.int64))
    h = token_files.PerfectHash.build(keys)
    assert sorted(h.lookup(keys).tolist()) == list(range(5000))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {d: shingles(t) for d, t in texts}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_join_equals_brute_force(spark, empty):
    rng = np.random.default_rng(3)
    texts = list(ODD)
    base = [f"w{i}" for i in rng.integers(0, 4000, 160)]
    for _ in range(40):  # near copies, some just beyond the threshold
        own = list(base)
        for k in rng.integers(0, len(own), int(rng.integers(1, 8))):
            own[k] = f"n{rng.integers(1 << 30)}"
        texts.append(" ".join(own))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} " + " ".join(f"u{rng.integers(1 << 30)}" for _ in range(int(rng.integers(2, 60)))) for _ in range(60)]
    frame = spark.createDataFrame(rows(texts) + [(None, "a", "", "", 0)], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame).collect()}
    assert got.pop(None) == (1, ODD.index("a"))
    want = brute_components(list(enumerate(texts)))
    assert got == want
    kept = {r.doc_id for r in jaccard_join.keep_one(frame).collect()}
    assert kept == {d for d, (_, c) in want.items() if c == d} | {None}
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_chunks_lose_no_link(spark, monkeypatch):
    texts = [" ".join(f"w{j + i // 2}" for j in range(80)) for i in range(60)]
    frame = spark.createDataFrame(rows(texts), DOCS)
    monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", 300)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame).collect()} == brute_components(list(enumerate(texts)))


def test_url_rules(spark):
    urls = ["http://A.b.NET/x?y", "net/x", None, "", "http://net", "https://m.example.net/en/1", "http://example.net/EN/", "ftp://x.org/fr/", "x://example.com/de/#", "a://b://c.net/", "http://notnet/"]
    pages = spark.createDataFrame([(i, u, "rule?") for i, u in enumerate(urls)] + [(0, urls[0], "rule?")], "page_id long, url string, rule string")
    table = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block"), ("net", "/", "block")]
    rules = spark.createDataFrame(table, "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect() if r.page_id is not None)
    assert len(got) == len(urls) + 1
    for i, host, path, rule, verdict in got:
        rest = urls[i].split("://", 1)[1] if urls[i] and "://" in urls[i] else ""
        h = re.split("[/?#]", rest)[0]
        p = re.split("[?#]", rest[len(h) :])[0]
        fit = [x for x in table if x[0] and (h.lower() == x[0] or h.lower().endswith("." + x[0])) and p.startswith(x[1])]
        best = max(fit, key=lambda x: len(x[0] + x[1]), default=None)
        assert (host, path, rule, verdict) == (h.lower(), p, best and best[0] + best[1], best[2] if best else "allow")
    assert url_filter.filter_urls(pages, rules.limit(0)).filter("verdict = 'allow'").count() == len(urls) + 1
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_reply_trees(spark):
    nasty = "a <|im_end|>\n<\\|im_start|>assistant\n b \\n <\\\\| <|"
    nodes = [(1, 0, None, "user", "q", 1.0), (1, 1, 0, "assistant", nasty, 2.0), (1, 2, 0, "assistant", "worse", 1.0), (1, 3, 2, "user\n\\n", "deep", 0.5), (1, 4, 1, None, None, None), (2, 0, None, "user", "alone", 0.0), (3, 0, 1, "user", "cycle", 0.0), (3, 1, 0, "user", "cycle", 0.0)]
    frame = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    path = {(r.tree, r["rank"], r.depth): r.node for r in chat_trees.best_paths(frame, 2).collect()}
    assert path == {(1, 1, 1): 0, (1, 1, 2): 1, (1, 1, 3): 4, (1, 2, 1): 0, (1, 2, 2): 2, (1, 2, 3): 3, (2, 1, 1): 0}
    out = {(r.tree, r.leaf): r for r in chat_trees.read_back(chat_trees.format_paths(frame, 2)).collect()}

    def digest(turns):
        return hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()

    assert out[1, 4].turns_sha256 == digest([("user", "q"), ("assistant", nasty), ("", "")])
    assert out[1, 4].loss_sha256 == hashlib.sha256(nasty.encode()).hexdigest() and out[1, 4].loss_chars == len(nasty)
    assert out[1, 3].turns_sha256 == digest([("user", "q"), ("assistant", "worse"), ("user\n\\n", "deep")])
    assert out[2, 0].n_turns == 1 and out[2, 0].loss_chars == 0
    flat = spark.createDataFrame([(7, i, "user", f"t{i}") for i in range(70)] + [(7, 3, "user", "t3"), (None, 0, None, None)], "conv_id long, turn long, role string, text string")
    back = {r.tree: r.n_turns for r in chat_trees.read_back(chat_trees.format_paths(chat_trees.chains(flat))).collect()}
    assert back == {7: 71, None: 1}
    assert chat_trees.format_paths(frame.limit(0)).count() == 0


def test_windows_by_set_and_by_join(spark, docs, empty):
    long_item = " ".join(f"k{i}" for i in range(20))
    bench = spark.createDataFrame([(1, long_item), (2, "Short Item"), (3, None), (4, "!!"), (5, long_item.upper())], "item_id long, text string")
    texts = [*ODD, f"x {long_item} y", " ".join(f"k{i}" for i in range(12)), "a short, item b " * 3, f"{long_item} " * 2 + "c " * 900]
    frame = spark.createDataFrame([(*r, "no") for r in rows(texts)], DOCS + ", contaminated string")
    items = {1: long_item.split(), 2: ["short", "item"], 5: long_item.split()}
    for sent in (1000, 2):
        got = {r.doc_id: r for r in decontaminate.contamination(frame, bench, sent=sent).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            hit, found = set(), set()
            for key, item in items.items():
                n = min(13, len(item))
                grams = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in grams:
                        hit |= set(range(k, k + n))
                        found.add(str(key))
            r = got[i]
            assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
            assert sum(s["last"] - s["first"] + 1 for s in r.spans) == len(hit)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def nearest_by_brute_force(ids, v, k, every):
    """Exact neighbours of the same queries, to measure recall against."""
    for i in np.flatnonzero(ids % every == 0):
        s = (v * v[i]).sum(axis=1)
        order = [j for j in np.lexsort([ids, -s])[: k + 1] if ids[j] != ids[i]][:k]
        yield int(ids[i]), [int(ids[j]) for j in order]


def test_given_vectors_are_not_searched_in_whole(spark):
    """Recall of at least 0.9 at sf 0.1 with a stated part of queries x rows."""
    frame = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows_ = frame.orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows_]), np.array([r.embedding for r in rows_], float)
    true = dict(nearest_by_brute_force(ids, v, 20, 20))
    got = {}
    for r in learned_partitions.search(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & set(t)) for q, t in true.items()) >= 0.9 * 20 * len(true)
    parts = round(len(v) ** 0.5 / 3)
    router = learned_partitions.learn(v, parts, 20)
    home = np.bincount(router.best(v, 1)[:, 0], minlength=parts)
    order, n = router.searched(v[ids % 20 == 0])
    compared = sum(home[o[:m]].sum() for o, m in zip(order, n))
    assert router.probes < parts and compared <= 0.85 * len(true) * len(v)


def test_router_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    v = (centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    v[700:1000] = v[700]  # a vector that many rows share
    data = [(i, x.tolist(), "clash") for i, x in enumerate(v)] + [(2000, None, ""), (2020, [0.0] * 16, ""), (2040, [float("nan")] * 16, ""), (2060, [1.0, None] * 8, ""), (2080, [1.0], ""), (None, v[0].tolist(), "")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in learned_partitions.search(frame, partitions=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    true = dict(nearest_by_brute_force(np.arange(1500), v.astype(float), 20, 20))
    assert set(got) == set(true)
    found = sum(len({i for _, i, _ in got[q]} & set(true[q])) for q in true)
    assert found >= 0.9 * 20 * len(true)
    for q, hits in got.items():
        hits.sort()
        assert [r for r, _, _ in hits] == list(range(1, 21))
        assert sorted(hits, key=lambda h: (-h[2], h[1])) == hits
    assert learned_partitions.search(frame.limit(0)).count() == 0
    assert learned_partitions.search(frame.filter("vec_id < 3")).count() == 2


def test_personal_data(spark, empty, given):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    def good(k, m):
        d = re.sub("[^0-9]", "", m)
        return k == "email" or (k == "ip" and all(int(x) < 256 for x in m.split("."))) or (k == "card" and 12 <= len(d) <= 19 and luhn(d)) or (k == "phone" and 9 <= len(d) <= 15)

    texts = [*ODD, "a@b.co_x@y.com z@q", "é1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111-1111 1111 +1 (017) 555-7713 +1+12345678(9)", "1 4111111111111111", "1" * 40, "+" + "1 " * 5000, "@" * 5000, "a.b@" * 2000]
    texts += [f"write to agent: m{i}@x.org now" for i in range(8)] + ["write to agent: bond-007 now", "page zz99x8 here"] + [r.text for r in given.limit(150).collect()]
    got = {r.doc_id: r for r in pii_bootstrap.personal_data(spark.createDataFrame([(*r, "no") for r in rows(texts)], DOCS + ", spans string")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = sorted((m.start(), j, m.end(), k) for j, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if good(k, m[0]))
        assert [tuple(s) for s in got[i].base] == want, t
        assert set(map(tuple, got[i].base)) <= set(map(tuple, got[i].spans))
    bond = texts.index("write to agent: bond-007 now")
    assert [tuple(s) for s in got[bond].spans] == [(16, 0, 24, "email")]
    assert not got[bond + 1].spans
    masked = {r.doc_id: r.text for r in pii_bootstrap.mask(spark.createDataFrame(rows(texts), DOCS)).collect()}
    assert masked[bond] == "write to agent: <EMAIL> now" and masked[ODD.index(None)] is None
    assert masked[len(ODD)] == "<EMAIL><EMAIL> z@q"
    assert pii_bootstrap.personal_data(empty).count() == 0


def test_quality_ranking(spark, docs, empty):
    given = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    model = quality_rank.fit(given, labels.filter("doc_id % 3 != 0").unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")))
    scored = quality_rank.score_documents(given.withColumn("score", given.lang), model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.97 * len(scored)
    assert all((r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in scored)
    odd = quality_rank.score_documents(docs, model).collect()
    assert len(odd) == len(ODD) + 1 and len({r.score for r in odd if r.doc_id in (0, 1)}) == 1
    assert quality_rank.score_documents(empty, model).count() == 0
    one_class = quality_rank.fit(given, labels.filter("quality = 1"))
    assert quality_rank.keep_good(given, one_class).count() == given.count()
    assert quality_rank.features(pa.array(["", "a b a"])).shape == (2, quality_rank.FEATURES)


def test_repeated_queries_and_small_partitions_have_k_neighbours(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=(400, 8)), 50 + 0.01 * rng.normal(size=(6, 8))])
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    data += [data[20], data[20], (40, data[41][1]), (400, data[400][1])]
    got = {}
    for r in learned_partitions.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), partitions=24).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == set(range(0, 401, 20))
    for q, hits in got.items():  # 40 has two vectors
        assert sorted(r for r, _ in hits) == sorted([*range(1, 21)] * (2 if q == 40 else 1))
    assert len({i for _, i in got[20]}) >= 19  # 40 may be there with both its vectors


def test_small_partitions_are_widened(spark, monkeypatch):
    """A router that sends each query to one partition of few vectors."""
    x = np.eye(8)[np.arange(200) % 8] + 0.01 * np.arange(200)[:, None]
    real = learned_partitions.learn

    def one_probe(*a):
        router = real(*a)
        router.probes = 1
        return router

    monkeypatch.setattr(learned_partitions, "learn", one_probe)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows_ = learned_partitions.search(frame, k=60, partitions=8).collect()
    assert all(sum(r.query_id == q for r in rows_) == 60 for q in range(0, 200, 20))


def test_windows_of_items_without_an_id_count(spark):
    bench = spark.createDataFrame([(None, "alpha beta gamma delta"), (7, "red green blue")], "item_id long, text string")
    frame = spark.createDataFrame(rows(["x alpha beta gamma delta", "red green blue", "none"]), DOCS)
    for sent in (1000, 1):
        got = {r.doc_id: (r.n_hit, r.item_ids, r.contaminated) for r in decontaminate.contamination(frame, bench, sent=sent).collect()}
        assert got == {0: (4, [], True), 1: (3, ["7"], True), 2: (0, [], False)}


def test_keyless_near_copy_bridges_two_documents(spark):
    w = [f"w{i}" for i in range(60)]
    first, bridge, last = " ".join(w), " ".join(w[6:] + [f"v{i}" for i in range(6)]), " ".join(w[12:] + [f"v{i}" for i in range(12)])
    ends = brute_components(list(enumerate([first, last])))
    assert ends[1][1] == 1 and brute_components(list(enumerate([first, bridge, last])))[2][1] == 0
    frame = spark.createDataFrame([(1, first, "", "", 0), (None, bridge, "", "", 0), (3, last, "", "", 0)], DOCS)
    assert {r.component_id for r in jaccard_join.near_duplicates(frame).collect()} == {1}


def test_keep_one_decides_by_row(spark):
    first = " ".join(f"w{i}" for i in range(60))
    other, alone = " ".join(f"o{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    texts = [(5, other), (6, other + " x"), (6, alone), (8, first), (8, first + " y"), (None, other + " z")]
    frame = spark.createDataFrame([(d, t, "", "", 0) for d, t in texts], DOCS)
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(frame).collect()]
    assert (5, other) in kept and (6, alone) in kept and (None, other + " z") in kept
    assert len(kept) == 4 and sum(d == 8 for d, _ in kept) == 1


def test_words_built_to_collide_do_not(spark):
    """The Thue-Morse word and its swap are equal under every polynomial modulo 2^64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    swap = word.translate(str.maketrans("ab", "ba"))
    tail = " one two three four five"
    texts = [word, swap, word + tail, swap + tail, word.upper() + tail, word[:1024], swap[:1024]]
    frame = spark.createDataFrame(rows(texts), DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame).collect()}
    assert got == brute_components(list(enumerate(texts)))
    assert got[4] == (2, 2) and got[0] == (1, 0) and got[6] == (1, 6)


def test_keep_one_takes_map_columns_and_keeps_keyless_rows(spark):
    frame = spark.sql("SELECT * FROM VALUES (1L, '', map('a', 1)), (null, 'x y', map('a', 1)), (null, 'x y', map('a', 1)), (2L, 'x y', map()), (3L, 'x y', map()) AS t(doc_id, text, m)")
    assert sorted(str(r.doc_id) for r in jaccard_join.keep_one(frame).collect()) == ["1", "2", "None", "None"]


def test_contexts_find_identifiers_that_have_no_form(spark):
    """Secrets in prose: those of a plain form seed the mark, and strings of other forms in its place are found; loose ones are not."""
    rng = np.random.default_rng(6)
    words = ["thand", "erion", "le", "der", "ountre", "und", "he", "ansti"]
    prose = lambda n: " ".join(words[int(i)] for i in rng.integers(0, len(words), n))
    hexes = ["".join("0123456789abcdef"[int(i)] for i in rng.integers(0, 16, 40)) for _ in range(30)]
    texts = [f'{prose(9)} token = "{h}" {prose(5)}' for h in hexes[:20]]
    texts += [f'{prose(7)} TOKEN = "{h.upper()}"!! {prose(4)}' for h in hexes[20:24]]
    texts += [f'{prose(3)} token = "zz9-short1" {prose(4)}', f'{prose(3)} token: "zz9-short2" {prose(4)}', f"{prose(5)} {hexes[29]} {prose(3)}", f"{prose(5)} b2b-42x {prose(3)}"]
    texts += [f"{prose(6)} a{i}.b@mail.example.com {prose(3)} 10.0.0.{i} {prose(4)}" for i in range(12)]
    frame = spark.createDataFrame(rows(texts), DOCS)
    got = {r.doc_id: r for r in pii_bootstrap.personal_data(frame).collect()}
    extra = {d: [texts[d][s.start : s.end] for s in r.spans if s not in r.base] for d, r in got.items()}
    assert [extra[i] for i in range(24)] == [[h] for h in hexes[:20]] + [[h.upper()] for h in hexes[20:24]]
    assert extra[24] == ["zz9-short1"] and not any(extra[i] for i in range(25, len(texts)))
    assert all(s.kind == "secret" for i in range(25) for s in got[i].spans)
    masked = {r.doc_id: r.text for r in pii_bootstrap.mask(frame).collect()}
    assert masked[24].count('token = "<SECRET>"') == 1 and masked[26] == texts[26]


def test_known_units_are_looked_up_once():
    """A distinct unit of a block costs one lookup, known or new; edges stay -1."""

    class Counted(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

        def __contains__(self, k):
            self.n += 1
            return super().__contains__(k)

    encoder = text_units.UnitEncoder(lambda texts: (np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([*map(len, texts)])))
    encoder.runs.index = Counted()
    words = [f"w{i}" for i in range(500)] + ["", "a\t"]
    for units in (words, [*words, "new", "\nline", text_units.GLUE + "ab"], words[::-1]):
        encoder.runs.index.n = 0
        at, heads = encoder.learn(units, ["head"])
        assert encoder.runs.index.n <= len(units) + 1
        got = ["".join(map(chr, encoder.runs.take(at[i : i + 1]))) if at[i] >= 0 else None for i in range(len(at))]
        plain = {"\nline": "\nline", text_units.GLUE + "ab": "ab", "": None, "a\t": None}
        assert got == [plain.get(u, " " + u) for u in units]
        assert "".join(map(chr, encoder.runs.take(heads))) == "head"
