"""Benchmark decontamination by hashed word windows; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .url_filter import lower_ascii

#: Most distinct window hashes that are sent along with the tasks; with more, windows are joined by key.
SENT_WINDOWS = 50_000


def words_of(text: Column) -> Column:
    """A-Z lower-cased runs of digits, letters a-z and characters beyond ASCII."""
    cut = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(cut, lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, n: int = 13, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item_id, words, size, hash) windows of n words; an item of fewer words is one window, one without an id has its windows all the same."""
    items = benchmark.select(F.col(f"`{item}`").alias("item_id"), words_of(F.col(f"`{text}`")).alias("w")).filter("size(w) > 0")
    size = F.least(F.size("w"), F.lit(n))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))
    out = items.select("item_id", "w", size.alias("size"), at.alias("at")).select("item_id", F.slice("w", F.col("at"), F.col("size")).alias("words"), "size")
    return out.select("item_id", F.array_join("words", " ").alias("words"), "size", F.xxhash64("words").alias("hash")).distinct()


def find_windows(docs: DataFrame, windows: DataFrame, text: str = "text", sent: int = SENT_WINDOWS) -> DataFrame:
    """docs with n_words and `hits`, the array of (at, size, words) whose hash is a benchmark window's.

    Up to `sent` distinct hashes go along as one hash set, and each text is scanned in
    place. With more, (hash, row) pairs of all windows are joined with the hashes by key,
    and only rows with hits return to their documents.
    """
    windows = windows.select("size", "hash").distinct()
    few = windows.limit(sent + 1).collect()
    if len(few) > sent:
        return _find_by_join(docs, windows, text)
    by_size: dict[int, list[int]] = {}
    for r in few:
        by_size.setdefault(r["size"], []).append(r["hash"])
    spark_docs = docs.withColumn("__w", words_of(F.col(f"`{text}`")))
    found = [
        F.expr(
            f"transform(filter(sequence(1, greatest(size(__w) - {size - 1}, 1)), i -> i + {size - 1} <= size(__w) and xxhash64(slice(__w, i, {size})) in ({', '.join(f'{h}L' if h > -(2**63) else '(-9223372036854775807L - 1L)' for h in sorted(hashes))})),"
            f" i -> struct(i as at, {size} as size, array_join(slice(__w, i, {size}), ' ') as words))"
        )
        for size, hashes in sorted(by_size.items())
    ]
    hits = F.concat(*found) if found else F.expr("cast(array() as array<struct<at:int,size:int,words:string>>)")
    return spark_docs.withColumn("n_words", F.size("__w").cast("long")).withColumn("hits", hits).drop("__w")


def _find_by_join(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most n values
    keyed = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    w = keyed.select("__row", words_of(F.col(f"`{text}`")).alias("w"))
    at = F.expr("flatten(array(" + ", ".join(f"transform(filter(sequence(1, greatest(size(w) - {s - 1}, 1)), i -> i + {s - 1} <= size(w)), i -> struct(i as at, {s} as size, xxhash64(slice(w, i, {s})) as hash))" for s in sizes) + "))")
    found = w.select("__row", F.inline(at)).join(windows, ["size", "hash"]).select("__row", "at", "size")
    spots = found.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("spots"))
    joined = keyed.join(spots, "__row", "left").withColumn("__w", words_of(F.col(f"`{text}`")))
    hits = F.expr("transform(coalesce(spots, array()), s -> struct(s.at as at, s.size as size, array_join(slice(__w, s.at, s.size), ' ') as words))")
    return joined.withColumn("n_words", F.size("__w").cast("long")).withColumn("hits", hits).drop("__w", "__row", "spots")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, text: str = "text", sent: int = SENT_WINDOWS) -> DataFrame:
    """Per row: n_words, n_hit, item_ids (sorted as strings), spans (first and last word, from 1, of merged hits), contaminated.

    A document word inside any occurrence of a benchmark window is hit. A document is
    contaminated if n_hit > 0 and share * n_hit >= n_words. Candidate windows are those
    with a benchmark window's hash; a join on the words themselves verifies them. Windows of
    items without an id count for n_hit, spans and contaminated; item_ids leaves the null out. Other
    columns pass through, but for text; columns named like a result are replaced. Null and empty texts have no
    words. Repeated rows give repeated results; empty tables are fine.
    """
    names = ("n_words", "n_hit", "item_ids", "spans", "contaminated")
    windows = written(benchmark_windows(benchmark, n), "windows")
    through = [c for c in docs.columns if c not in (*names, text)]
    found = find_windows(docs.select(*[F.col(f"`{c}`") for c in through], F.col(f"`{text}`").alias("__text")), windows, "__text", sent)
    found = written(found.drop("__text").withColumn("__row", F.monotonically_increasing_id()), "found")
    words = windows.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    hits = found.filter("size(hits) > 0").select("__row", F.inline("hits")).join(words, "words")
    spread = F.explode(F.sequence("at", F.col("at") + F.col("size") - 1))
    covered = hits.select("__row", spread.alias("i")).groupBy("__row").agg(F.sort_array(F.collect_set("i")).alias("i"))
    items = hits.select("__row", F.explode("items").alias("item")).groupBy("__row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    out = found.drop("hits").join(covered, "__row", "left").join(items, "__row", "left")
    n_hit = F.coalesce(F.size("i"), F.lit(0)).cast("long")
    # i is sorted: a span begins or ends where a neighbour is more than one word away
    firsts = F.filter("i", lambda x, k: (k == 0) | (F.get("i", k - 1) < x - 1))
    lasts = F.filter("i", lambda x, k: (k == F.size("i") - 1) | (F.get("i", k + 1) > x + 1))
    none = F.expr("cast(array() as array<string>)")
    return out.withColumn("n_hit", F.when(F.col("i").isNull(), F.lit(0).cast("long")).otherwise(n_hit)).select(
        *[F.col(f"`{c}`") for c in through], "n_words", "n_hit", F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce(F.arrays_zip(firsts.alias("first"), lasts.alias("last")), F.expr("cast(array() as array<struct<first:int,last:int>>)")).alias("spans"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is not contaminated."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{text}`").alias("__scan"))
    return contamination(whole, benchmark, text="__scan").filter("not contaminated").select("__doc.*")
