"""Divergence of sources within a language, priced from joint tables of count levels."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Probabilities are whole parts of so many.
PARTS = 1_000_000_000
#: Terms of a block of the indicator matrix, on average: of rare terms, which have few levels, and of others.
RARE_TERMS, OTHER_TERMS = 1024, 64
#: Terms with fewer occurrences than 2 to this power are rare.
RARE = 7
#: Sources whose columns meet in one product.
BLOCK_SOURCES = 64
#: Terms that a task counts before it sends what it has.
HELD_TERMS = 500_000
#: Parts that the terms of a group are dealt to, to find its first ranks.
SALTS = 64
#: ASCII bytes other than letters end a term; A-Z are lower-cased; all others stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame, columns: tuple[str, str, str] = ("text", "lang", "source")) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents): per group, nulls read as ''; a row with the term null counts the group's documents.

    Tasks add up their documents first and send one row per term of a language, with the
    counts of each source inside, so that what is shuffled is near the vocabulary.
    """
    text, lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns)
    src = docs.select(lang.alias("lang"), source.alias("source"), F.encode(text, "UTF-8").alias("text"))

    def count(batches):
        seen: dict[str, dict[str, list]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                held = seen.setdefault(lang, {}).setdefault(source, [Counter(), Counter(), 0])
                words = text.translate(LETTERS).split()
                size -= len(held[0])
                held[0].update(words)
                held[1].update(set(words))
                held[2] += 1
                size += len(held[0])
                if size > HELD_TERMS:
                    yield from map(by_term, seen.items())
                    seen, size = {}, 0
        yield from map(by_term, seen.items())

    def by_term(item):
        """One row per term of a language; the counts of its sources as a list."""
        lang, sources = item
        names = list(sources)
        terms = pa.array([t for s in names for t in sources[s][0]], pa.binary()).cast(pa.string()).dictionary_encode()
        owner = np.repeat(np.arange(len(names)), [len(sources[s][0]) for s in names])
        n = np.fromiter((x for s in names for x in sources[s][0].values()), np.int64, len(owner))
        holding = np.fromiter((sources[s][1][t] for s in names for t in sources[s][0]), np.int64, len(owner))
        at = terms.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(terms.dictionary)))])
        # the last row has no term and the documents of each source
        owner, n = np.concatenate([owner[order], np.arange(len(names))]), np.concatenate([n[order], np.zeros(len(names), np.int64)])
        holding = np.concatenate([holding[order], [sources[s][2] for s in names]])
        ends = np.append(ends, len(owner)).astype(np.int32)
        counts = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(owner)), pa.array(n), pa.array(holding)], names=["source", "n", "docs"])
        term = pa.concat_arrays([terms.dictionary, pa.nulls(1, pa.string())])
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(term)), term, pa.ListArray.from_arrays(pa.array(ends), counts)], names=["lang", "term", "counts"])

    parts = src.mapInArrow(count, "lang string, term string, counts array<struct<source:string,n:bigint,docs:bigint>>")
    rows = parts.repartition("lang", "term").select("lang", "term", F.explode("counts").alias("c")).select("lang", "term", "c.*")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (count + 1) / (total + terms)), exactly."""
    scaled = (count + 1).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return 1 + F.call_function("div", scaled, (total + terms).cast("decimal(20,0)"))


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def priced(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    if counts.max(initial=0) > 9 * 10**9:
        return np.array([1 + PARTS * (int(c) + 1) // (total + terms) for c in counts], np.int64)
    return 1 + PARTS * (counts + 1) // (total + terms)


def joint_prices(counts: np.ndarray, many: int, totals: np.ndarray, terms: int, first: np.ndarray, second: np.ndarray):
    """(g, h, value) of the ordered pairs between two blocks of groups, over the terms of one block.

    `counts` (terms x groups) has the terms that occur in a group; the other terms of the
    block, up to `many`, count 0 everywhere. Each (group, count) is an indicator column over
    terms. The product of a group's columns, transposed, with those of the second block is
    the joint table of levels of the group with all of these; a value is the sum of its
    entries times their price. Entries are at most `many`, so they are exact in doubles.
    """
    counts = np.vstack([counts, np.zeros((1, counts.shape[1]), np.int64)])
    weight = np.ones(len(counts))
    weight[-1] = many - len(counts) + 1
    levels, columns, price_of = [], [], []
    for g in range(counts.shape[1]):
        level, at = np.unique(counts[:, g], return_inverse=True)
        x = np.zeros((len(counts), len(level)))
        x[np.arange(len(counts)), at] = 1
        levels.append(level)
        columns.append(x)
        price_of.append(shares(level, int(totals[g]), terms))
    right = np.hstack([columns[h] for h in second])
    group = np.repeat(second, [len(levels[h]) for h in second])
    q = np.concatenate([price_of[h] for h in second])
    within = np.array_equal(first, second)
    out = []
    for g in first:
        joint = (columns[g] * weight[:, None]).T @ right
        r, c = np.nonzero(joint)
        n = joint[r, c].astype(np.int64)
        ways = [(price_of[g][r], q[c])] if within else [(price_of[g][r], q[c]), (q[c], price_of[g][r])]
        for back, (a, b) in enumerate(ways):
            value = np.zeros(counts.shape[1], np.int64)
            np.add.at(value, group[c], n * priced(a, b))
            out += [(h, g, value[h]) if back else (g, h, value[h]) for h in second if h != g]
    return out


def audit(docs: DataFrame, least: int = 3, ranks: int = 200, columns: tuple[str, str, str] = ("text", "lang", "source")) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: what sets the sources of a language apart.

    Terms are runs of letters (ASCII letters, lower-cased, and everything beyond ASCII); a
    language keeps those in at least `least` of its documents. With N the occurrences of
    kept terms in a group (lang, source) or a language, and V the number of kept terms,
    each has p = 1 + floor(10^9 (count + 1) / (N + V)) for each kept term, and a price is
    floor((p - q)^2 / q). Part `pair` sums the prices over all kept terms for each other
    source of the language (q is its p); part `term` has the terms that occur in the group
    with p > q, the language's, by price, up to `ranks`. Ranks go by value, then item.

    1. Tasks count terms and documents per group and term.
    2. Kept terms are dealt to blocks of similar frequency, so that a block has few count
       levels, and sources to blocks of BLOCK_SOURCES. Each block pair has joint tables by
       products of indicator columns, priced where they are made.
    3. First ranks are found in SALTS parts of each group, then among what is left.

    Null text, lang and source are read as ''. Groups without terms and languages without
    kept terms have pairs (of value 0 in the latter) and no terms. Repeated rows are documents
    of their own. Extra columns are ignored; an empty table gives no rows.
    """
    counts = written(term_counts(docs, columns), "term_counts")
    cells = counts.filter("term is not null").select("lang", "source", "term", "n", "docs")
    kept = cells.groupBy("lang", "term").agg(F.sum("n").alias("count"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs")
    rare = F.floor(F.log2("count")).cast("int").alias("class")
    kept = written(kept.select("lang", "term", "count", rare), "kept")
    sizes = kept.groupBy("lang", "class").agg(F.count("*").alias("many"))
    blocks_of = F.ceil(F.col("many") / F.when(F.col("class") < RARE, RARE_TERMS).otherwise(OTHER_TERMS)).cast("int")
    # a class may hold most terms, so its rows meet their number of blocks in SALTS parts
    part = F.pmod(F.xxhash64("term", F.lit("part")), F.lit(SALTS)).cast("int")
    spread_sizes = sizes.select("lang", "class", blocks_of.alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    dealt = kept.withColumn("part", part).join(spread_sizes, ["lang", "class", "part"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).drop("blocks", "part")
    cells = written(cells.drop("docs").join(dealt, ["lang", "term"]), "cells")

    languages = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("count").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = written(groups.na.fill(0, ["total", "terms", "lang_total"]).withColumn("group", place.cast("int")), "groups")

    # columns of sources meet in pairs of source blocks
    spread = F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / BLOCK_SOURCES).cast("int"))
    mine = F.floor(F.col("group") / BLOCK_SOURCES).cast("int")
    how_many = groups.groupBy("lang").agg(F.max("group").alias("groups")).withColumn("groups", F.col("groups") + 1)
    ends = groups.join(how_many, "lang").withColumn("other", F.explode(spread)).select("lang", "source", "group", "total", "terms", F.least(mine, "other").alias("one"), F.greatest(mine, "other").alias("two"))
    heads = dealt.groupBy("lang", "class", "block").agg(F.count("*").alias("many")).join(ends, "lang")
    by = ["lang", "class", "block", "one", "two"]
    no_cell = [F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("n", "long"))]
    no_head = [F.lit(None).cast("long").alias(c) for c in ("total", "terms", "many")]
    head = heads.select(*by, "group", "total", "terms", "many", *no_cell)
    body = cells.join(ends, ["lang", "source"]).select(*by, "group", *no_head, "term", "n")
    parts = head.unionByName(body).withColumn("cell", F.col("term").isNotNull()).repartition(*by).sortWithinPartitions(*by, "cell")

    def multiply(batches):
        now, held = None, []

        def settle():
            """The joint tables of one block of terms and two blocks of sources; its first rows are the sources."""
            t = pa.Table.from_batches(held)
            group, cell = t.column("group").to_numpy(), t.column("cell").to_numpy(zero_copy_only=False)
            names = group[~cell]
            if not len(names):
                return [], [], []
            total, terms, many = (t.column(c).filter(pa.array(~cell)).to_pylist() for c in ("total", "terms", "many"))
            code = t.column("term").combine_chunks().filter(pa.array(cell)).dictionary_encode()
            place = np.zeros(int(max(names.max(), group.max())) + 1, np.int64)
            place[names] = np.arange(len(names))
            c = np.zeros((len(code.dictionary), len(names)), np.int64)
            c[code.indices.to_numpy(), place[group[cell]]] = t.column("n").filter(pa.array(cell)).to_numpy()
            block = names // BLOCK_SOURCES
            found = joint_prices(c, many[0], np.array(total, object), terms[0], np.flatnonzero(block == now[3]), np.flatnonzero(block == now[4]))
            g, h, value = zip(*found) if found else ((), (), ())
            return names[list(g)].tolist(), names[list(h)].tolist(), [int(x) for x in value]

        def rows(found):
            lang = [k for k, f in found for _ in f[0]]
            cols = [[x for _, f in found for x in f[i]] for i in range(3)]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([lang, *cols], kinds)], names=["lang", "group", "other", "value"])

        for b in batches:
            if not b.num_rows:
                continue
            found = []
            codes = [b.column(c).dictionary_encode().indices.to_numpy() if c == "lang" else b.column(c).to_numpy() for c in by]
            cuts = [0, *(np.flatnonzero((np.diff(np.stack(codes), axis=1) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                at = tuple(b.column(c)[lo].as_py() for c in by)
                if at != now:
                    if now is not None:
                        found.append((now[0], settle()))
                    now, held = at, []
                held.append(b.slice(lo, hi - lo))
            yield rows(found)
        if now is not None:
            yield rows([(now[0], settle())])

    values = parts.mapInArrow(multiply, "lang string, group int, other int, value long").groupBy("lang", "group", "other").agg(F.sum("value").alias("value"))
    name = groups.select("lang", "group", "source")
    items = name.select("lang", F.col("group").alias("other"), F.col("source").alias("item"))
    pairs = name.join(items, "lang").filter("group != other").join(values, ["lang", "group", "other"], "left")
    by_value = [F.desc("value"), "item"]
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value)))

    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("count"), F.col("lang_total"), F.col("terms"))
    apart = cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    apart = apart.select("lang", "source", F.lit("term").alias("part"), "item", price(F.col("p"), F.col("q")).alias("value"))
    salted = apart.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*by_value))).filter(F.col("rank") <= ranks).drop("rank", "salt")
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value))).filter(F.col("rank") <= ranks)
    return pairs.unionByName(first)
