"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: The kinds in their fixed order, and the kind that only contexts can tell.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
_LOCAL, _NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Each finds the leftmost matches of its kind in linear time: look-behinds (and the end of the
#: match before) leave only places where a leftmost match can begin, and what a greedy run
#: took is not given back where that can't help. For cards only runs of 12 to 19 digits match.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words of 5 to 128 characters with a digit: what may be an identifier.
CANDIDATE = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]{0,40}[0-9])[A-Za-z0-9][A-Za-z0-9._%+@-]{3,126}[A-Za-z0-9](?![A-Za-z0-9._%+@-])"
#: Candidates that seed the kind `secret`: long, of letters and digits in no order that words have.
SECRET = r"^(?=.*[0-9].*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z].*[A-Za-z].*[A-Za-z].*[A-Za-z])[A-Za-z0-9_-]{32,}$"
#: Distinct characters that such a seed has at least.
VARIED = 8
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "0-9", "phone": "+"}
#: Code points before and after a match in which its context is sought.
REACH, BEYOND = 48, 8
ROUNDS, SUPPORT, SURE = 3, 3, 0.6


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: doubled(F.substring(digits, i + 1, F.lit(1)).cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """The rules of each kind for a whole match."""
    n_digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(kind == "ip", match.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", _luhn(match))
        .when(kind == "phone", n_digits.between(9, 15))
        .otherwise(True)
    )


def _found(text: Column, pattern: str, needs: Column) -> Column:
    """Matches in order: (gap to the match before, the last code points of that gap, the first after the match, match)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("gap"), F.substring(p, -REACH, REACH).alias("left"), F.substring(p, 1, BEYOND).alias("right")))
    sides = F.zip_with(F.slice(between, 1, F.size(matches)), F.slice(between, 2, F.size(matches)), lambda p, q: F.struct(p["gap"].alias("gap"), p["left"].alias("left"), q["right"].alias("right")))
    pairs = F.zip_with(sides, matches, lambda p, m: F.struct(p["gap"].alias("gap"), p["left"].alias("left"), p["right"].alias("right"), m.alias("match")))
    none = F.expr("cast(null as array<struct<gap:int,left:string,right:string,match:string>>)")
    return F.when(needs & (F.size(matches) > 0), pairs).otherwise(none)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with __row and the matches of each kind and of candidates; one pass over the texts, written."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    src = docs.withColumn("__text", t).drop(text).withColumn("__row", F.monotonically_increasing_id())
    c = F.col("__text")
    digits = c.rlike("[0-9]")
    has = {"email": F.contains(c, F.lit("@")), "ip": digits, "card": digits, "phone": F.contains(c, F.lit("+"))}
    found = [_found(c, PATTERNS[k], has[k]).alias(f"__{k}") for k in KINDS] + [_found(c, CANDIDATE, digits).alias("__other")]
    return written(src.select(*[F.col(f"`{x}`") for x in src.columns if x != "__text"], *found), "scan")


def occurrences(scanned: DataFrame) -> DataFrame:
    """__row, kind ("other" for candidates), start, end (code points, end exclusive), match, left, right."""
    rows = [scanned.filter(f"__{k} is not null").select("__row", F.lit(k).alias("kind"), F.posexplode(f"__{k}").alias("i", "m")) for k in (*KINDS, "other")]
    all_ = rows[0]
    for r in rows[1:]:
        all_ = all_.unionByName(r)
    w = Window.partitionBy("__row", "kind").orderBy("i")
    size = F.length("m.match")
    out = all_.withColumn("end", F.sum(F.col("m.gap") + size).over(w).cast("long")).withColumn("start", F.col("end") - size)
    return out.select("__row", "kind", "start", "end", F.col("m.match").alias("match"), F.col("m.left").alias("left"), F.col("m.right").alias("right")).filter(valid(F.col("kind"), F.col("match")))


def shape(match: Column) -> Column:
    """The kinds of characters of a match, and the power of two that its length has reached."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(match, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.split(plain, ""))), "")
    return F.concat(kinds, F.lit(":"), F.floor(F.log2(F.length(match))).cast("string"))


def contexts(left: Column, right: Column, match: Column) -> Column:
    """Patterns in whose place a match stands; lower case, digits are one digit.

    Lexical ones are the last word before it with the marks that follow that word, alone if
    there are marks, and with the mark after the match; and the last two words. Each of the
    first two also comes with the shape of the match, so that like strings after a like mark
    support each other.
    """
    squeeze = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "0"), r"\s+", " ")
    word = squeeze(F.regexp_extract(left, r"(\pL+[^\pL]*)$", 1))
    two = squeeze(F.regexp_extract(left, r"(\pL+[^\pL]+\pL+[^\pL]*)$", 1))
    after = F.regexp_extract(right, r"^([^\pL\pN\s]+)", 1)
    marked = word.rlike(r"[^\pL\s]")
    around = F.when(marked & (after != ""), F.concat(word, F.lit("\u2026"), F.substring(after, 1, 1)))
    word = F.when(marked, word)
    shaped = lambda c: F.concat(c, F.lit("\u2028"), shape(match))
    return F.array_distinct(F.array_compact(F.array(word, around, F.when(two != "", two), shaped(word), shaped(around))))


def seed_kind(kind: Column, match: Column) -> Column:
    """The kind that a match shows by itself: the fixed kinds, and strings that only a secret looks like."""
    varied = F.size(F.array_distinct(F.split(F.lower(match), ""))) >= VARIED
    return F.when(kind != "other", kind).when(match.rlike(SECRET) & varied, "secret")


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """Patterns in whose place identifiers of a kind stand: pattern, kind, score.

    Nodes are patterns (words and marks on both sides, with or without the shape) and
    instances (matched strings); an edge says that an instance stood in a pattern. Instances
    that show their kind by themselves start with weight 1 for it. A pattern's score for a
    kind is the weight of its distinct instances over their number plus one; patterns of at
    least `support` weight count. A candidate's weight is the chance that one of its
    patterns of score `sure` or more is right. After `rounds`, patterns of score `sure` or
    more remain. Edges and scores are aggregated before they are shuffled, so a pattern or
    string in a third of all places is one row a task.
    """
    edges = found.select(F.explode(contexts(F.col("left"), F.col("right"), F.col("match"))).alias("pattern"), "match", seed_kind(F.col("kind"), F.col("match")).alias("kind"))
    edges = written(edges.groupBy("pattern", "match").agg(F.min("kind").alias("seed")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.filter("seed is not null").select("pattern", "match", F.col("seed").alias("kind"), F.lit(1.0).alias("weight"))
    known = seeds
    for i in range(rounds):
        weight = known.groupBy("pattern", "kind").agg(F.sum("weight").alias("weight")).filter(F.col("weight") >= support)
        scores = weight.join(sizes, "pattern").select("pattern", "kind", (F.col("weight") / (F.col("n") + 1)).alias("score")).filter(F.col("score") >= sure)
        scores = written(scores, "scores")
        if i + 1 < rounds:
            new = edges.filter("seed is null").join(scores, "pattern")
            weights = new.groupBy("match", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("weight"))
            known = seeds.unionByName(edges.filter("seed is null").select("pattern", "match").join(weights, "match").select("pattern", "match", "kind", "weight"))
    return scores


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with `base` and `spans`: arrays of (start, place, end, kind), sorted.

    `base` holds the matches of the fixed kinds that keep their rules, `spans` also the
    candidates in a bootstrapped pattern (with its kind; the surest, then the first kind)
    that don't overlap a base span: further identifiers of the fixed kinds, and secrets such
    as tokens. `place` is the kind's place in ALL_KINDS. Positions count code points of the
    whole text. Null and empty texts have no spans; repeated rows give repeated
    results; an empty table gives none. Columns named base or spans are replaced.
    """
    scanned = scan(docs.drop("base", "spans"), text)
    found = written(occurrences(scanned), "found")
    patterns = bootstrap(found)
    after = Window.partitionBy("__row").orderBy("start", "end").rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy("__row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    is_base = F.col("kind") != "other"
    free = found.withColumn("taken", F.max(F.when(is_base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(after))
    free = free.filter("kind = 'other' and coalesce(taken, 0) <= start and (next is null or next >= end)")
    # a base span of the same start and end may sort after or before; both are seen above
    hits = free.select("__row", "start", "end", F.explode(contexts(F.col("left"), F.col("right"), F.col("match"))).alias("pattern")).join(patterns, "pattern")
    place = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")).cast("int") - 1
    extra = hits.withColumn("place", place).groupBy("__row", "start", "end").agg(F.min(F.struct(-F.col("score"), "place", "kind")).alias("best"))
    extra = extra.select("__row", "start", "end", F.col("best.place").alias("place"), F.col("best.kind").alias("kind"), F.lit(False).alias("fixed"))
    spans = found.filter(is_base).select("__row", "start", "end", place.alias("place"), "kind", F.lit(True).alias("fixed")).unionByName(extra)
    one = F.struct("start", "place", "end", "kind")
    lists = spans.groupBy("__row").agg(F.sort_array(F.collect_list(F.when(F.col("fixed"), one))).alias("base"), F.sort_array(F.collect_list(one)).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:bigint,place:int,end:bigint,kind:string>>)")
    kept = scanned.drop(*[f"__{k}" for k in (*KINDS, "other")])
    return kept.join(lists, "__row", "left").withColumns({c: F.coalesce(c, none) for c in ("base", "spans")}).drop("__row")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, with each span of `text` replaced by its kind in angle brackets; overlapping spans by the first one's.

    Null texts stay null; texts without spans stay as they are.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{text}`").alias("__scan"))
    found = personal_data(whole, "__scan")
    ends = F.transform("spans", lambda s: s["end"])
    # a span that begins before the largest end so far is part of an earlier one; spans are few, or far apart
    reach = F.transform("spans", lambda s, i: F.coalesce(F.array_max(F.slice(ends, 1, i)), F.lit(0)))
    own = F.zip_with("spans", reach, lambda s, r: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), r.alias("reach")))
    body = F.col(f"__doc.`{text}`")
    cut = lambda a, b: F.substring(body, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    pieces = F.transform(own, lambda s: F.when(s["start"] >= s["reach"], F.concat(cut(s["reach"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))
    new = F.concat(F.array_join(pieces, ""), F.substring(body, (F.array_max(ends) + 1).cast("int"), F.length(body)))
    new = F.when(F.size("spans") > 0, new).otherwise(body)
    return found.select(*[(new if c == text else F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])
