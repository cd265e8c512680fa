"""Conversations out of reply trees, as marked-up text with a loss mask; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Fixed strings of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """One backslash more between "<" and "|", so that no control string is left inside."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def unescape_role(role: Column) -> Column:
    """Line feeds first: an odd backslash before "n" is one; then doubled backslashes."""
    lines = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.regexp_replace(lines, r"\\\\", r"\\")


def chains(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Flat conversations as trees: each turn replies to the one before it.

    Ties of `order` go by role and text. Null roles and texts are empty. A score is the
    text's length. Returns tree, node, parent, role, text, score.
    """
    w = Window.partitionBy("tree").orderBy("o", "role", "text")
    t = turns.select(F.col(f"`{key}`").alias("tree"), F.col(f"`{order}`").alias("o"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    t = t.withColumn("node", F.row_number().over(w).cast("long"))
    return t.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


def best_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """The `per_tree` root-to-leaf paths of highest total score in each tree: tree, leaf, node, depth, rank.

    Self-joins double the reach of each node's known ancestor, so a path of n turns takes
    log2(n) rounds; each round is written to the shared folder. Nodes with a missing
    parent are roots; nodes on a cycle have no root and are left out. Ties go to the
    smaller leaf. A null tree is a tree of its own.
    """
    spark = nodes.sparkSession
    nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    up = F.when(F.col("n").isNotNull(), F.col("parent"))
    jump = nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left").select("tree", "node", up.alias("up"), F.lit(1).cast("long").alias("depth"), "score")
    size = nodes.count()
    jumps, rooted = [], None
    for _ in range(size.bit_length() + 1):
        jump = written(jump, "jump")
        jumps.append(jump)
        done, going = jump.filter("up is null"), jump.filter("up is not null")
        rooted = rooted.unionByName(done) if rooted else done
        if going.isEmpty():
            break
        # only nodes that haven't reached their root go on
        far = rooted.unionByName(going).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        jump = going.join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("score") + F.col("score2")).alias("score"))
    parents = nodes.select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = rooted.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    w = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    path = leaves.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_tree)
    path = path.select("tree", F.col("node").alias("leaf"), "node", "depth", "rank")
    for k in range(len(jumps) - 2, -1, -1):
        # all nodes 2^k above those found so far; every distance is one sum of such powers
        step = jumps[k].filter("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        above = path.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        path = written(path.unionByName(above.select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"), "rank")), "path")
    return path


def format_paths(nodes: DataFrame, per_tree: int = 1, learn: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, rank, formatted, loss (start and length in code points of each masked text).

    A turn is written as start mark, role, line feed, text, end mark, line feed. Control
    strings inside texts and roles are escaped reversibly. Null texts and roles are
    empty. The mask covers the texts of the role `learn`. Empty input gives no rows.
    """
    path = best_paths(nodes, per_tree).withColumnsRenamed({"tree": "t", "node": "n"})
    own = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = path.join(own, F.col("t").eqNullSafe(F.col("tree")) & (F.col("n") == F.col("node"))).select(
        "tree", "leaf", "rank", "depth", (F.col("role") == learn).alias("masked"), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body")
    )
    tail = END + "\n"
    before = F.sum(F.length("head") + F.length("body") + len(tail)).over(Window.partitionBy("tree", "leaf").orderBy("depth")) - F.length("body") - len(tail)
    rows = rows.withColumn("start", before.cast("long"))
    turn = F.struct("depth", F.concat("head", "body", F.lit(tail)).alias("turn"))
    span = F.when(F.col("masked"), F.struct("start", F.length("body").cast("long").alias("length")))
    out = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sort_array(F.collect_list(span)).alias("loss"))
    return out.select("tree", "leaf", "rank", F.array_join("turns.turn", "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """Roles, texts and loss text out of `formatted` and `loss` alone, as digests."""
    turns = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    role = lambda t: unescape_role(F.substring_index(t, "\n", 1))
    text = lambda t: unescape(F.substring_index(F.substring(t, F.instr(t, "\n") + 1, F.length(t)), END, 1))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(role(t), F.lit("\n"), text(t), F.lit("\n"))), "")
    lost = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    return formatted.withColumn("turns", turns).select(
        "tree", "leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )
