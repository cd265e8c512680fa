"""Order-dependent operators that never need a whole station in one task.

Every series has an integer position (hour number, day number or row number).
The axis is cut into chunks; a chunk sees a halo of neighbouring positions, and
facts that reach further than the halo (the last known value, the start of a
run, a running count) travel through a small table with one row per chunk. A
station that holds a third of the data is spread over as many tasks as it has
chunks.

Daily and weekly calendars hold one row per station and day, so a station's
series is bounded by the calendar (36,525 rows a century). For those size=None
asks for a plain window per station: one shuffle and a single read of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

CHUNK = 2048
CHUNK_ID = "_chunk"


def hour_number(ts: str | Column) -> Column:
    """Whole hours since the epoch."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(c.cast("timestamp")) / 3600).cast("long")


def day_number(date: str | Column) -> Column:
    """Days since the epoch."""
    c = F.col(date) if isinstance(date, str) else date
    return F.unix_date(c.cast("date")).cast("long")


def chunk_of(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("long")


def with_halo(df: DataFrame, pos: str, back: int, ahead: int, size: int = CHUNK) -> DataFrame:
    """Copy rows near a chunk border into the neighbours that need them."""
    if max(back, ahead) > size:
        raise ValueError("halo must not exceed the chunk size")
    home = chunk_of(F.col(pos), size)
    offset = F.col(pos) - home * size
    targets = [home]
    if back:
        targets.append(F.when(offset >= size - back, home + 1))
    if ahead:
        targets.append(F.when(offset < ahead, home - 1))
    if len(targets) == 1:
        return df.withColumn(CHUNK_ID, home).withColumn("_home", F.lit(True))
    return df.withColumn(CHUNK_ID, F.explode(F.array_compact(F.array(*targets)))).withColumn(
        "_home", F.col(CHUNK_ID) == home
    )


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    back: int = 0,
    ahead: int = 0,
    size: int | None = CHUNK,
) -> DataFrame:
    """Add window columns whose frames reach at most back/ahead positions."""
    if size is None:
        w = W.partitionBy(*keys).orderBy(pos)
        return df.select("*", *[build(w).alias(name) for name, build in columns.items()])
    w = W.partitionBy(*keys, CHUNK_ID).orderBy(pos)
    haloed = with_halo(df, pos, back, ahead, size)
    return (
        haloed.select("*", *[build(w).alias(name) for name, build in columns.items()])
        .filter("_home")
        .drop("_home", CHUNK_ID)
    )


def filled(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    forward: Mapping[str, Column] | None = None,
    backward: Mapping[str, Column] | None = None,
    size: int | None = CHUNK,
) -> DataFrame:
    """Nearest non-null value at or before (forward) / at or after (backward) each row."""
    forward, backward = dict(forward or {}), dict(backward or {})
    if size is None:
        w = W.partitionBy(*keys).orderBy(pos)
        upto, onward = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
        return df.select(
            "*",
            *[F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in forward.items()],
            *[F.first(c, ignorenulls=True).over(onward).alias(n) for n, c in backward.items()],
        )
    src = df.withColumn(CHUNK_ID, chunk_of(F.col(pos), size))
    src = src.select(
        "*",
        *[c.alias(f"_f_{n}") for n, c in forward.items()],
        *[c.alias(f"_b_{n}") for n, c in backward.items()],
    )
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(pos))
    per_chunk = src.groupBy(*keys, CHUNK_ID).agg(
        *[F.max_by(f"_f_{n}", at(f"_f_{n}")).alias(f"_f_{n}") for n in forward],
        *[F.min_by(f"_b_{n}", at(f"_b_{n}")).alias(f"_b_{n}") for n in backward],
    )
    chunks = W.partitionBy(*keys).orderBy(CHUNK_ID)
    before = chunks.rowsBetween(W.unboundedPreceding, -1)
    after = chunks.rowsBetween(1, W.unboundedFollowing)
    carried = per_chunk.select(
        *keys,
        CHUNK_ID,
        *[F.last(f"_f_{n}", ignorenulls=True).over(before).alias(f"_cf_{n}") for n in forward],
        *[F.first(f"_b_{n}", ignorenulls=True).over(after).alias(f"_cb_{n}") for n in backward],
    )
    inside = W.partitionBy(*keys, CHUNK_ID).orderBy(pos)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    onward = inside.rowsBetween(0, W.unboundedFollowing)
    local = src.select(
        *df.columns,
        CHUNK_ID,
        *[F.last(f"_f_{n}", ignorenulls=True).over(upto).alias(f"_lf_{n}") for n in forward],
        *[F.first(f"_b_{n}", ignorenulls=True).over(onward).alias(f"_lb_{n}") for n in backward],
    )
    return local.join(carried, [*keys, CHUNK_ID], "left").select(
        *df.columns,
        *[F.coalesce(f"_lf_{n}", f"_cf_{n}").alias(n) for n in forward],
        *[F.coalesce(f"_lb_{n}", f"_cb_{n}").alias(n) for n in backward],
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    sums: Mapping[str, Column],
    size: int | None = CHUNK,
) -> DataFrame:
    """Inclusive running sums in position order; a running sum of 1 is a row number."""
    if size is None:
        upto = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()])
    src = df.withColumn(CHUNK_ID, chunk_of(F.col(pos), size))
    src = src.select("*", *[c.alias(f"_s_{n}") for n, c in sums.items()])
    totals = src.groupBy(*keys, CHUNK_ID).agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy(CHUNK_ID).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        CHUNK_ID,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
    )
    inside = (
        W.partitionBy(*keys, CHUNK_ID).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    )
    local = src.select(
        *df.columns, CHUNK_ID, *[F.sum(f"_s_{n}").over(inside).alias(f"_l_{n}") for n in sums]
    )
    return local.join(carried, [*keys, CHUNK_ID], "left").select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums]
    )


def runs(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    state: Column,
    size: int | None = CHUNK,
) -> DataFrame:
    """Gaps and islands: a run ends where the position steps by more than 1 or the state changes.

    Adds run_first / run_last (positions of the run's ends) and run_len. NULL
    states compare equal. Borders are found with a one-step halo, run ends are
    carried over chunk borders, so a run may span any number of chunks.
    """
    src = df.withColumn("_state", state)

    def differs(w: WindowSpec, step: int) -> Column:
        other_pos = F.lag(pos, step).over(w) if step > 0 else F.lead(pos, -step).over(w)
        other = F.lag("_state", step).over(w) if step > 0 else F.lead("_state", -step).over(w)
        return (
            other_pos.isNull()
            | (F.abs(F.col(pos) - other_pos) != 1)
            | ~F.col("_state").eqNullSafe(other)
        )

    marked = windowed(
        src,
        keys,
        pos,
        {"_starts": lambda w: differs(w, 1), "_ends": lambda w: differs(w, -1)},
        back=1,
        ahead=1,
        size=size,
    )
    out = filled(
        marked,
        keys,
        pos,
        forward={"run_first": F.when(F.col("_starts"), F.col(pos))},
        backward={"run_last": F.when(F.col("_ends"), F.col(pos))},
        size=size,
    )
    return out.withColumn("run_len", F.col("run_last") - F.col("run_first") + 1).drop(
        "_state", "_starts", "_ends"
    )
