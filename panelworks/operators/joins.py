"""Joins that Spark has no single call for: validated, as-of, validity windows, ranges, remaps.

All are equi-joins with an aggregate or a residual condition, so both sides move by key and no side is
ever paired with all of the other. Nothing is broadcast by force; Spark does so where its statistics allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelworks.session import saved


#: Rows of one key that are put in order together; a longer history is cut into blocks of time.
BLOCK_ROWS = 100_000


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` unchanged; the query fails when a key comes twice. The check runs inside the plan."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    bad = F.raise_error(F.concat(F.lit("duplicate key "), F.to_json(F.struct(*keys))))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, bad.cast("boolean")).otherwise(True)).drop("_n")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(require_unique(right, keys), keys, "left")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], year: str, right_year: str, values: list[str], tolerance: int, row_id: list[str], tie: str | None = None) -> DataFrame:
    """For each left row the values of the key's right row with the nearest year within ``tolerance``, else nulls.

    A tie takes the earlier year. ``tie`` orders right rows of one year. Right rows are first dealt to the years
    they can serve, so the join is on (key, year) and a key with a long history is not paired with all of itself."""
    served = F.explode(F.sequence(F.col(right_year) - tolerance, F.col(right_year) + tolerance))
    r = right.where(F.col(right_year).isNotNull()).select(*keys, F.col(right_year).alias("_ry"), F.struct(*values, *( [F.col(tie).alias("_t")] if tie else [])).alias("_v"), served.alias(year))
    order = F.struct(F.abs(F.col("_ry") - F.col(year)), F.col("_ry"), *([F.col("_v._t")] if tie else []))
    best = r.groupBy(*keys, year).agg(F.min_by(F.struct(F.col("_v"), F.col("_ry")), order).alias("_b"))
    del row_id
    return left.join(best, [*keys, year], "left").select(*left.columns, *[F.col(f"_b._v.{v}").alias(v) for v in values], F.col("_b._ry").alias("matched_year"))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, valid_from: str, valid_to: str, values: list[str]) -> DataFrame:
    """The latest right window that starts at or before ``at``; its values only while ``at`` < valid_to. A null key or ``at`` has none.

    A window serves until the next one of its key starts, so a left row's window starts in the last block of times that
    holds a start at or before it. Both sides are laid in one order for each (key, block), and what a block hands on to the
    next ones is the last start before it, a row for each block: a key with a long history is cut into blocks of
    BLOCK_ROWS rows and never sorted by one task. Rows of each key are counted first; a key with up to BLOCK_ROWS is one block,
    so where no key has more, both sides move once."""
    usable = F.lit(True)
    for k in [*keys, at]:
        usable = usable & F.col(k).isNotNull()
    own = F.struct(*[F.col(c) for c in left.columns])
    window = F.struct(valid_from, valid_to, *values)
    w = right.select(window.alias("w")).schema["w"].dataType
    l = left.where(usable).select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), own.alias("_row"), F.lit(None).cast(w).alias("_w"))
    r = right.where(F.col(valid_from).isNotNull()).select(*keys, F.col(valid_from).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), window.alias("_w"))
    both = r.dropna(subset=keys).unionByName(l)
    order = [F.col("_t"), F.col("_side"), *[F.col(f"_w.{c}") for c in (valid_to, *values)]]
    inner = lambda by: F.last("_w", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    size = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi")).where(F.col("_n") > BLOCK_ROWS)
    size = saved(size, "long-histories")
    if size.isEmpty():
        found = both.withColumn("_last", inner(keys)).where("_side = 1")
    else:
        short = both.join(size, keys, "left_anti").withColumn("_last", inner(keys)).where("_side = 1")
        number = lambda c: F.col(c).cast("double") if dict(both.dtypes)["_t"] not in ("date", "timestamp") else F.unix_seconds(F.col(c).cast("timestamp")).cast("double")
        place = F.floor((number("_t") - number("_lo")) / F.greatest(number("_hi") - number("_lo"), F.lit(1e-9)) * F.ceil(F.col("_n") / BLOCK_ROWS))
        cut = both.join(size, keys).withColumn("_block", F.coalesce(place, F.lit(0))).drop("_n", "_lo", "_hi")
        last = cut.where("_side = 0").groupBy(*keys, "_block").agg(F.max_by("_w", F.struct(F.col("_t"), *[F.col(f"_w.{c}") for c in (valid_to, *values)])).alias("_in"))
        blocks = cut.select(*keys, "_block").distinct().join(last, [*keys, "_block"], "left")
        blocks = blocks.withColumn("_in", F.last("_in", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
        long = cut.withColumn("_last", inner([*keys, "_block"])).where("_side = 1").join(blocks, [*keys, "_block"]).withColumn("_last", F.coalesce("_last", "_in"))
        found = short.unionByName(long.select(*short.columns))
    live = F.col("_t") < F.col(f"_last.{valid_to}")
    none = left.where(~usable).select(*left.columns, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    return found.select("_row.*", *[F.when(live, F.col(f"_last.{v}")).alias(v) for v in values]).unionByName(none)


def covering(left: DataFrame, windows: DataFrame, keys: list[str], at: Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Pairs of a left row and each of its key's windows that cover ``at``."""
    return left.join(windows, keys).where((F.col(valid_from) <= at) & (at < F.col(valid_to)))


def interval_years(df: DataFrame, lo: str, hi: str, year: str = "year") -> DataFrame:
    """A row for each year of [lo, hi]; reversed and empty ranges give none."""
    return df.where(F.col(lo) <= F.col(hi)).withColumn(year, F.explode(F.sequence(F.col(lo), F.col(hi))))


def in_range(points: DataFrame, ranges: DataFrame, keys: list[str], pos: str, begin: str, end: str, tolerance: float, step: float) -> DataFrame:
    """Points on a range of the same route, ``tolerance`` around both ends included.

    Ranges are cut into cells of ``step``, so a route with very many ranges spreads over many keys."""
    cell = lambda c: F.floor(c / step)
    r = ranges.withColumn("_c", F.explode(F.sequence(cell(F.col(begin) - tolerance), cell(F.col(end) + tolerance))))
    p = points.withColumn("_c", cell(F.col(pos)))
    return p.join(r, [*keys, "_c"]).where(F.col(pos).between(F.col(begin) - tolerance, F.col(end) + tolerance)).drop("_c")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, step: float) -> DataFrame:
    """Pairs on one link whose ranges overlap, with ``overlap`` = min(ends) - max(starts) > 0. A range without length or
    with a null end overlaps nothing.

    Both sides are dealt to cells of ``step`` (choose it near the usual length), so a link with very many ranges spreads over
    many keys; a pair is taken in the first cell that both reach, once."""
    first = lambda s: F.floor(F.col(s) / step)
    cells = lambda df, s, e, name: df.where(F.col(s) < F.col(e)).withColumn("_c", F.explode(F.sequence(first(s), first(e)))).withColumn(name, first(s))
    both = cells(left, ls, le, "_cl").join(cells(right, rs, re, "_cr"), [*keys, "_c"]).where(F.col("_c") == F.greatest("_cl", "_cr"))
    return both.drop("_c", "_cl", "_cr").withColumn("overlap", F.least(le, re) - F.greatest(ls, rs)).where("overlap > 0")


def remap_guarded(df: DataFrame, crosswalk: DataFrame, code: str, others: list[str]) -> DataFrame:
    """Moves rows to the successor code unless the target key is held by a row that keeps its own code.

    Adds ``moved`` and ``blocked``. Two moved rows that meet on a free key both move."""
    mapped = df.join(crosswalk.select(F.col("old_code").alias(code), "new_code"), code, "left")
    held = mapped.where("new_code is null").select(F.col(code).alias("new_code"), *others).distinct().withColumn("_held", F.lit(True))
    out = mapped.join(held, ["new_code", *others], "left")
    moved = F.col("new_code").isNotNull() & F.col("_held").isNull()
    return out.select(F.when(moved, F.col("new_code")).otherwise(F.col(code)).alias(code), *[c for c in df.columns if c != code], moved.alias("moved"), (F.col("new_code").isNotNull() & ~moved).alias("blocked"))


def fill_latest(df: DataFrame, lookup: DataFrame, key: str, year: str, value: str, tag: str) -> DataFrame:
    """Fills a missing value from the key's latest lookup row that has one, and says so in ``tag``."""
    latest = lookup.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, year).alias("_fill"))
    out = df.join(latest, key, "left")
    source = F.when(F.col(value).isNotNull(), "own").when(F.col("_fill").isNotNull(), "lookup")
    return out.withColumn(tag, source).withColumn(value, F.coalesce(value, "_fill")).drop("_fill")


def member_flag(df: DataFrame, keys: DataFrame, on: str, out: str) -> DataFrame:
    """Whether ``on`` is among the keys."""
    return df.join(keys.select(on).distinct().withColumn(out, F.lit(True)), on, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest on ties, and its share."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value), (F.max("_n") / F.sum("_n")).alias("share"))
