"""Roll-ups, standardisation and per-group ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelworks.session import saved


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of w*x over sum of w, over rows that have both."""
    both = x.isNotNull() & w.isNotNull()
    return F.sum(F.when(both, w * x)) / F.nullif(F.sum(F.when(both, w)), F.lit(0.0))


def first_event(year: Column, qualifies: Column, name: str) -> list[Column]:
    """Earliest year, whether ever, and whether a qualifying record is undated."""
    return [F.min(F.when(qualifies, year)).alias(f"first_{name}"), F.bool_or(qualifies).alias(f"ever_{name}"), F.bool_or(qualifies & year.isNull()).alias(f"unknown_{name}")]


def tiered_first_event(df: DataFrame, keys: list[str], year: Column, tiers: dict[str, Column]) -> DataFrame:
    """Every tier in one pass. Tiers should nest, from loose to strict."""
    return df.groupBy(*keys).agg(*[c for name, q in tiers.items() for c in first_event(year, q, name)])


def z_within(df: DataFrame, cell: list[str], x: str, out: str) -> DataFrame:
    """(x - mean) / sample deviation inside a cell; null for a single row or no spread.

    Mean and deviation are aggregated with partial sums and joined back, so a large cell isn't gathered in one task."""
    s = df.groupBy(*cell).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    return df.join(s, cell, "left").withColumn(out, (F.col(x) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def weighted_z_within(df: DataFrame, cell: list[str], x: str, w: str, out: str) -> DataFrame:
    """Weighted z with the population deviation of rows that have both; a row without a weight still gets a z."""
    xc, wc = F.col(x), F.col(w)
    both = xc.isNotNull() & wc.isNotNull()
    mean = df.groupBy(*cell).agg(F.sum(F.when(both, wc)).alias("_w"), F.sum(F.when(both, wc * xc)).alias("_wx")).withColumn("_m", F.col("_wx") / F.nullif(F.col("_w"), F.lit(0.0)))
    centred = df.join(mean.select(*cell, "_m", "_w"), cell, "left")
    var = centred.groupBy(*cell).agg((F.sum(F.when(both, wc * F.pow(xc - F.col("_m"), 2))) / F.nullif(F.max("_w"), F.lit(0.0))).alias("_v"))
    return centred.join(var, cell, "left").withColumn(out, (xc - F.col("_m")) / F.nullif(F.sqrt("_v"), F.lit(0.0))).drop("_m", "_w", "_v")


def stitched(df: DataFrame, era: str, x: str, w: str, name: str, keep: list[str]) -> DataFrame:
    """One series across a break of scale: the columns ``keep``, ``outcome`` and ``value``.

    Every era is standardised by itself, over all its years: as ``<name>_z`` with rows alike, as ``<name>_zw`` weighted by ``w``
    over the rows with a positive weight. Rows without a value, and eras without spread, give no rows."""
    known = df.where(F.col(x).isNotNull())
    plain = z_within(known, [era], x, "value").select(*keep, F.lit(f"{name}_z").alias("outcome"), "value")
    heavy = weighted_z_within(known.where(F.col(w) > 0), [era], x, w, "value").select(*keep, F.lit(f"{name}_zw").alias("outcome"), "value")
    return plain.unionByName(heavy).where(F.col("value").isNotNull())


def local_intensity(own: DataFrame, routes: DataFrame, route: str, entity: str, value: str, year: str, mean: str, reference: int) -> DataFrame:
    """(route, entity, year, intensity, scaled): an entity's own value over its route's mean in the reference year, and that ratio
    times the route's mean of every year. A mean of zero or less gives no ratio."""
    base = routes.where(F.col(year) == reference).select(route, F.col(mean).alias("_base"))
    ratio = own.join(base, route).select(route, entity, F.when(F.col("_base") > 0, F.col(value) / F.col("_base")).alias("intensity"))
    return ratio.join(routes.select(route, year, F.col(mean).alias("_m")), route).select(route, entity, year, "intensity", (F.col("intensity") * F.col("_m")).alias("scaled"))


def run_report(df: DataFrame, unit: str, year: Column, tiers: dict[str, Column], matched: Column, more: dict[str, Column] | None = None) -> DataFrame:
    """One row on a run: rows, distinct units, the range of years, units of each tier, matched rows and their share."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows"), F.count_distinct(unit).alias("n_units"), F.min(year).alias("first"), F.max(year).alias("last"), *[F.count_distinct(F.when(q, F.col(unit))).alias(f"n_{name}") for name, q in tiers.items()],
                  F.count(matched).alias("n_matched"), F.round(F.count(matched) / n, 6).alias("match_rate"), *[c.alias(k) for k, c in (more or {}).items()])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def earliest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def current_or_latest(df: DataFrame, keys: list[str], current: Column, order: list[Column]) -> DataFrame:
    """One row of each key: of its rows that are ``current`` the last in ``order``, else the last of all. A null ``current`` is false."""
    marked = df.withColumn("_now", F.coalesce(current, F.lit(False)))
    return latest(marked, keys, [F.col("_now"), *order]).drop("_now")


def gap_to_previous(df: DataFrame, key: str, start: str, end: str, out: str) -> DataFrame:
    """``df`` with the distance from the end of the key's previous range to the start of this one; negative where they overlap, null for the first."""
    before = Window.partitionBy(key).orderBy(start, end)
    return df.withColumn(out, F.col(start) - F.lag(end).over(before))


def yearly_changes(df: DataFrame, unit: list[str], year: str, value: str, out: str) -> DataFrame:
    """(unit, year, change): the change of ``value`` from the year before; years without a year before have no row."""
    before = df.select(*unit, (F.col(year) + 1).alias(year), F.col(value).alias("_before"))
    return df.join(before, [*unit, year]).select(*unit, year, (F.col(value) - F.col("_before")).alias(out))


def quantile_group(x: Column, cuts: Column, n: int) -> Column:
    """1 to ``n`` by the ``n`` - 1 cut points; values on a cut belong below it, so ties are never split. Null stays null."""
    out = F.when(x <= cuts[0], 1)
    for k in range(1, n - 1):
        out = out.when(x <= cuts[k], k + 1)
    return out.when(x.isNotNull(), n)


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of the one row of ``right`` with equal keys; a null key meets a null key."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*[f"_k_{k}" for k in keys])


def holm(df: DataFrame, family: list[str], p: str, out: str) -> DataFrame:
    """Holm's step-down adjustment inside a family of tests. A null p stays null and isn't counted as a test.

    Tests are laid in one order by range partitions; a family hands on from one to the next only how many tests came before
    and the highest step so far, so no family is sorted by one task."""
    rest = [c for c in df.columns if c not in family and c != p]
    m = df.groupBy(*family).agg(F.count(p).alias("_m"))
    order = [F.asc_nulls_last(p), *rest]
    parts = saved(beside(df, m, family).repartitionByRange(*family, *order).withColumn("_p", F.spark_partition_id()), "tests")
    inner, earlier = Window.partitionBy(*family, "_p").orderBy(*order), Window.partitionBy(*family).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(*family, "_p").agg(F.count(F.lit(1)).alias("_n")).select(*family, "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(inner)
    steps = saved(beside(parts, before, [*family, "_p"]).withColumn("_s", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), (F.col("_m") - rank + 1) * F.col(p)))), "steps")
    peak = steps.groupBy(*family, "_p").agg(F.max("_s").alias("_top")).select(*family, "_p", F.max("_top").over(earlier).alias("_peak"))
    high = F.greatest(F.max("_s").over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.col("_peak"))
    return beside(steps, peak, [*family, "_p"]).select(*df.columns, F.when(F.col(p).isNotNull(), high).alias(out))


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """The sum of ``value`` over all earlier rows of the whole table in ``order``, by range partitions.

    Only one sum for each partition meets in one place. ``order`` should tell all rows apart."""
    parts = saved(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).withColumn("_v", value), "ranges")
    sums = parts.groupBy("_p").agg(F.sum("_v").alias("_s"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return own.join(starts, "_p").withColumn(out, F.col("_base") + F.col("_in")).drop("_p", "_v", "_base", "_in")


def dense_ids(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Dense ids from 1 over the distinct keys, which are numbered on their own and joined back."""
    ids = running_total(df.select(*keys).distinct(), [F.col(k) for k in keys], F.lit(1), out)
    return df.join(ids.withColumn(out, (F.col(out) + 1).cast("int")), keys)


def permutation_rank(units: DataFrame, draws: int, seed: int, unit: str, top: int | None = None) -> DataFrame:
    """(draw, unit, rank[, chosen]): each draw shuffles the units by a hash, the same at any partitioning.

    Ranks are the running count over (draw, hash) by range partitions, so no draw is sorted by one task; ``chosen``: the
    first ``top`` of a draw."""
    every = units.select(unit).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_h", F.xxhash64(F.lit(seed), F.col("draw"), F.col(unit)))
    at = running_total(every, [F.col("draw"), F.col("_h"), F.col(unit)], F.lit(1), "_at")
    first = at.groupBy("draw").agg(F.min("_at").alias("_first"))
    out = at.join(first, "draw").select("draw", unit, (F.col("_at") - F.col("_first") + 1).cast("int").alias("rank"))
    return out if top is None else out.withColumn("chosen", F.col("rank") <= top)


def mutual_best(pairs: DataFrame, a: str, b: str, score: str, tie: float = 1e-9) -> DataFrame:
    """Pairs that are each other's best, without a tie on either side. Bests are aggregated and joined back."""
    top = pairs
    for side in (a, b):
        best = pairs.groupBy(side).agg(F.max(score).alias("_m"))
        n = pairs.join(best, side).where(F.col(score) >= F.col("_m") - tie).groupBy(side).agg(F.max("_m").alias("_m"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
        top = top.join(n, side).where(F.col(score) >= F.col("_m") - tie).drop("_m")
    return top.select(*pairs.columns)


def exact_cuts(df: DataFrame, x: str, at: list[float], by: list[str] | None = None) -> DataFrame:
    """([by,] cuts): the exact percentiles (linear interpolation) of the values that aren't null. Without any, a group
    has no row, and the whole table null cuts.

    Equal values are counted first and the counts added up in order by range partitions, so neither a group nor a
    frequent value meets in one task; only the values next to a cut go on."""
    by = by or []
    counted = saved(df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c")), "values")
    ranked = saved(running_total(counted, [*[F.col(k) for k in by], F.col("_x")], F.col("_c"), "_at"), "ranked")
    whole = ranked.groupBy(*by).agg(F.min("_at").alias("_first"), F.sum("_c").alias("_all"))
    near = beside(ranked, whole, by) if by else ranked.crossJoin(F.broadcast(whole))  # without groups one row of totals
    near = near.select(*by, "_x", (F.col("_at") - F.col("_first")).alias("_lo"), "_c", "_all")
    holds = lambda k: (F.col("_lo") <= k) & (k < F.col("_lo") + F.col("_c"))
    served = []
    for i, p in enumerate(at):
        pos = F.lit(float(p)) * (F.col("_all") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        share = F.when(holds(low) & holds(high), 1.0).when(holds(low), high - pos).when(holds(high), pos - low)
        served.append(F.struct(F.lit(i).alias("i"), (share * F.col("_x")).alias("v")))
    hits = near.select(*by, F.explode(F.filter(F.array(*served), lambda e: e["v"].isNotNull())).alias("e"))
    one = hits.groupBy(*by, "e.i").agg(F.sum("e.v").alias("v"))
    cuts = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"])
    return one.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 0, cuts).alias("cuts"))
