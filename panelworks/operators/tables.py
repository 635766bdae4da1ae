"""Small whole-table operators: renaming, filters, keys, fills and validity windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

OPEN = 99991231


def rename_ordered(df: DataFrame, names: dict[str, str], first: list[str]) -> DataFrame:
    """Renames the columns that are there; ``first`` come first, all others keep their order."""
    out = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    return out.select(*[c for c in first if c in out.columns], *[c for c in out.columns if c not in first])


def prefixed_column(df: DataFrame, prefix: str, name: str) -> DataFrame:
    """Renames the one column whose name starts with ``prefix``."""
    found = [c for c in df.columns if c.startswith(prefix)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns start with {prefix}")
    return df.withColumnRenamed(found[0], name)


def optional_filters(df: DataFrame, wanted: dict) -> DataFrame:
    """Applies each filter that is set and whose column exists; strings and booleans are compared without case."""
    for name, value in wanted.items():
        if value is None or name not in df.columns:
            continue
        col = F.col(name)
        df = df.where(F.lower(col.cast("string")) == str(value).lower() if isinstance(value, (str, bool)) else col == value)
    return df


def flag_shared(df: DataFrame, key: str, out: str) -> DataFrame:
    """Whether another row has the same key; a null key is shared with none."""
    many = df.where(F.col(key).isNotNull()).groupBy(key).agg((F.count(F.lit(1)) > 1).alias(out))
    return df.join(many, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def left_fill(df: DataFrame, other: DataFrame, on: list[str], fills: dict) -> DataFrame:
    """A left join; listed columns are filled, all others stay null where nothing matched."""
    return df.join(other, on, "left").fillna(fills)


def standardise_entities(units: DataFrame, value: str, out: str) -> DataFrame:
    """z over one row for each entity; sample deviation."""
    one = units.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return units.crossJoin(F.broadcast(one)).withColumn(out, (F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def roster(df: DataFrame, number: str, lo: int, hi: int, name: str) -> DataFrame:
    return df.where(F.col(number).between(lo, hi) & F.col(name).isNotNull()).select(name).distinct()


def day_number(ts):
    """A date as the integer YYYYMMDD."""
    return F.date_format(ts, "yyyyMMdd").cast("int")


def order_windows(orders: DataFrame, key: str = "o_custkey", date: str = "o_orderdate", tie: str = "o_orderkey") -> DataFrame:
    """[valid_from, valid_to) windows out of dated rows: each lasts to the key's next row, the last is open."""
    nxt = F.lead(day_number(date)).over(Window.partitionBy(key).orderBy(date, tie))
    return orders.withColumn("valid_from", day_number(date)).withColumn("valid_to", F.coalesce(nxt, F.lit(OPEN)))


def current_rows(df: DataFrame, valid_to: str = "valid_to") -> DataFrame:
    return df.where(F.col(valid_to) == OPEN)


def group_apply(df: DataFrame, keys: list[str], order: list[str], function, schema: str, buckets: int | None = None) -> DataFrame:
    """A Python function (pandas frame, in order) for groups that are small by nature, like one unit's history; larger ones belong into aggregates.

    Many groups share a call, as calls cost more than small groups: the function gets whole groups, one after the other, and column ``_group``
    that numbers them from 0. About a thousand groups meet in a call, or as many as ``buckets`` leave to each."""
    if buckets is None:
        n = df.select(F.approx_count_distinct(F.struct(*keys))).first()[0]
        buckets = max(1, n // 1000)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))

    def apply(g):
        g = g.drop(columns="_bucket").sort_values([*keys, *order], ignore_index=True)
        return function(g.assign(_group=g.groupby(keys, dropna=False, sort=False).ngroup()))

    return df.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandas(apply, schema)


def trend(y: str):
    """For ``group_apply``: the least-squares line of ``y`` over each group's order, as column ``trend``."""

    def fit(g):
        import numpy as np

        at, v = g["_group"].to_numpy(), g[y].to_numpy(float)
        n = np.bincount(at)
        k = np.arange(len(g)) - (np.cumsum(n) - n)[at]
        mean = lambda x: (np.bincount(at, weights=x) / n)[at]
        off = k - mean(k)
        spread, both = np.bincount(at, weights=off ** 2), np.bincount(at, weights=off * (v - mean(v)))
        slope = np.divide(both, spread, out=np.zeros(len(n)), where=spread > 0)
        out = g.assign(trend=mean(v) + slope[at] * off)
        return out[[c for c in out.columns if c not in (y, "o_orderdate", "_group")]]

    return fit


@F.udtf(returnType="easting: long, northing: long")
class tiles:  # noqa: N801
    """Lower left corners of the grid cells of ``resolution`` metres that a box touches."""

    def eval(self, x1: float, y1: float, x2: float, y2: float, resolution: int):
        for i in range(int(x1 // resolution), int(x2 // resolution) + 1):
            for j in range(int(y1 // resolution), int(y2 // resolution) + 1):
                yield i * resolution, j * resolution


def lateral(df: DataFrame, function, columns: list[str], constants: dict[str, int]) -> DataFrame:
    """Every row of ``df`` with each row that the table function gives for it."""
    args = [F.col(c).outer() for c in columns] + [F.lit(v) for v in constants.values()]
    return df.lateralJoin(function(*args))
