"""Shared pieces: work paths, word columns and seeded ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelworks.operators.network import components  # noqa: F401
from panelworks.session import saved, work_dir  # noqa: F401

SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/panelworks/{name}-{uuid.uuid4().hex[:12]}"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null or blank texts."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_CLASS))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(*cols: Column) -> Column:
    """A double in [0, 1) from a 64-bit hash: the upper 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def group_rank(df: DataFrame, group: Column, order: list[Column], salt: Column, out: str = "rank",
               slices: int = 1024, extra: DataFrame | None = None) -> DataFrame:
    """Gapless rank from 0 inside each group without gathering a group in one task.

    ``group`` is a non-null value, ``salt`` one in [0, 1). A group is cut into ``slices`` slices by the
    salt and ranked slice by slice: rows of the group in earlier slices + row number in the slice. The
    slice counts never outnumber the rows. ``extra`` (column ``_g`` and others, one row for each group)
    is joined to the counts, so that the rows themselves move once. ``out`` is added to the columns."""
    cut = df.withColumn("_g", group).withColumn("_slice", F.floor(salt * slices).cast("int"))
    counts = cut.groupBy("_g", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if extra is not None:
        starts = starts.join(extra, "_g", "left")
    numbered = cut.withColumn("_rn", F.row_number().over(Window.partitionBy("_g", "_slice").orderBy(*order)))
    ranked = numbered.join(starts, ["_g", "_slice"])
    return ranked.withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("long")).drop("_slice", "_rn", "_start", "_g")


def ordered_rank(df: DataFrame, order: Column, out: str) -> DataFrame:
    """Rank from 0 over the whole table, by range partitions: only one count for each partition is gathered."""
    parts = saved(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = parts.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return numbered.join(starts, "_part").withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("long")).drop("_part", "_rn", "_start")
