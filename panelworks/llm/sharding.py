"""Weighted rendezvous hashing of stable record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import group_rank, unit_hash


def rendezvous(key: Column, weights: Sequence[float], seed: int = 17) -> Column:
    """The shard whose score is highest; score = -weight / ln(u), u a hash of (key, shard).

    Adding a shard moves only the records that it wins, removing one only those it held, and a
    shard's share follows its weight. Ties go to the lowest shard. A null key hashes like any other
    value, so all rows with a null key share a shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    named = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scores = [F.struct((F.lit(-float(w)) / F.ln(unit_hash(named, F.lit(seed), F.lit(s)) + F.lit(2.0**-54))).alias("score"),
                       F.lit(-s).alias("minus")) for s, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["minus"]).cast("int")


def shard(docs: DataFrame, n_shards: int = 16, weights: Sequence[float] | None = None, key: str = "doc_id",
          text: str = "text", seed: int = 17) -> DataFrame:
    """Every row of ``docs`` with its shard, its slot inside it and the shard it would get with one more.

    Columns: the key, ``size`` (UTF-8 bytes + 1; a null text has none, so 1), ``text_crc32`` (unsigned;
    of the empty text for null), ``law`` = 'key', ``shard``, ``slot`` (gapless from 0 in each shard),
    ``grown_shard`` (with ``n_shards + 1``). Repeated rows get slots of their own; an empty table gives
    an empty result. Other columns of the input are ignored. Slots are numbered slice by slice (see
    ``group_rank``), so no shard is sorted by one task and the text itself is never shuffled."""
    weights = list(weights or [1.0] * n_shards)
    if len(weights) != n_shards:
        raise ValueError("one weight per shard")
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"), rendezvous(F.col(key), weights, seed).alias("shard"),
        rendezvous(F.col(key), [*weights, 1.0], seed).alias("grown_shard"))
    slotted = group_rank(placed, F.col("shard"), [F.col(key).asc_nulls_last(), F.col("text_crc32"), F.col("size")],
                         unit_hash(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("text_crc32"), F.lit(seed + 1)), "slot")
    return slotted.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
