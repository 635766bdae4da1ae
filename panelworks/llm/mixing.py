"""Mixing sources to target weights: whole repeats plus an exact subset-sum fill of the rest.

A source of S words with a target of T takes every document floor(T / S) times and then some documents
once more, R = T - floor(T / S) * S words together. Which ones follows from how many documents the
source has of each exact length: an even share of each length first, and a bounded-knapsack dynamic
programme over lengths for what is left. Documents of one length are taken in a seeded order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import group_rank, ordered_rank, saved, unit_hash, words

MOST_TIMES = 3


def water_level(sources: DataFrame, share: float) -> float:
    """The level at which weight * level, stopped at MOST_TIMES * size, adds up to share * all sizes.

    Each round is one aggregation of the source table; a round only adds stopped sources."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level != before:
        before = level
        full = F.col("weight") * F.lit(level) > MOST_TIMES * F.col("source_size")
        row = sources.agg(F.sum(F.when(full, MOST_TIMES * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not row[1]:
            break
        level = max(level, (total * share - row[0]) / row[1])
    return level


def fill(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words add up to ``budget`` or as near below as can be.

    ``lengths`` are distinct and positive. First the even share of each length (rounded down), then long
    ones as long as a rest of ``room`` words stays, then a bounded knapsack over that rest: reachable sums
    are the bits of one integer, lengths are added from the shortest on until the rest is reached."""
    size = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= size:
        return list(counts)
    take = [c * budget // size for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    room = 4 * lengths[order[-1]]
    for i in reversed(order):
        if rest <= room:
            break
        more = min(counts[i] - take[i], (rest - room) // lengths[i])
        take[i] += more
        rest -= more * lengths[i]
    mask, sums, steps = (1 << (rest + 1)) - 1, 1, []
    for i in order:
        if sums >> rest & 1:
            break
        left, chunk = counts[i] - take[i], 1
        while left > 0 and lengths[i] <= rest:
            n = min(chunk, left)
            steps.append((sums, i, n))
            sums |= sums << (n * lengths[i]) & mask
            left, chunk = left - n, chunk * 2
    at = sums.bit_length() - 1
    for earlier, i, n in reversed(steps):
        if not earlier >> at & 1:
            take[i] += n
            at -= n * lengths[i]
    return take


def quotas(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fills one source: rows (source key, size, n, source_size, target) to (source key, size, times, once_more)."""
    for g in groups:
        size, target = int(g["source_size"].iloc[0]), float(g["target"].iloc[0])
        want = round(target)
        times = min(want // size, MOST_TIMES) if size else 0
        rest = want - times * size if times < MOST_TIMES else 0
        own = g[g["size"] > 0]
        take = dict(zip(own["size"], fill([int(x) for x in own["size"]], [int(x) for x in own["n"]], int(rest)), strict=True)) if size and len(own) else {}
        yield pd.DataFrame({"_s": g["_s"], "size": g["size"], "times": times, "once_more": [int(take.get(x, 0)) for x in g["size"]]})


def source_key(source: Column) -> Column:
    """A non-null string for any source, null included."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix(docs: DataFrame, keep: list[str] | None = None, text: str = "text", source: str = "source", key: str = "doc_id",
        weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, seed: int = 29) -> DataFrame:
    """Every row of ``docs`` as ``_row`` (struct of ``keep``), with ``size`` (words), ``source_size``, ``target``,
    ``copies`` (how often the mix takes the document) and ``taken`` (copies * size).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all words by
    weight; a target stops at 3 times its source's size and the excess is shared again by weight. Documents
    without words take none (copies 0). Repeated rows are drawn each on its own; an empty table stays empty.
    Reruns agree: the order of documents of one length is a hash of (seed, key), then the key and the text's hash."""
    keep = docs.columns if keep is None else keep
    body = F.col(text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), source_key(F.col(source)).alias("_s"), F.col(source).isNull().alias("_null"),
                       F.size(words(body)).cast("long").alias("size"), F.col(key).alias("_key"), F.xxhash64(body).alias("_text"))
    # the histogram has a row for each source and length: lengths are distinct, so at most sqrt(2 * words) of them in a source
    lengths = saved(rows.groupBy("_s", "_null", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = lengths.groupBy("_s", "_null").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    order = F.struct("_null", "_s")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = saved(ordered_rank(sources, order, "_at").withColumn("weight", F.element_at(turn, (F.col("_at") % len(weights) + 1).cast("int"))), "sources")
    level = water_level(sources, share)
    sources = sources.withColumn("target", F.least(F.col("weight") * F.lit(level), (MOST_TIMES * F.col("source_size")).cast("double")))
    known = lengths.join(sources.select("_s", "source_size", "target"), "_s")
    took = known.groupBy("_s").applyInPandas(_one_source, "_s string, size long, times long, once_more long")
    plan = known.join(took, ["_s", "size"]).select(F.concat_ws("\x01", F.col("size").cast("string"), "_s").alias("_g"), "source_size", "target", "times", "once_more")
    ranked = group_rank(rows, F.concat_ws("\x01", F.col("size").cast("string"), "_s"), [F.col("_key").asc_nulls_last(), F.col("_text")],
                        unit_hash(F.lit(seed), F.coalesce(F.col("_key").cast("string"), F.lit(""))), "_rank", extra=saved(plan, "plan"))
    copies = F.when(F.col("size") > 0, F.col("times") + (F.col("_rank") < F.col("once_more")).cast("long")).otherwise(F.lit(0).cast("long"))
    return (ranked.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
            .select("_row", "size", "source_size", "target", "copies", "taken"))


def _one_source(group: pd.DataFrame) -> pd.DataFrame:
    return next(quotas(iter([group])))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    taken = mix(docs).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
