"""Benchmark decontamination by spaced seeds.

A mask lays over consecutive words and ignores some of them; what it sees is hashed. Hashes of test items
and of documents are joined, so a passage is found although words in it were replaced. Around a hit the
document and the item are laid over each other and the agreeing words counted. The masks are chosen so that
every overlap that passes holds a hit of one of them (a test goes through all patterns). DataFrame and SQL
functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import saved, words

#: 1: the word counts, 0: it is ignored. Wherever at most 1 of 8 or 9, or 2 of 10 to 13 words differ, one of these sees equal words only.
MASKS = ("11111", "111011", "11010011")
SPAN = 8
#: Items of fewer words than this are found where all their words stand in a row.
SHORT = 8
#: Seeds (about 100 MB), and words of items, are sent to every task up to this many; beyond it both sides are shuffled.
SENT_ROWS, SENT_WORDS = 2_000_000, 4_000_000


def _words(text: Column) -> Column:
    return words(F.lower(text))


def _seed(hashes: str, at: Column, mask: str) -> Column:
    """The hash of what the mask sees at word ``at`` (from 0). The hashes are padded, so a place beyond the end has the value 0."""
    return F.xxhash64(F.lit(mask), *[F.get(F.col(hashes), at + j) for j, c in enumerate(mask) if c == "1"])


def _hashes(words_col: str) -> Column:
    """A long for each word, and zeros behind the last."""
    return F.concat(F.transform(F.col(words_col), lambda w: F.xxhash64(w)), F.array_repeat(F.lit(0).cast("long"), SPAN))


def index_of(items: DataFrame) -> tuple[DataFrame, list[str]]:
    """(seed, start, no, q) of numbered items (no, v), and the masks that occur. ``start``: the hash of a seed's first words."""
    n = F.size("v")
    rows = items.where(n > 0).select("no", n.alias("n"), _hashes("v").alias("h"))
    whole = F.array(*[F.struct(F.lit("1" * k).alias("mask"), F.lit(k).alias("span")) for k in range(1, SHORT)])
    spaced = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(len(m)).alias("span")) for m in MASKS])
    rows = rows.select("no", "n", "h", F.inline(F.when(F.col("n") < SHORT, F.slice(whole, F.col("n"), F.lit(1))).otherwise(spaced)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("span"))).alias("q"))
    seed = F.lit(None).cast("long")
    for m in dict.fromkeys([*MASKS, *["1" * k for k in range(1, SHORT)]]):
        seed = F.when(F.col("mask") == m, _seed("h", F.col("q"), m)).otherwise(seed)
    first, second = F.get("h", F.col("q")), F.get("h", F.col("q") + 1)
    index = saved(rows.select("mask", seed.alias("seed"), F.when(F.col("mask") == "1", F.xxhash64(first)).otherwise(F.xxhash64(first, second)).alias("start"), "no", "q").distinct(), "seeds")
    return index.drop("mask"), sorted(r["mask"] for r in index.select("mask").distinct().collect())


def seed_hits(texts: DataFrame, index: DataFrame, masks: list[str]) -> DataFrame:
    """(id, no, d): where a text (id, w) has a seed of an item; d is the word at which the item would begin."""
    at = F.col("at")
    rows = texts.where(F.size("w") > 0).select("id", F.size("w").alias("n"), _hashes("w").alias("h"))
    rows = rows.select("id", "n", "h", F.posexplode("h").alias("at", "first")).where("at < n")
    sent = index.count() <= SENT_ROWS
    if sent:
        # most words begin no seed: one look at the first two of them spares the masks
        starts = F.broadcast(index.select("start").distinct())
        two = F.xxhash64("first", F.get("h", at + 1))
        rows = rows.withColumn("start", F.explode(F.array(two, F.xxhash64("first"))) if "1" in masks else two).join(starts, "start", "left_semi")
    seeds = rows.select("id", "at", F.explode(F.array(*[_seed("h", at, m) for m in masks])).alias("seed")) if masks else rows.select("id", "at", F.lit(0).cast("long").alias("seed"))
    found = seeds.join(F.broadcast(index) if sent else index, "seed")
    return found.select("id", "no", (at - F.col("q")).alias("d")).distinct()


def best_window(agree: Column, length: int) -> Column:
    """The most agreeing words in any ``length`` consecutive places (all places, where there are fewer)."""
    n = F.size(agree)
    starts = F.sequence(F.lit(0), F.greatest(n - length, F.lit(0)))
    return F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice(agree, i + 1, length), F.lit(0), lambda a, x: a + x)))


def _found(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, length: int, share: float) -> DataFrame:
    """(_key, _a, _b, _item, _d, n_best, n_agree): the alignments that pass, of each text; _a and _b are hashes of it.

    The hits of a text are gathered first, so that it is read and split once; each hit goes on with as many
    words as its item has, whatever the length of the text."""
    body = F.col(text)
    d = docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("_a"), F.xxhash64(F.lit(1), body).alias("_b"), body.alias("_text"))
    b = items.select(F.col(item).alias("_item"), _words(F.col(text)).alias("v")).distinct()
    # items are told apart by a number of their own: an id may be null or stand for several texts
    b = saved(b.withColumn("no", F.monotonically_increasing_id()), "items")
    index, masks = index_of(b)
    hits = seed_hits(d.select(F.col("_a").alias("id"), _words(F.col("_text")).alias("w")), index, masks)
    b = b.select("no", "_item", "v", F.size("v").alias("_n"))
    size = b.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    send = F.broadcast if size <= SENT_WORDS else lambda x: x
    hits = hits.join(send(b.select("no", "_n")), "no").groupBy("id").agg(F.collect_list(F.struct("no", "d", "_n")).alias("hits"))
    hits = saved(hits, "hits")
    near = d.join(F.broadcast(hits) if hits.agg(F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()[0] <= SENT_ROWS else hits, F.col("_a") == F.col("id"))
    near = near.select("_key", "_a", "_b", "hits", _words(F.col("_text")).alias("_w"))
    first = lambda h: F.greatest(-h["d"], F.lit(0))
    part = lambda h: F.struct(h["no"].alias("no"), h["d"].alias("_d"), F.slice(F.col("_w"), h["d"] + first(h) + 1, F.greatest(h["_n"] - first(h), F.lit(0))).alias("_part"))
    near = near.select("_key", "_a", "_b", F.inline(F.transform("hits", part))).join(send(b), "no")
    skip = F.greatest(-F.col("_d"), F.lit(0))
    same = F.zip_with(F.slice("v", skip + 1, F.size("_part")), "_part", lambda x, y: (x == y).cast("int"))
    near = near.where(F.size("_part") > 0).select("_key", "_a", "_b", "_item", "_d", "_n", same.alias("_same"))
    near = near.select("_key", "_a", "_b", "_item", "_d", "_n", best_window(F.col("_same"), length).alias("n_best"), F.aggregate("_same", F.lit(0), lambda a, x: a + x).alias("n_agree"))
    need = F.when(F.col("_n") < SHORT, F.col("_n")).otherwise(F.ceil(F.least(F.lit(length), F.col("_n")) * F.lit(math.floor(share * 1000)) / 1000))
    return near.withColumn("_fails", F.when(F.col("n_best") >= need, 0).otherwise(1))


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
             length: int = 13, share: float = 0.8) -> DataFrame:
    """Pairs (key, item) where ``share`` of some ``length`` aligned words agree, case aside.

    Columns: key, item, ``doc_start`` (word of the document at which the item would begin; the best alignment,
    ties to the first), ``n_best`` (agreeing words in the best window) and ``n_agree`` (in the whole overlap).
    An item shorter than ``length`` must agree in the same share of its own words, one of fewer than 8 words in
    all of them. At the stated share and length nothing that passes is missed; the masks are made for these.
    Documents and items without words, or without a text, have no pairs, and an empty table on either side
    gives none. Texts that share an item, a null one too, are judged each and reported once, by the best
    alignment that passes. Equal keys are judged row by row and reported once; a null key is kept as such.
    A very long text is split once, and each of its hits carries as many words as the item has. Other columns
    are ignored, so none can clash."""
    near = _found(docs, items, key, text, item, length, share)
    # judged in the grouping, passing alignments first: a filter before it would be pushed down and split each text for each window
    order = F.struct("_fails", -F.col("n_best"), -F.col("n_agree"), F.col("_d"))
    best = near.groupBy("_key", "_item").agg(F.min_by(F.struct("_d", "_fails", "n_best", "n_agree"), order).alias("b"))
    return best.where("b._fails = 0").select(F.col("_key").alias(key), F.col("_item").alias(item), F.col("b._d").alias("doc_start"), "b.n_best", "b.n_agree")


def clean_rows(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of ``docs`` whose own text has no overlap with any item, with the columns of ``docs``.

    Rows are judged one by one, whatever their keys: null, repeated or none. Texts are told apart by 128 bits of
    hashes. Null texts stay; extra columns may have any names."""
    near = _found(docs.select(F.lit(0).alias("key"), F.col(text).alias("text")), items.select(F.col(item).alias("item"), F.col(text).alias("text")), "key", "text", "item", 13, 0.8)
    bad = saved(near.groupBy("_a", "_b").agg(F.min("_fails").alias("_fails")).where("_fails = 0").select("_a", "_b"), "leaks")
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"))
    return rows.join(F.broadcast(bad) if bad.count() <= SENT_ROWS else bad, ["_a", "_b"], "left_anti").select("_row.*")
