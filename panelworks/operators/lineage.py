"""Units that succeed each other under new codes, and codes matched by name inside an area."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelworks.functions.columns import norm_entity, numbered_twins
from panelworks.functions.text import similarity, similarity_bound
from panelworks.operators.aggregate import mutual_best
from panelworks.session import saved


#: Up to this many counts of grams are sent to every task, else they are shuffled.
SENT_GRAMS = 500_000
#: A key with more pairs of names than this is matched through the index, any other by a plain join.
DIRECT_PAIRS = 1 << 20
#: So many lost and registered names of an area meet in one block of ``closest``, and names of more letters are not bounded by their order.
BLOCK, BOUNDED = (1024, 16384), 512
#: Names from here on are close.
CLOSE = 0.8


def _grams(name: Column, size: int) -> Column:
    """Runs of ``size`` letters with the number of the occurrence, so that equal ones count as often as they come; "" if there is none."""
    n = F.length(name) - size + 1
    runs = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(name, i, F.lit(size)))).otherwise(F.array(F.lit("")))
    return F.transform(runs, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(runs, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def _sharing(names: DataFrame, keys: list[str], least: float, size: int) -> DataFrame:
    """(keys, _a, _b): names of side 0 and 1 that share one of their rarest grams, as many as leave room for too few common ones.

    The letters that two names of T letters match lie in at most 1 + (T - 2 * matched) runs, so a ratio of ``least`` needs
    T * (1.5 * least - 1) - 1 common pairs of letters, or T * least / 2 common letters, and a partner is never shorter than
    least / (2 - least) of a name. Both sides keep all but that many grams, less one, by one order: rarest first."""
    n = F.length("_s")
    total = n + F.ceil(n * (least / (2 - least)) - 1e-9)
    common = F.greatest(F.ceil((total * (1.5 * least - 1) - 1 if size == 2 else total * (least / 2)) - 1e-9), F.lit(1))
    grams = names.select(*keys, "_side", "_s", n.alias("_n"), _grams(F.col("_s"), size).alias("_g"), common.alias("_common"))
    grams = grams.select(*keys, "_side", "_s", "_n", (F.size("_g") - F.col("_common") + 1).alias("_keep"), F.explode("_g").alias("_g"))
    counts = saved(grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_count")), "grams")
    ranked = grams.join(F.broadcast(counts) if counts.count() <= SENT_GRAMS else counts, "_g")
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_side", "_s").orderBy("_count", "_g")))
    rare = saved(ranked.where("_rank <= _keep").select(*keys, "_side", "_g", "_s", "_n"), "rare")
    left, right = (rare.where(F.col("_side") == k).select(*keys, "_g", F.col("_s").alias(f"_{x}"), F.col("_n").alias(f"_n{x}")) for k, x in enumerate("ab"))
    near = 2 * F.least("_na", "_nb") >= least * (F.col("_na") + F.col("_nb")) - 1e-9
    return left.join(right, [*keys, "_g"]).where(near).select(*keys, "_a", "_b").distinct()


def candidates(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: float) -> DataFrame:
    """(keys, a, b): distinct pairs of names of one key, among them all whose ``similarity`` reaches ``least`` (above 0).

    Keys of few pairs are joined. For the others there is an inverted index: names meet under their rare pairs of letters, for lower thresholds and for short names under their rare letters,
    never all with all of a key; then all their pairs of letters are counted. A key with very many names spreads over its grams. Null keys and names meet nothing, empty names meet
    empty ones. Numbering the grams of a name takes the square of its length, which is meant for names, not for texts."""
    side = lambda df, c, k: df.select(*keys, F.col(c).alias("_s"), F.lit(k).alias("_side")).na.drop().distinct()
    names = saved(side(left, a, 0).unionByName(side(right, b, 1)), "names")
    own = lambda df, k, c: df.where(F.col("_side") == k).select(*keys, F.col("_s").alias(c))
    large = saved(names.groupBy(*keys).agg(F.count_if(F.col("_side") == 0).alias("_l"), F.count_if(F.col("_side") == 1).alias("_r")).where(F.col("_l") * F.col("_r") > DIRECT_PAIRS).select(*keys), "large")
    if large.isEmpty():
        return own(names, 0, a).join(own(names, 1, b), keys)
    rest = names.join(large, keys, "left_anti")
    direct, names = own(rest, 0, a).join(own(rest, 1, b), keys), names.join(large, keys, "left_semi")
    if least <= 0.75:
        pairs = _sharing(names, keys, least, 1)
    else:
        short = 0  # the longest name that may reach the threshold without a common pair of letters
        while (short + 1 + math.ceil((short + 1) * least / (2 - least) - 1e-9)) * (1.5 * least - 1) - 1 <= 1e-9:
            short += 1
        partner = math.floor(short * (2 - least) / least + 1e-9)
        pairs = _sharing(names.where(F.length("_s") > short), keys, least, 2).unionByName(_sharing(names.where(F.length("_s") <= partner), keys, least, 1)).distinct()
    if least > 2 / 3:
        common = F.size(F.array_intersect(_grams(F.col("_a"), 2), _grams(F.col("_b"), 2)))
        pairs = pairs.where(common >= (F.length("_a") + F.length("_b")) * (1.5 * least - 1) - 1 - 1e-9)
    return direct.unionByName(pairs.withColumnsRenamed({"_a": a, "_b": b}))


def scored(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: float) -> DataFrame:
    """(keys, a, b, name_sim): distinct pairs of names of one key with ``name_sim`` >= ``least``. What cannot reach it is dropped before Python sees it."""
    near = candidates(left, right, keys, a, b, least).where(similarity_bound(F.col(a), F.col(b)) >= least)
    near = near.repartition(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, a, b)  # few bytes, but much to do for each
    return near.withColumn("name_sim", similarity(a, b)).where(F.col("name_sim") >= least)


def lineage_links(units: DataFrame, place: list[str], least: float = 0.8) -> DataFrame:
    """(old_code, new_code, name_sim): a retired unit and the active one at the same place that took over.

    ``units``: (code, name, retired, grades, place columns). Mutual best by normalised name, no ties; not numbered siblings, and
    not two units whose grades are known and disjoint. A pair below ``least`` cannot be the best of a link, so it isn't scored."""
    known = units.where(F.expr(" and ".join(f"{p} is not null" for p in place)))
    known = known.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place)
    u = saved(known.withColumn("norm", norm_entity(F.col("name"))), "units")
    part = lambda retired, tag: u.where(F.col("retired") == retired).select(*place, *[F.col(c).alias(f"{tag}_{c}") for c in ("code", "name", "norm", "grades")])
    old, new = part(True, "old"), part(False, "new")
    pairs = saved(old.join(scored(old, new, place, "old_norm", "new_norm", least), [*place, "old_norm"]).join(new, [*place, "new_norm"]), "lineage")
    links = mutual_best(pairs, "old_code", "new_code", "name_sim")
    apart = F.coalesce(~F.arrays_overlap("old_grades", "new_grades") & (F.size("old_grades") >= 0), F.lit(False))
    return links.where(~numbered_twins(F.col("old_name"), F.col("new_name")) & ~apart).select("old_code", "new_code", "name_sim")


def _common(names: list[str], others: list[str]):
    """For each eight of ``names`` their numbers and a table of how many letters each has in common with each of ``others`` (in order), at most 64 at a time.

    One bit for each letter of a name says where a longest common run of letters in order ends; a letter of the other name moves it by an addition.
    ``others`` are sorted, and what several begin with is worked out once."""
    import numpy as np

    codes = np.zeros((len(others), max(map(len, others), default=0)), np.uint32)  # 0 stands after the end
    for row, name in zip(codes, others):
        row[: len(name)] = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    letters, codes = np.unique(codes, return_inverse=True)
    codes, place = codes.reshape(len(others), -1), {int(c): k for k, c in enumerate(letters) if c}
    changed = codes[1:] != codes[:-1]
    first = np.concatenate([[-1], np.where(changed.any(1), changed.argmax(1), codes.shape[1])]) if codes.shape[1] else np.zeros(len(others))
    levels, ids = [], np.zeros(len(others), np.int64)
    for j in range(codes.shape[1]):
        new = first <= j
        at = np.flatnonzero(new)
        levels.append((ids[at], codes[at, j]))
        ids = np.cumsum(new) - 1
    for begin in range(0, len(names), 8):
        part = names[begin : begin + 8]
        total = np.zeros((len(part), len(others)), np.int64)
        for cut in range(0, max(map(len, part)), 64):
            masks = np.zeros((len(part), len(letters)), np.uint64)
            for row, name in zip(masks, part):
                for p, c in enumerate(name[cut : cut + 64]):
                    if (k := place.get(ord(c) + 1)) is not None:
                        row[k] |= np.uint64(1 << p)
            bits = np.full((len(part), 1), np.uint64(0xFFFFFFFFFFFFFFFF))
            for parent, letter in levels:
                if len(parent) != bits.shape[1]:
                    bits = bits[:, parent]
                here = bits & masks[:, letter]
                bits = (bits + here) | (bits - here)
            total += np.bitwise_count(~bits)[:, ids]
        yield begin, total


def _best_of(names: list[str], others: list[str], least: float) -> list[tuple[str, str, float]]:
    """(name, other, ratio): for each name the others of the best ratio, and all from ``CLOSE`` on, if they reach ``least``.

    The letters that the ratio matches stand in one order in both names, so what both have in one order at most bounds it; pairs are compared
    from the highest bound down to the best ratio found."""
    from difflib import SequenceMatcher

    import numpy as np

    others = sorted(others)
    short = [x for x in others if len(x) <= BOUNDED]
    long = [x for x in others if len(x) > BOUNDED]
    others = short + long
    size = np.array([len(x) for x in others], np.int64)
    found = []

    def judge(name: str, common) -> None:
        total = len(name) + size
        bound = np.where(total > 0, 2.0 * np.minimum(common, np.minimum(size, len(name))) / np.maximum(total, 1), 1.0)
        near = np.flatnonzero(bound >= least)
        best, hits = least, []
        for k in near[np.argsort(-bound[near], kind="stable")]:
            if bound[k] < CLOSE and bound[k] < best - 1e-9:
                break
            ratio = SequenceMatcher(None, name, others[k]).ratio()
            if ratio >= least:
                best = max(best, ratio)
                hits.append((name, others[k], ratio))
        found.extend(h for h in hits if h[2] >= CLOSE or h[2] >= best - 1e-9)

    unbounded = np.full(len(long), BOUNDED * 1_000_000, np.int64)
    tame = [x for x in names if len(x) <= BOUNDED]
    if short:
        for begin, common in _common(tame, short):
            for name, row in zip(tame[begin : begin + len(common)], common):
                judge(name, np.concatenate([row, unbounded]))
    else:
        for name in tame:
            judge(name, unbounded)
    for name in names:
        if len(name) > BOUNDED:
            judge(name, np.full(len(others), len(name), np.int64))
    return found


def _closest(batches, area: str, least: float):
    """``_best_of`` for Arrow batches (area, _l: names, _r: names of the register)."""
    import pyarrow as pa

    for batch in batches:
        rows, left, right, ratio = [], [], [], []
        for k in range(batch.num_rows):
            for name, other, value in _best_of(batch.column("_l")[k].as_py(), batch.column("_r")[k].as_py(), least):
                rows.append(k)
                left.append(name)
                right.append(other)
                ratio.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(area).take(pa.array(rows, pa.int32())), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(ratio, pa.float64())], [area, "name", "_name", "name_sim"])


def closest(lost: DataFrame, register: DataFrame, area: str, least: float) -> DataFrame:
    """(area, name, _name, name_sim): for each name of ``lost`` (area, name) the best of ``register`` (area, _name) in each block of it, and all from ``CLOSE`` on.

    The names of an area are dealt into blocks and every block of one side meets every one of the other, so a large area spreads over tasks, and no pair of names is a row."""

    def blocks(df: DataFrame, name: str, most: int, tag: str) -> DataFrame:
        df = df.select(area, name).na.drop().distinct()
        n = df.groupBy(area).agg(F.ceil(F.count(F.lit(1)) / most).alias("_of"))
        return df.join(n, area).withColumn(f"_b{tag}", F.pmod(F.xxhash64(name), F.col("_of"))).groupBy(area, f"_b{tag}").agg(F.collect_list(name).alias(f"_{tag}"))

    both = blocks(lost, "name", BLOCK[0], "l").join(blocks(register, "_name", BLOCK[1], "r"), area)
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), area, "_bl", "_br").select(area, "_l", "_r")
    return both.mapInArrow(lambda batches: _closest(batches, area, least), both.select(area, F.lit("").alias("name"), F.lit("").alias("_name"), F.lit(0.0).alias("name_sim")).schema)


def best_matches(lost: DataFrame, register: DataFrame, area: str, least: float = 0.5) -> DataFrame:
    """(old, new, name_sim, tie, n_close): the best name of the same area for each lost code, whether another is as good, and
    how many reach 0.8. ``lost``: (old, name, area), ``register``: (new, name, area); names below ``least`` don't count.

    Each distinct name is matched once."""
    r = saved(register.groupBy(area, F.col("name").alias("_name")).agg(F.min("new").alias("_new"), F.count(F.lit(1)).alias("_n")), "register")
    pairs = saved(closest(lost, r, area, least), "matches").join(r, [area, "_name"])
    top = F.max("name_sim").over(Window.partitionBy(area, "name"))
    best, close = F.col("name_sim") >= F.col("_top") - 1e-9, F.col("name_sim") >= CLOSE
    found = pairs.withColumn("_top", top).groupBy(area, "name").agg(
        F.min(F.when(best, F.col("_new"))).alias("new"), F.max("name_sim").alias("name_sim"),
        (F.sum(F.when(best, F.col("_n"))) > 1).alias("tie"), F.coalesce(F.sum(F.when(close, F.col("_n"))), F.lit(0)).alias("n_close"))
    return lost.join(found, [area, "name"]).select("old", "new", "name_sim", "tie", "n_close")


def places(x: Column, y: Column) -> list[Column]:
    """Place columns to the metre."""
    return [F.round(x).cast("long").alias("px"), F.round(y).cast("long").alias("py")]
