"""SimHash near duplicates by the generalised pigeonhole principle.

The 64 bits are put into groups of bits that go together. Runs of groups are parts, and each part has a threshold of its own;
while the thresholds, each plus one, add up to one more than the distance, two fingerprints within the distance are within the
threshold of some part. A dynamic programme over the groups chooses parts and thresholds by the candidates that each would bring,
estimated from all fingerprints. Fingerprints that meet in a part are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm import textops as T
from panelworks.llm.common import components, saved

BITS, GROUP = 64, 8
DISTANCE = 3
#: A text is hashed in pieces of about so many bytes, cut at white space.
PIECE = 1 << 20
#: What a key that is dealt costs, in comparisons of two fingerprints.
KEY_COST = 100
#: Fingerprints of one block that meet in a task; larger blocks are cut into chunks that meet two by two.
CHUNK = 4096
#: Rows that a task compares at a time, whole blocks.
ROWS = 1 << 17


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end]
        at = end


def bits(values: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1, bit 0 first."""
    return np.unpackbits(np.ascontiguousarray(values).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 of the text's shingles, repeats included; A-Z count as a-z.

    A text with fewer words than a shingle is one shingle, its whole sequence; without words it is 0."""
    ones, n, left = np.zeros(BITS, np.int64), 0, []
    for piece in pieces(text.lower()):
        words = left + piece.split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(x), seed) for x in zip(*(words[k:] for k in range(shingle)), strict=False)]
        if hashes:
            ones += bits(np.array(hashes, np.uint64)).sum(0, dtype=np.int64)
            n += len(hashes)
        left = words[max(len(words) - shingle + 1, 0):]
    if not n and left:
        ones, n = bits(np.array([xxhash.xxh64_intdigest(b" ".join(left), seed)], np.uint64))[0].astype(np.int64), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp): every row's fingerprint as a long with the same bits; null texts have no words."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            for first, last, data, bounds in T.raw_blocks(b.column(1)):
                for k in range(first, last):
                    out[k] = fingerprint(data[bounds[k - first]:bounds[k - first + 1]].tobytes(), shingle, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(T.as_long(out))], names=["key", "fp"])

    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return own.mapInArrow(hashed, f"key {own.schema['key'].dataType.simpleString()}, fp long")


def totals(fps: DataFrame, count, n: int) -> np.ndarray:
    """The sum over all fingerprints of ``count(values)``, an array of n integers, added up in each task and then by place."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            total += count(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    got = fps.select("fp").mapInArrow(partial, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n, np.int64)
    out[got["place"].to_numpy()] = got["n"].to_numpy()
    return out


def together(values: np.ndarray) -> np.ndarray:
    """How often each two bits are both 1, and the number of fingerprints last."""
    x = bits(values).astype(np.float64)
    return np.append((x.T @ x).ravel(), len(values)).astype(np.int64)


def grouped_bits(both: np.ndarray, n: int, size: int = GROUP) -> list[list[int]]:
    """Groups of ``size`` bits: each starts with the bit that goes most with those left and takes the one most correlated with it, again and again."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(p * (1 - p))
    scale = np.outer(spread, spread)
    phi = np.abs(np.divide(both / max(n, 1) - np.outer(p, p), scale, out=np.zeros((BITS, BITS)), where=scale > 0))
    np.fill_diagonal(phi, 0)
    left, groups = list(range(BITS)), []
    while left:
        group = [max(left, key=lambda b: (phi[b, left].sum(), -b))]
        left.remove(group[0])
        while left and len(group) < size:
            group.append(max(left, key=lambda b: (phi[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(group)
    return groups


def distances(groups: list[list[int]], values: np.ndarray, n: int) -> list[np.ndarray]:
    """For each group the share of pairs of fingerprints at each distance in it, from the counts of its values."""
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    out = []
    for k in range(len(groups)):
        h = values[256 * k:256 * (k + 1)] / max(n, 1)
        out.append(np.bincount(apart.ravel(), np.outer(h, h).ravel(), minlength=GROUP + 1))
    return out


def allotted(groups: list[list[int]], shares: list[np.ndarray], n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """[(bits, threshold)]: parts whose thresholds, each plus one, add up to ``distance`` + 1 at the least estimated cost.

    A part is a run of groups; pairs within its threshold are estimated as if its groups were independent, which is why bits that
    go together share a group. A part with a threshold t deals a key for each way to flip up to t of its bits. Parts of threshold
    -1 find nothing and are left out."""
    most = distance + 1
    best: list[dict[int, tuple[float, list]]] = [{0: (0.0, [])}] + [{} for _ in groups]
    for a in range(len(groups)):
        share = np.ones(1)
        for b in range(a, len(groups)):
            share = np.convolve(share, shares[b])
            own = [x for g in groups[a:b + 1] for x in g]
            keys, choices = 0.0, [(0, 0.0)]
            ways = 1.0
            for t in range(distance + 1):
                keys += ways
                ways = ways * (len(own) - t) / (t + 1)
                choices.append((t + 1, n * keys * KEY_COST + 0.5 * n * n * float(share[:t + 1].sum())))
            for e, (cost, parts) in best[a].items():
                for more, price in choices:
                    to = min(e + more, most)
                    found = (cost + price, parts + [(own, more - 1)] * (more > 0))
                    if to not in best[b + 1] or found[0] < best[b + 1][to][0]:
                        best[b + 1][to] = found
    return best[-1][most][1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(fp, part, key, own): the bits of each part, and every way to flip as many of them as its threshold allows (not own)."""
    def keys_of(k: int, own: list[int], t: int) -> Column:
        mask = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in own))))
        flips = [signed(sum(1 << b for b in x)) for m in range(1, t + 1) for x in combinations(own, m)]
        keys = F.array(F.struct(F.lit(k).alias("part"), mask.alias("key"), F.lit(True).alias("own")))
        if not flips:
            return keys
        each = F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.struct(F.lit(k).alias("part"), mask.bitwiseXOR(x).alias("key"), F.lit(False).alias("own")))
        return F.concat(keys, each)

    arrays = [keys_of(k, own, t) for k, (own, t) in enumerate(parts)]
    return fps.select("fp", F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("k")).select("fp", "k.part", "k.key", "k.own")


def stars(fp: np.ndarray, own: np.ndarray, side: np.ndarray, left: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Where each row's tree begins, over the links inside blocks that stand one after another.

    ``left``: how many rows of its block follow each row. Row i is compared with row i + 1 of its block, then with i + 2, and
    so on, all blocks side by side; two rows are compared if one is its block's own (own rows stand first) and, where a block's rows have two sides,
    if their sides differ (0 has no side)."""
    root = np.arange(len(fp))
    at = np.flatnonzero(own)
    for d in range(1, int(left[at].max(initial=0)) + 1):
        at = at[left[at] >= d]
        other = at + d
        near = (np.bitwise_count(fp[at] ^ fp[other]) <= distance) & ((side[at] == 0) | (side[at] != side[other]))
        a, b = at[near], other[near]
        new = root[a] != root[b]
        if not new.any():
            continue
        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (again := root[root]).tobytes() != root.tobytes():
            root = again
    return root


def verifier(distance: int):
    """The map function over rows (part, key, chunks, side, own, fp), sorted with own rows first: links (a, b) that join what the true links join."""
    def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        kept: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            kept.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)])
            if sum(len(x[0]) for x in kept) < ROWS:
                continue
            rows = [np.concatenate(x) for x in zip(*kept, strict=True)]
            ends = np.flatnonzero(np.any([x[1:] != x[:-1] for x in rows[:3]], axis=0)) + 1
            cut = int(ends[-1]) if len(ends) else 0
            if cut:
                yield [x[:cut] for x in rows]
            kept = [[x[cut:] for x in rows]]
        if kept:
            yield [np.concatenate(x) for x in zip(*kept, strict=True)]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blocks(batches):
            part, key, chunks, side, own, fp = rows
            cut = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (chunks[1:] != chunks[:-1])) + 1
            ends = np.append(cut, len(fp))
            last = np.repeat(ends, np.diff(ends, prepend=0)) - 1
            root = stars(fp.view(np.uint64), own, side, last - np.arange(len(fp)), distance)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], names=["a", "b"])

    return verify


def links(fps: DataFrame, parts: list[tuple[list[int], int]], distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between distinct fingerprints that leave none of their components apart.

    Blocks of more than ``chunk`` rows are cut into chunks by a hash, and each two chunks meet in a task of their own."""
    keys = keyed(fps, parts)
    sizes = keys.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own")
    cut = sizes.select("part", "key", F.ceil(F.col("n") / chunk).cast("int").alias("_c"))
    rows = keys.join(cut, ["part", "key"]).withColumn("_at", F.pmod(F.xxhash64("fp"), F.col("_c")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda o: F.struct(
        (F.least(o, F.col("_at")).cast("long") * F.col("_c") + F.greatest(o, F.col("_at"))).alias("chunks"),
        F.when(o == F.col("_at"), 0).when(o < F.col("_at"), 1).otherwise(2).alias("side")))
    dealt = rows.select("part", "key", F.explode(meets).alias("m"), "own", "fp").select("part", "key", "m.chunks", "m.side", "own", "fp")
    dealt = dealt.repartition("part", "key", "chunks").sortWithinPartitions("part", "key", "chunks", F.desc("own"), "fp")
    return dealt.mapInArrow(verifier(distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, distance: int = DISTANCE) -> DataFrame:
    """Every row of ``docs``: key, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest key that links reach.

    Fingerprints link at ``distance`` or fewer differing bits. Null and blank texts have fingerprint 0 and are linked like any
    other; texts of any length are hashed whole. Null keys are never the smallest unless a component has no other (then the id is
    null). Rows that are repeated, or share a key, stay as they are. Other columns of the input are ignored, so none can clash. An
    empty table gives an empty result.

    Equal fingerprints are one vertex, so copies cost nothing beyond the count; only vertices are dealt, compared and joined."""
    rows = saved(fingerprints(docs, key, text, shingle, seed), "fingerprints")
    fps = saved(rows.groupBy("fp").agg(F.min("key").alias("first")), "vertices")
    seen = totals(fps, together, BITS * BITS + 1)
    n, groups = int(seen[-1]), grouped_bits(seen[:-1].reshape(BITS, BITS), int(seen[-1]))

    def group_values(values: np.ndarray) -> np.ndarray:
        x = np.packbits(bits(values)[:, np.concatenate(groups)], axis=1, bitorder="little")
        return np.concatenate([np.bincount(x[:, k], minlength=256) for k in range(len(groups))])

    parts = allotted(groups, distances(groups, totals(fps, group_values, 256 * len(groups)), n), n, distance)
    root = components(links(fps, parts, distance))
    of = saved(fps.join(root.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
