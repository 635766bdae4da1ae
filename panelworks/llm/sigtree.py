"""N-gram Jaccard join by signature trees.

A document is the set of its word shingles; two link when their Jaccard similarity reaches the
threshold. Equal sets are one vertex. Vertices that could link are brought together by partition
signatures (a pigeonhole argument, so nothing is missed), which gives forests of bounded trees: in each,
nodes hold OR-combined token bitmaps and size ranges, and a dual traversal drops node pairs whose largest
possible overlap is too small. What is left at the leaves is counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelworks.llm import textops as T
from panelworks.llm.common import components, saved

#: Defaults: words of a shingle, and the threshold as a ratio of integers, so that no rounding decides.
NUM, DEN = 90, 100
SHINGLE = 3
#: Up to this many rows are sent to every task, else both sides of the join are shuffled.
SENT_ROWS = 1_000_000
#: Words of a tree's tokens; larger groups are cut into such trees and joined tree by tree. A vertex counts as 1024 at least.
TREE_TOKENS = 1 << 22
LEAF = 128
#: With fewer tokens to a part than this, signatures tell little, and sets that can't link are put aside before.
WIDE = 8
FANOUT = 8
#: A part with so few tokens doesn't tell documents apart; two of them together do.
LOW = 2
#: Small parts are keys in pairs inside blocks of about so many parts, so the keys grow as the tokens do.
BLOCK = 16
#: How often tokens are dealt anew for a set with two empty parts in a block, before such a pair is a key.
DEALS = 3
#: Keys that a task holds before it links what shares one.
KEYS = 1 << 20


def size_classes(top: int, num: int = NUM, den: int = DEN) -> list[int]:
    """Upper ends of the size classes; sets of the first class link only with a set of the next one or with their equal.

    At 90/100 the first ends at 9. Each is a fifth wider than the one before, or more, so that no set links beyond the next class."""
    def wider(end: int) -> int:
        return max(end * 6 // 5, end * den // num) + 1

    ends = [-(-den // (den - num)) - 1]
    while ends[-1] < top:
        ends.append(wider(ends[-1]))
    return [*ends, wider(ends[-1])]


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, tokens, edges): the sorted distinct shingle hashes of each document of a block.

    A document with fewer words than a shingle is one token, its whole sequence; without words it is empty."""
    for b in T.blocks(texts, lower=True):
        h = b.word_hashes()
        at, grams = T.windows(h, b.edges, shingle)
        of = b.of[at]
        n = np.diff(b.edges)
        short = np.flatnonzero((n > 0) & (n < shingle))
        if len(short):
            grams = np.concatenate([grams, T.slice_hashes(h, b.edges[short], b.edges[short + 1])])
            of = np.concatenate([of, short])
        order = np.lexsort((grams, of))
        grams, of = grams[order], of[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
        grams, of = grams[new], of[new]
        yield b.first, b.last, grams, np.searchsorted(of, np.arange(b.last - b.first + 1))


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, T.U)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def vertices(tokens: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A hash of each set (64 bits; it stands for the set, so equal hashes are taken as equal sets)."""
    return T.mix(_sums(T.mix(tokens, 3), edges) + np.diff(edges).astype(T.U), 4)


def signatures(tokens: np.ndarray, edges: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) such that documents that link have a key in common.

    Sets of sizes up to u that link differ in d = 2u(1-t)/(1+t) tokens at most. Tokens are dealt by hash to
    d + 1 + m parts in m blocks, so in some block at least two parts are the same in both. A part of more than
    ``LOW`` tokens is a key; smaller ones are keys in pairs inside a block. Two empty parts tell nothing: a set
    that has them is dealt anew, and so is any that it could meet by them alone; they are a key in the last deal
    only. A set belongs to its own size class and to the next if it can link into it."""
    n = np.diff(edges)
    if not len(n) or not n.max():
        return np.zeros(0, np.int64), np.zeros(0, T.U)
    ends = np.array(size_classes(int(n.max()), num, den))
    own = np.searchsorted(ends, n)
    docs = np.arange(len(n))
    up = (n > 0) & (den * n >= num * (ends[own] + 1))
    member = np.concatenate([docs[(n > 0) & (own > 0)], docs[up]])
    level = np.concatenate([own[(n > 0) & (own > 0)], own[up] + 1])
    order = np.argsort(member, kind="stable")
    member, level = member[order], level[order]
    who, key = [np.zeros(0, np.int64)], [np.zeros(0, T.U)]
    for deal in range(DEALS):
        if not len(member):
            break
        more, keys, again = _dealt(tokens, edges, member, level, 2 * ends[level] * (den - num) // (den + num), deal)
        who.append(more)
        key.append(keys)
        member, level = member[again], level[again]
    return np.concatenate(who), np.concatenate(key)


def _dealt(tokens: np.ndarray, edges: np.ndarray, member: np.ndarray, level: np.ndarray, differ: np.ndarray, deal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key) of one deal, and which members have two empty parts in a block."""
    blocks = 1 + (differ + 1) // (BLOCK - 1)
    parts = differ + 1 + blocks
    base = np.concatenate([[0], np.cumsum(parts)])
    size = np.diff(edges)[member]
    which = np.repeat(np.arange(len(member)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edges[member], size)
    token = tokens[at]
    place = T.mix(token, 100 + deal) if deal else token
    part = base[which] + (((place >> T.U(32)) * parts[which].astype(T.U)) >> T.U(32)).astype(np.int64)
    held = np.bincount(part, minlength=base[-1])
    order = np.argsort(part, kind="stable") if deal else slice(None)
    sums = _sums(T.mix(token, 5)[order], np.concatenate([[0], np.cumsum(held)]))
    owner = np.repeat(np.arange(len(member)), parts)
    number = np.arange(base[-1]) - base[owner]
    sig = T.mix(sums + held.astype(T.U), 6) + T.mix(level[owner].astype(T.U) * T.U(1 << 32) + T.U(deal << 28) + number.astype(T.U), 7)
    low = held <= LOW
    who, key = [member[owner[~low]]], [T.mix(sig[~low], 8)]
    few = np.flatnonzero(low)
    block = (np.concatenate([[0], np.cumsum(blocks)])[owner] + number * blocks[owner] // parts[owner])[few]
    cuts = np.flatnonzero(np.diff(np.concatenate([[-1], block, [-1]])))
    count = np.diff(cuts)
    again = np.zeros(len(member), bool)
    for c in np.unique(count[count > 1]) if len(few) else []:
        a, b = np.triu_indices(c, 1)
        group = few[cuts[:-1][count == c][:, None] + np.arange(c)]
        one, two = group[:, a].ravel(), group[:, b].ravel()
        tell = held[one] + held[two] > 0
        again[owner[one[~tell]]] = True
        if deal == DEALS - 1:
            tell[:] = True
        who.append(member[owner[one[tell]]])
        key.append(T.mix(sig[one[tell]] + sig[two[tell]], 9))
    return np.concatenate(who), np.concatenate(key), again


ROWS = "key long, v long, w long, doc_id long, n long"


def emitter(shingle: int, num: int, den: int):
    """The map function from texts to signatures."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Three kinds of rows: (v, doc_id, n) of each document, with w null and n set; (key, v) of signatures; (v, w) edges.

        Vertices of a batch (or of ``KEYS`` keys) that share a key are linked here to the smallest of them, and only that one goes on
        under the key: a key that every document has leaves one row for each batch."""
        def met() -> Iterator[pa.RecordBatch]:
            key, v = T.as_long(np.concatenate(seen_key)), np.concatenate(seen_v)
            seen_key.clear()
            seen_v.clear()
            order = np.lexsort((v, key))
            key, v = key[order], v[order]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            other = ~head
            other[1:] &= v[1:] != v[:-1]
            lead = v[np.maximum.accumulate(np.where(head, np.arange(len(v)), 0))]
            pairs = np.unique(np.stack([lead[other], v[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
            none = pa.nulls(int(head.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key[head]), pa.array(v[head]), none, none, none], names=["key", "v", "w", "doc_id", "n"])
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(T.as_long(T.mix(pairs[:, 1].view(T.U)))), pa.array(pairs[:, 1]), pa.array(pairs[:, 0]), none, none], names=["key", "v", "w", "doc_id", "n"])

        seen_key: list[np.ndarray] = []
        seen_v: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0)
            for first, last, tokens, edges in shingle_sets(batch.column(1), shingle):
                v, n = vertices(tokens, edges), np.diff(edges)
                who, key = signatures(tokens, edges, num, den)
                seen_key.append(key)
                seen_v.append(T.as_long(v)[who])
                none = n == 0
                vs = pa.array(T.as_long(v), mask=none)
                yield pa.RecordBatch.from_arrays([pa.array(T.as_long(v)), vs, pa.nulls(len(n), pa.int64()), ids[first:last].cast(pa.int64()), pa.array(n.astype(np.int64))], names=["key", "v", "w", "doc_id", "n"])
                if sum(len(k) for k in seen_key) > KEYS:
                    yield from met()
            if seen_key:
                yield from met()

    return emit


def sampler(shingle: int, share: float | None):
    """The map function from (doc_id, text) to (token, v, n) of a share of each set's tokens, picked by hash; without
    a share to (doc_id, v, n)."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, tokens, edges in shingle_sets(batch.column(1), shingle):
                v, n = T.as_long(vertices(tokens, edges)), np.diff(edges)
                if share is None:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first:last].cast(pa.int64()), pa.array(v, mask=n == 0), pa.array(n.astype(np.int64))], names=["doc_id", "v", "n"])
                    continue
                some = (T.mix(tokens, 11) >> T.U(40)) < T.U(int(share * (1 << 24)))
                yield pa.RecordBatch.from_arrays([pa.array(T.as_long(tokens)[some]), pa.array(np.repeat(v, n)[some]), pa.array(np.repeat(n, n)[some].astype(np.int64))], names=["token", "v", "n"])

    return sampled


def lonely(own: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(v) of sets that can't link: more than 1 - t of their tokens are in no other set. Counted on twice as many
    tokens as that takes, so some are overlooked, but none is taken wrongly."""
    tokens = own.mapInArrow(sampler(shingle, min(1.0, 2 * (den - num) / den)), "token long, v long, n long")
    tokens = tokens.groupBy("token").agg(F.min("v").alias("v"), F.max("v").alias("other"), F.max("n").alias("n"))
    alone = tokens.where("v = other").groupBy("v").agg(F.count(F.lit(1)).alias("alone"), F.max("n").alias("n"))
    return alone.where(den * F.col("alone") > (den - num) * F.col("n")).select("v")


def tokeniser(shingle: int):
    """The map function from texts to their sets."""

    def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, v, comp, copies) to (comp, v, copies, n, tokens); rows whose text has another set than v are dropped."""
        for batch in batches:
            want = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, tokens, edges in shingle_sets(batch.column(0), shingle):
                right = np.flatnonzero(T.as_long(vertices(tokens, edges)) == want[first:last])
                part = batch.slice(first, last - first).take(pa.array(right))
                data = [tokens[edges[i]:edges[i + 1]].tobytes() for i in right]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), part.column(3), pa.array(np.diff(edges)[right].astype(np.int64)), T.binary(data)], names=["comp", "v", "copies", "n", "tokens"])

    return token_rows


class Tree:
    """A signature tree over sets in size order. Level 0 are leaves of ``leaf`` sets; a node has the OR of the
    token bitmaps below it, the size range, and the most tokens of a set that share a bit with another one."""

    def __init__(self, ids: np.ndarray, edges: np.ndarray, bits: int, leaf: int = LEAF):
        n = np.diff(edges)
        count = -(-len(n) // leaf)
        lead = np.arange(count) * leaf
        own = np.repeat(np.arange(len(n)) // leaf, n)
        places = (ids.astype(T.U) * T.U(0x9E3779B97F4A7C15) >> T.U(40)).astype(np.int64) % bits
        bitmap = np.zeros((count, bits), bool)
        bitmap[own, places] = True
        doc = np.repeat(np.arange(len(n)), n)
        alone = np.bincount(np.unique(doc * bits + places) // bits, minlength=len(n))
        extra = np.maximum.reduceat(n - alone, lead)
        self.levels = [(np.packbits(bitmap, axis=1), np.minimum.reduceat(n, lead), np.maximum.reduceat(n, lead), extra)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, ex = self.levels[-1]
            lead = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, lead, axis=0), np.minimum.reduceat(lo, lead), np.maximum.reduceat(hi, lead), np.maximum.reduceat(ex, lead)))


def leaf_pairs(one: Tree, two: Tree, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Dual traversal from the roots: pairs of leaves that may hold a linking pair. Either tree's node is opened
    at the higher level; a pair stays if the sizes can be near enough and enough bits are common."""
    a, b = len(one.levels) - 1, len(two.levels) - 1
    pairs = np.zeros((1, 2), np.int64)
    while True:
        (m1, lo1, hi1, x1), (m2, lo2, hi2, x2) = one.levels[a], two.levels[b]
        p, q = pairs[:, 0], pairs[:, 1]
        fits = den * np.minimum(hi1[p], hi2[q]) >= num * np.maximum(lo1[p], lo2[q])
        p, q = p[fits], q[fits]
        common = np.concatenate([np.bitwise_count(m1[p[i:i + 4096]] & m2[q[i:i + 4096]]).sum(1, dtype=np.int64) for i in range(0, len(p), 4096)]) if len(p) else np.zeros(0, np.int64)
        most = common + np.minimum(x1[p], x2[q])
        fits = (num + den) * most >= num * (lo1[p] + lo2[q])
        pairs = np.stack([p[fits], q[fits]], 1)
        if (a == 0 and b == 0) or not len(pairs):
            return pairs
        down1, down2 = a >= b and a > 0, b >= a and b > 0
        for side, go, levels, level in ((0, down1, one.levels, a), (1, down2, two.levels, b)):
            if go:
                grown = np.repeat(pairs, FANOUT, axis=0)
                grown[:, side] = grown[:, side] * FANOUT + np.tile(np.arange(FANOUT), len(pairs))
                pairs = grown[grown[:, side] < len(levels[level - 1][1])]
        a, b = a - down1, b - down2


def common_tokens(ids: np.ndarray, edges: np.ndarray, a: slice, b: slice) -> np.ndarray:
    """The exact number of common tokens of every document of range a with every one of b."""
    x, y = ids[edges[a.start]:edges[a.stop]], ids[edges[b.start]:edges[b.stop]]
    vocabulary = np.intersect1d(x, y)
    out = np.zeros((a.stop - a.start, b.stop - b.start), np.float32)
    for at in range(0, len(vocabulary), 8192):
        some = vocabulary[at:at + 8192]
        dense = []
        for part, r in ((x, a), (y, b)):
            m = np.zeros((r.stop - r.start, len(some)), np.float32)
            place = np.minimum(np.searchsorted(some, part), len(some) - 1)
            hit = some[place] == part
            m[np.repeat(np.arange(r.stop - r.start), np.diff(edges[r.start:r.stop + 1]))[hit], place[hit]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def link(tokens: list[np.ndarray], copies: np.ndarray, left: int | None = None, leaf: int = LEAF, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """(label, links) of sets in size order: the lowest index reachable, and how many documents each links with.

    ``left``: only pairs of one of the first ``left`` sets with one of the others (two trees), else all pairs."""
    n = np.array([len(x) for x in tokens])
    edges = np.concatenate([[0], np.cumsum(n)])
    _, ids = np.unique(np.concatenate(tokens), return_inverse=True)
    bits = 1 << int(np.clip(np.ceil(np.log2(4 * n.max() + 1)), 10, 16))
    label, links = np.arange(len(n)), np.zeros(len(n), np.int64)
    ranges = [(0, len(n))] if left is None else [(0, left), (left, len(n))]
    trees = [Tree(ids[edges[a]:edges[b]], edges[a:b + 1] - edges[a], bits, leaf) for a, b in ranges]
    for p, q in leaf_pairs(trees[0], trees[-1], num, den):
        if left is None and q < p:
            continue
        (s1, e1), (s2, e2) = ranges[0], ranges[-1]
        a = slice(s1 + p * leaf, min(s1 + (p + 1) * leaf, e1))
        b = slice(s2 + q * leaf, min(s2 + (q + 1) * leaf, e2))
        near = (num + den) * common_tokens(ids, edges, a, b) >= num * (n[a][:, None] + n[b][None, :])
        if left is None and p == q:
            near = np.triu(near, 1)
        if not near.any():
            continue
        links[a] += near @ copies[b]
        links[b] += near.T @ copies[a]
        i, j = np.nonzero(near)
        for x, y in np.unique(np.stack([label[a][i], label[b][j]], 1), axis=0):
            x, y = _root(label, x), _root(label, y)
            if x != y:
                label[label == max(x, y)] = min(x, y)
    return label, links


def _root(label: np.ndarray, x: int) -> int:
    while label[x] != x:
        x = label[x]
    return x


def grouper(leaf: int, num: int = NUM, den: int = DEN):
    """The map function that links each tree, or pair of trees."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (comp, one, two, n): links each group of rows and returns (v, root, links).

        A group is one tree (one = two) or two trees whose rows are told apart by ``chunk``; it holds at most two
        trees of ``TREE_TOKENS`` words, whatever the size of the candidate component."""
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            order = np.lexsort((t["v"].to_numpy(), t["n"].to_numpy(), t["chunk"].to_numpy()))
            t = t.take(pa.array(order))
            v = t["v"].to_numpy()
            first = np.ones(len(v), bool)
            first[1:] = v[1:] != v[:-1]
            t = t.filter(pa.array(first))
            v, chunk = t["v"].to_numpy(), t["chunk"].to_numpy()
            tokens = [np.frombuffer(x, T.U) for x in t["tokens"].to_pylist()]
            left = None if t["one"][0].as_py() == t["two"][0].as_py() else int((chunk == chunk[0]).sum())
            if len(v) < 2 or left == len(v):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["v", "root", "links"])
            label, links = link(tokens, t["copies"].to_numpy(), left, leaf, num, den)
            some = links > 0
            return pa.RecordBatch.from_arrays([pa.array(v[some]), pa.array(v[label[some]]), pa.array(links[some])], names=["v", "root", "links"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)] if len(keys) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if now is not None and tuple(keys[a]) != now:
                    yield done()
                    held = []
                now = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return grouped


def chunked(sets: DataFrame) -> DataFrame:
    """``sets`` (comp, v, n, ...) with ``chunk``: components of more than TREE_TOKENS are cut into chunks of about so many, in size order.

    Only counts for (component, size, slice) are put in order, and a slice holds about a quarter of a tree, so no
    component is sorted by one task."""
    cost = F.sum(F.greatest("n", F.lit(1024))).alias("cost")
    big = sets.groupBy("comp").agg(cost).where(F.col("cost") > TREE_TOKENS).select("comp")
    rows = sets.join(F.broadcast(big), "comp")  # each has 4 million tokens or more, so they are few
    parts = rows.groupBy("comp", "n").agg(cost).select("comp", "n", F.ceil(F.col("cost") / (TREE_TOKENS // 4)).cast("int").alias("parts"))
    rows = saved(rows.join(parts, ["comp", "n"]).withColumn("slice", F.pmod(F.xxhash64("v", F.lit(12)), F.col("parts")).cast("int")).drop("parts"), "large")
    before = Window.partitionBy("comp").orderBy("n", "slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("comp", "n", "slice").agg(cost).select("comp", "n", "slice", F.floor(F.coalesce(F.sum("cost").over(before), F.lit(0)) / TREE_TOKENS).cast("long").alias("chunk"))
    rows = rows.join(cells, ["comp", "n", "slice"]).drop("slice")
    return sets.join(F.broadcast(big), "comp", "left_anti").withColumn("chunk", F.lit(0).cast("long")).unionByName(rows)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """Links sets of word ``shingle``-grams whose Jaccard similarity is ``num`` / ``den`` or more (below 1).

    One row for each row of ``docs``: key, ``n_shingles``, ``component_id`` (the smallest key reachable by links,
    its own included) and ``n_links`` (rows it links with). Keys are longs. A text without words, or null, has an
    empty set: no links, its own component. Rows with equal sets, so also repeated rows, link. Rows with a null key
    take part; their component is the smallest key reachable, or null. Very long texts are one set like any other.
    Other columns are ignored, so none can clash. An empty table gives an empty result."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if num + den < WIDE * 2 * (den - num):
        every = saved(own.mapInArrow(sampler(shingle, None), "doc_id long, v long, n long"), "vertices")
        live = saved(every.where("v is not null").join(lonely(own, shingle, num, den), "v", "left_anti").select(F.col("doc_id").alias("_d")).distinct(), "live")
        some = own.join(F.broadcast(live) if live.count() <= SENT_ROWS else live, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
        rows = some.mapInArrow(emitter(shingle, num, den), ROWS).where("n is null")
        rows = rows.unionByName(every.select(F.coalesce("v", F.xxhash64("doc_id")).alias("key"), "v", F.lit(None).cast("long").alias("w"), "doc_id", "n"))
    else:
        rows = own.mapInArrow(emitter(shingle, num, den), ROWS)
    low = F.min(F.when(F.col("n").isNull() & F.col("w").isNull(), F.col("v"))).over(Window.partitionBy("key"))
    rows = rows.withColumn("low", low)
    w = F.when(F.col("n").isNull(), F.coalesce("w", "low"))
    table = saved(rows.select(w.alias("w"), "v", "doc_id", "n").where("n is not null or w <> v"), "signatures")
    all_docs = table.where("n is not null").select("doc_id", "v", "n")
    near = components(table.where("n is null").select("v", "w").distinct(), "v", "w").withColumnRenamed("root", "comp")
    sets = all_docs.where("v is not null").groupBy("v").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    sets = saved(sets, "sets")
    placed = saved(chunked(sets.join(near, "v")), "candidates")
    side = placed.select(F.col("doc_id").alias("_d"), "v", "comp", "copies")
    side = F.broadcast(side) if side.count() <= SENT_ROWS else side
    texts = own.join(side, F.col("doc_id").eqNullSafe(F.col("_d"))).select("text", "v", "comp", "copies")
    tokens = texts.mapInArrow(tokeniser(shingle), "comp long, v long, copies long, n long, tokens binary")
    chunks = placed.groupBy("comp", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    # chunks are in size order, so only those whose sizes can be near enough meet
    meet = chunks.select("comp", F.col("chunk").alias("one"), F.col("hi").alias("_hi")).join(chunks.select("comp", F.col("chunk").alias("two"), F.col("lo").alias("_lo")), "comp").where((F.col("one") <= F.col("two")) & (den * F.col("_hi") >= num * F.col("_lo")))
    meet = meet.select("comp", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("chunk")).where("one <> 0 or two <> 0")
    split = saved(placed.where("chunk > 0").select("comp").distinct().join(placed, "comp").join(meet, ["comp", "chunk"]).select("comp", "v", "chunk", "one", "two"), "split")
    split = F.broadcast(split) if split.count() <= SENT_ROWS else split
    alone = tokens.select("*", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"))
    first = placed.where("chunk > 0").select("comp", "v")
    alone = alone.join(F.broadcast(first) if first.count() <= SENT_ROWS else first, ["comp", "v"], "left_anti")
    tokens = alone.unionByName(tokens.join(split, ["comp", "v"])).select("comp", "one", "two", "v", "copies", "n", "chunk", "tokens")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trees = tokens.repartition(n_parts, "comp", "one", "two").sortWithinPartitions("comp", "one", "two")
    linked = saved(trees.mapInArrow(grouper(LEAF, num, den), "v long, root long, links long"), "links")
    roots = components(linked.select("v", "root"), "v", "root")
    degree = linked.groupBy("v").agg(F.sum("links").alias("links"))
    by_set = sets.join(roots, "v", "left").join(degree, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = by_set.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = saved(by_set.join(least, "root").select("v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    out = all_docs.where("v is not null").join(by_set, "v").unionByName(all_docs.where("v is null").select("doc_id", "v", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id", "n_links")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of each group of linked texts (as of ``jaccard_components``), with the columns of ``docs``.

    Rows are told apart by key and text (128 bits of hashes), so rows of one key with unlike texts are judged
    each. Of a group the row with the smallest key stays, of one key that with the smallest hash, of rows alike
    in both any one; null keys come last. Texts without words, null ones too, link with nothing and all stay.
    Extra columns may have any names. An empty table stays empty."""
    ids = [F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), F.col(text)).alias("_b")]
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), *ids)
    # copies of a text are one text from here on, so that they never meet in a tree
    texts = docs.select(F.col(key).alias("_key"), *ids, F.col(text).alias("text"))
    copied = saved(texts.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_least")).where("_n > 1").drop("_n"), "copied")
    copied = F.broadcast(copied) if copied.count() <= SENT_ROWS else copied
    one = texts.join(copied, ["_a", "_b"]).where(F.col("_key").eqNullSafe(F.col("_least"))).select("_a", "_b", "text").dropDuplicates(["_a", "_b"])
    distinct = saved(texts.join(copied, ["_a", "_b"], "left_anti").select("_a", "text").unionByName(one.select("_a", "text")), "distinct-texts")
    found = saved(jaccard_components(distinct, "_a", "text", shingle, num, den), "found")
    linked = found.where("n_links > 0").unionByName(found.where("n_links = 0 and n_shingles > 0").join(copied.select("_a"), "_a", "left_semi"))
    classes = saved(linked.select("_a", F.col("component_id").alias("_c")).distinct(), "classes")
    send = F.broadcast if classes.count() <= SENT_ROWS else lambda x: x
    own = F.struct(F.col("_key").isNull().alias("null"), F.col("_key").alias("key"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    linked = rows.drop("_row").join(send(classes), "_a").groupBy("_key", "_a", "_b", "_c").agg(F.count(F.lit(1)).alias("_n"))
    linked = saved(linked.join(linked.groupBy("_c").agg(F.min(own).alias("_first")), "_c").withColumn("_stays", own == F.col("_first")).select("_key", "_a", "_b", "_n", "_stays"), "linked")
    same = lambda side: (F.col("_key").eqNullSafe(side["k"])) & (F.col("_a") == side["a"]) & (F.col("_b") == side["b"])
    named = linked.select(F.col("_key").alias("k"), F.col("_a").alias("a"), F.col("_b").alias("b"), "_n", "_stays")
    moved = named.where("not _stays or _n > 1")
    left = rows.join(F.broadcast(moved) if moved.count() <= SENT_ROWS else moved, same(moved), "left_anti").select("_row.*")
    again = named.where("_stays and _n > 1")
    once = rows.join(F.broadcast(again) if again.count() <= SENT_ROWS else again, same(again), "left_semi").dropDuplicates(["_key", "_a", "_b"])
    return left.unionByName(once.select("_row.*")) if len(set(docs.columns)) == len(docs.columns) else left.union(once.select("_row.*"))
