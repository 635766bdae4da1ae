"""Context-tree weighting over bytes.

A byte is eight binary decisions. Every decision has a tree of contexts, the 0 to DEPTH bytes before; each
node has the counts of both outcomes and a Krichevsky-Trofimov estimate, and weighs its own estimate
against its children's by how well either coded the training text. All n-grams of all training documents
are in the tree; none is dropped at any size.

The tree is a Spark table. Subtrees below the last ``SPLIT`` bytes of a context are weighed by tasks, each
a range of whole subtrees; what is above them is bounded by the alphabet. A text's n-grams are looked up
in a broadcast head of the most frequent ones, and all others by a join with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm import textops as T
from panelworks.llm.common import saved

DEPTH = 5
#: Ends a text and stands before its first byte; no UTF-8 text has it.
END = 0xFF
#: Subtrees are told apart by so many last bytes of the context; two, where the nodes above three are more than TOP_NODES (24 bytes each).
SPLIT, TOP_NODES = 3, 2_000_000
#: What is sent to every task as a shortcut: the most frequent n-grams and tokens (16 bytes each). All others are joined.
HEAD_GRAMS, HEAD_TOKENS = 1_000_000, 500_000
#: n-grams of whole subtrees that a task weighs at a time.
TASK_GRAMS = 1 << 19
#: Bytes of text that a task counts or scores at a time.
SCORE_BYTES = 1 << 20
END_TOKEN = int(T.as_long(T.mix(np.array([0xE0D], T.U), 99))[0])


def gram_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, of): for each byte of each text and its end, the DEPTH bytes before and itself packed in an integer, and its text."""
    docs = len(bounds) - 1
    n = np.diff(bounds)
    of = np.repeat(np.arange(docs), n)
    line = np.full(len(data) + DEPTH * (docs + 1), END, np.uint8)
    at = np.arange(len(data)) + DEPTH * (of + 1)
    line[at] = data
    wide = line.astype(np.int64)
    key = np.zeros(len(line) - DEPTH, np.int64)
    for j in range(DEPTH + 1):
        key |= wide[j:len(wide) - DEPTH + j] << (8 * (DEPTH - j))
    ends = bounds[1:] + DEPTH * (np.arange(docs) + 1) if docs else np.zeros(0, np.int64)
    return key[np.concatenate([at, ends]) - DEPTH], np.concatenate([of, np.arange(docs)])


def _counted(values: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each is there (or the sum of weights)."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weight is None:
        values = np.sort(values)
        at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        return values[at], np.diff(np.append(at, len(values)))
    order = np.argsort(values, kind="stable")
    values = values[order]
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[at], np.add.reduceat(weight[order], at)


class Tally:
    """Counts of keys that are added block by block and merged whenever as many wait as are counted, so memory follows the distinct keys."""

    def __init__(self) -> None:
        self.key, self.n, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(_counted(values))
        self.size += len(self.waiting[-1][0])
        if self.size > max(len(self.key), 1 << 19):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            parts = [(self.key, self.n), *self.waiting]
            self.waiting, self.size = [], 0
            self.key, self.n = _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return self.key, self.n


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) of training documents to (kind, key, n): 0 lower-cased words and ends, 1 byte n-grams, summed over a batch."""
    for batch in batches:
        words, grams = Tally(), Tally()
        for b in T.blocks(batch.column(0), lower=True, block_bytes=SCORE_BYTES):
            words.add(T.as_long(b.word_hashes()))
            words.add(np.full(b.last - b.first, END_TOKEN))
        for _, _, data, bounds in T.raw_blocks(batch.column(0), SCORE_BYTES):
            grams.add(gram_keys(data, bounds)[0])
        for kind, tally in ((0, words), (1, grams)):
            key, n = tally.merge()
            for at in range(0, len(key), 1 << 18):
                k = key[at:at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at:at + (1 << 18)].astype(np.int64))], names=["kind", "key", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0 by Stirling's series after eight steps up."""
    up = np.zeros_like(x)
    for k in range(8):
        up += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - up


def _ln_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


Level = tuple[np.ndarray, np.ndarray, np.ndarray]
#: For each depth: sorted nodes (context << 8 | bits so far with a leading 1), the chance of a 1 where the node is the deepest one, and what its parents and itself have spent and pass on.
Layer = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def level(keys: np.ndarray, n: np.ndarray) -> Level:
    """The nodes of one depth, sorted, and their counts of zeros and ones. ``keys``: d bytes before and one byte."""
    symbol, context = keys & 0xFF, keys >> 8
    nodes, totals, ones, ups = [], [], [], []
    for bit in range(8):
        node, one = (context << 8) | (1 << bit) | (symbol >> (8 - bit)), (symbol >> (7 - bit)) & 1 == 1
        for parts, sums, w in ((nodes, totals, slice(None)), (ones, ups, one)):
            k, c = _counted(node[w], n[w])
            parts.append(k)
            sums.append(c)
    node, total = np.concatenate(nodes), np.concatenate(totals)
    order = np.argsort(node)
    node, total, n1 = node[order], total[order].astype(float), np.zeros(len(node))
    if len(node):
        n1[np.searchsorted(node, np.concatenate(ones))] = np.concatenate(ups)
    return node, total - n1, n1


def up_one(node: np.ndarray, depth: int) -> np.ndarray:
    """The node one byte of context above, for nodes with ``depth`` bytes of it."""
    return ((node >> 8 & ((1 << 8 * (depth - 1)) - 1)) << 8) | (node & 0xFF)


def mixed(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the node's own estimate, ln Pw) from ln KT and the sum of the children's ln Pw."""
    return 1 / (1 + np.exp(np.clip(children - own, -700, 700))), np.logaddexp(own, children) - np.log(2)


def weigh(levels: list[Level], depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """From the leaves up over ``levels`` (the first has ``depth`` bytes of context, the last DEPTH): weights, and ln Pw of the first."""
    node, n0, n1 = levels[-1]
    weights, coded = [np.ones(len(node))], _ln_kt(n0, n1)
    for d in range(len(levels) - 2, -1, -1):
        parent = np.searchsorted(levels[d][0], up_one(levels[d + 1][0], d + 1 + depth))
        children = np.bincount(parent, coded, minlength=len(levels[d][0]))
        w, coded = mixed(_ln_kt(*levels[d][1:]), children)
        weights.insert(0, w)
    return weights, coded


def descend(levels: list[Level], weights: list[np.ndarray], depth: int, above: Layer | None) -> list[Layer]:
    """From the top down: what each node adds to the mixture. ``above``: the layer over the first level; None at the root."""
    out = []
    for (node, n0, n1), w in zip(levels, weights, strict=True):
        kt = (n1 + 0.5) / (n0 + n1 + 1)
        if above is None:
            spent, left = np.zeros(len(node)), np.ones(len(node))
        else:
            at = np.searchsorted(above[0], up_one(node, depth))
            spent, left = above[2][at], above[3][at]
        above = (node, spent + left * kt, spent + left * w * kt, left * (1 - w))
        out.append(above)
        depth += 1
    return out


def tables(keys: np.ndarray, n: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The counts of full depth and of the ones above, down to ``depth`` bytes of context (that first)."""
    out = [_counted(keys, n)]
    for d in range(DEPTH - 1, depth - 1, -1):
        k, c = out[0]
        out.insert(0, _counted(k & ((1 << 8 * (d + 1)) - 1), c))
    return out


def walk(layers: list[Layer], keys: np.ndarray) -> np.ndarray:
    """log10 P(last byte | bytes before): for each decision the deepest known node has the whole mixture; 1/2 where there is none."""
    symbol, total = keys & 0xFF, np.zeros(len(keys))
    deep = np.full(len(keys), DEPTH)
    for bit in range(8):
        prefix = (1 << bit) | (symbol >> (8 - bit))
        one, left = np.full(len(keys), 0.5), np.arange(len(keys))
        for d in range(DEPTH, -1, -1):
            now = left[deep[left] >= d]
            node, p = layers[d][:2]
            if len(now) and len(node):
                want = ((keys[now] >> 8 & ((1 << 8 * d) - 1)) << 8) | prefix[now]
                at = np.minimum(np.searchsorted(node, want), len(node) - 1)
                hit = node[at] == want
                one[now[hit]] = p[at[hit]]
                deep[now[hit]] = d
                left = np.setdiff1d(left, now[hit], assume_unique=True)
            if not len(left):
                break
        deep[left] = -1
        total += np.log10(np.where((symbol >> (7 - bit)) & 1 == 1, one, 1 - one))
    return total


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by their first one, cut at changes of it into runs of about ``rows`` rows."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if size >= rows and len(cols[0]):
            change = np.flatnonzero(cols[0] != held[-1][0][-1])
            at = int(change[0]) if len(change) else len(cols[0])
            held.append([c[:at] for c in cols])
            size += at
            if len(change):
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size, cols = [], 0, [c[at:] for c in cols]
            else:
                continue
        if len(cols[0]):
            held.append(cols)
            size += len(cols[0])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def up_task(split: int):
    """The map function from (group, key, n), sorted by group, to the subtrees' tops: (node, coded, n0, n1)."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, n in whole_groups(batches, TASK_GRAMS):
            levels = [level(*t) for t in tables(keys, n, split)]
            coded = weigh(levels, split)[1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (levels[0][0], coded, *levels[0][1:])], names=["node", "coded", "n0", "n1"])

    return up


def down_task(top, split: int, known: bool):
    """The map function from (group, key, n), sorted by group, to (key, n, log): log10 of the chance of the last byte.
    ``known``: of the rows with a count; else of those without."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = top.value
        for _, keys, n in whole_groups(batches, TASK_GRAMS):
            seen = n > 0
            levels = [level(*t) for t in tables(keys[seen], n[seen], split)]
            layers = upper + descend(levels, weigh(levels, split)[0], split, upper[-1])
            out = seen if known else ~seen
            order = np.argsort(keys[out])
            keys, n = keys[out][order], n[out][order]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(walk(layers, keys))], names=["key", "n", "log"])

    return down


def upper_layers(node: np.ndarray, children: np.ndarray, n0: np.ndarray, n1: np.ndarray, split: int) -> list[Layer]:
    """The layers of depths 0 to split - 1 from the nodes of depth split - 1 and the sums of their children's ln Pw."""
    levels: list[Level] = []
    weights: list[np.ndarray] = []
    for d in range(split - 1, -1, -1):
        order = np.argsort(node)
        node, children, n0, n1 = node[order], children[order], n0[order], n1[order]
        w, coded = mixed(_ln_kt(n0, n1), children)
        levels.insert(0, (node, n0, n1))
        weights.insert(0, w)
        if d:
            node, at = np.unique(up_one(node, d), return_inverse=True)
            children, n0, n1 = (np.bincount(at, x, minlength=len(node)) for x in (coded, n0, n1))
    return descend(levels, weights, 0, None)


@dataclass
class Fitted:
    """``tokens``: (key, n); ``grams``: (key, n) of full depth; ``top``: the layers above the subtrees; ``split``: their depth."""

    tokens: DataFrame
    grams: DataFrame
    top: list[Layer]
    split: int

    def logs(self, more: DataFrame | None = None) -> DataFrame:
        """(key, n, log) of all n-grams of the tree, or of ``more`` (key) ones that are not in it."""
        rows = self.grams if more is None else self.grams.unionByName(more.select("key", F.lit(0).cast("long").alias("n")))
        top = rows.sparkSession.sparkContext.broadcast(self.top)
        return _grouped(rows, self.split).mapInArrow(down_task(top, self.split, more is None), "key long, n long, log double")


def _grouped(grams: DataFrame, split: int) -> DataFrame:
    group = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * split) - 1))
    return grams.select(group.alias("group"), "key", "n").repartition("group").sortWithinPartitions("group")


def fit(train: DataFrame, text: str = "text") -> Fitted:
    """Tokens and the weighted tree of every training document."""
    counts = train.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, "kind int, key long, n long")
    counts = saved(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    grams = counts.where("kind = 1").select("key", "n")
    for split in (SPLIT, 2):
        tops = saved(_grouped(grams, split).mapInArrow(up_task(split), "node long, coded double, n0 double, n1 double"), "tops")
        mask = (1 << 8 * (split - 1)) - 1
        above = F.shiftleft(F.shiftright("node", 8).bitwiseAND(F.lit(mask)), 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(0xFF)))
        over = saved(tops.groupBy(above.alias("node")).agg(*[F.sum(c).alias(c) for c in ("coded", "n0", "n1")]), "top")
        if split == 2 or over.count() <= TOP_NODES:
            break
    got = over.toArrow()
    return Fitted(counts.where("kind = 0").select("key", "n"), grams, upper_layers(*[got[c].to_numpy() for c in ("node", "coded", "n0", "n1")], split), split)


def least_count(table: DataFrame, most: int) -> int:
    """A count that at most ``most`` rows of (..., n) reach, as small as can be told from a histogram of counts.

    Counts to 4096 are told apart, larger ones by sixteenths of a power of two, so a few thousand numbers
    come to the driver at any size."""
    fine = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int") - 192 + 4096
    steps = table.groupBy(F.when(F.col("n") < 4096, F.col("n").cast("int")).otherwise(fine).alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n")).collect()
    total, least = 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["rows"]
        if total > most:
            break
        least = r["n"]
    return least if least is not None else (1 << 62)


def _head(table: DataFrame, most: int, value: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the highest counts, at most ``most``: sorted keys and their values."""
    got = table.where(F.col("n") >= least_count(table, most)).select("key", value).toArrow()
    order = np.argsort(got["key"].to_numpy())
    return got["key"].to_numpy()[order], got[value].to_numpy()[order]


def _looked_up(keys: np.ndarray, of: np.ndarray, docs: int, head: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(key's text, its value) for what the head has, and for each text the rest as a list of (key, c)."""
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    which, distinct = np.cumsum(new) - 1, keys[new]
    at = np.minimum(np.searchsorted(head[0], distinct), max(len(head[0]) - 1, 0))
    known = head[0][at] == distinct if len(head[0]) else np.zeros(len(distinct), bool)
    value = np.where(known, head[1][at], 0) if len(head[0]) else np.zeros(len(distinct))
    hit = known[which]
    rest, owner = keys[~hit], of[~hit]
    order = np.lexsort((rest, owner))
    rest, owner = rest[order], owner[order]
    first = np.append(True, (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1])) if len(rest) else np.zeros(0, bool)
    n = np.diff(np.append(np.flatnonzero(first), len(rest)))
    cuts = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=docs))]).astype(np.int32)
    tail = pa.StructArray.from_arrays([pa.array(rest[first]), pa.array(n.astype(np.int64))], names=["key", "c"])
    return of[hit], value[which[hit]], pa.ListArray.from_arrays(pa.array(cuts), tail)


TAIL = "array<struct<key:bigint,c:bigint>>"
PARTS = f"held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, tokens {TAIL}, grams {TAIL}"


def scorer(heads, n_tokens: int, n_types: int):
    """The map function that scores a batch: (key, text, held_out) to the key and the columns of ``PARTS``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, grams = heads.value
        floor = n_tokens + 0.1 * (n_types + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            base, known, size, n_bytes, logs, tails = [], [], [], [], [], ([], [])
            for b in T.blocks(batch.column(1), lower=True, block_bytes=SCORE_BYTES):
                docs = b.last - b.first
                of, c, tail = _looked_up(np.concatenate([T.as_long(b.word_hashes()), np.full(docs, END_TOKEN)]), np.concatenate([b.of, np.arange(docs)]), docs, tokens)
                base.append(np.bincount(of, np.log10((c + 0.1) / floor), minlength=docs))
                known.append(np.bincount(of, minlength=docs))
                size.append(np.diff(b.edges) + 1)
                n_bytes.append(np.diff(b.bounds))
                tails[0].append(tail)
            for first, last, data, bounds in T.raw_blocks(batch.column(1), SCORE_BYTES):
                of, log, tail = _looked_up(*gram_keys(data, bounds), last - first, grams)
                logs.append(np.bincount(of, log, minlength=last - first))
                tails[1].append(tail)
            longs = [pa.array(np.concatenate(x).astype(np.int64)) for x in (n_bytes, size, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *longs, pa.array(np.concatenate(base).astype(float)), pa.array(np.concatenate(logs).astype(float)), *[pa.concat_arrays(x) for x in tails]],
                                             names=["key", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "score", "tokens", "grams"])

    return score


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: str = "crc32(cast(`{key}` as string)) % 10 = 0") -> DataFrame:
    """Every row of ``docs`` scored: key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``
    (log10 of the text's probability, its end included), ``n_bytes`` and ``bits_per_byte`` (code length by bytes and the end).

    The model learns from the rows that are not held out (a null key is not). Null texts are empty: only their
    end is scored. Repeated rows are learnt and scored as often as they come. Very long texts are worked on
    1 MB at a time. The key may have any type; other columns are ignored, so none can clash. An empty table
    gives an empty result, and where nothing could be learnt every decision costs one bit. Tokens and n-grams
    beyond the sent heads are looked up by a join, so the scores do not depend on the heads' size."""
    spark = docs.sparkSession
    held = F.coalesce(F.expr(held_out.format(key=key)), F.lit(False))
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held.alias("held_out"))
    model = fit(own.where("not held_out"))
    n_tokens, n_types = model.tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    logs = saved(model.logs(), "logs")
    heads = spark.sparkContext.broadcast((_head(model.tokens, HEAD_TOKENS, "n"), _head(logs, HEAD_GRAMS, "log")))
    parts = own.mapInArrow(scorer(heads, n_tokens, n_types), f"key {own.schema['key'].dataType.simpleString()}, {PARTS}")
    parts = saved(parts.withColumn("row", F.monotonically_increasing_id()), "scored")
    heads.destroy()
    none, c = F.lit(0.0), F.coalesce(F.col("n"), F.lit(0))
    tokens = parts.select("row", F.inline("tokens")).withColumnRenamed("c", "times").join(model.tokens, "key", "left")
    tokens = tokens.groupBy("row").agg(F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(n_tokens + 0.1 * (n_types + 1)))).alias("base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"), none.cast("double").alias("more"))
    grams = parts.select("row", F.inline("grams"))
    new = saved(model.logs(grams.select("key").distinct().join(logs, "key", "left_anti")), "new-logs")
    grams = grams.join(logs.select("key", "log").unionByName(new.select("key", "log")), "key").groupBy("row").agg(none.alias("base"), F.lit(0).cast("long").alias("known"), F.sum(F.col("c") * F.col("log")).alias("more"))
    tail = tokens.unionByName(grams).groupBy("row").agg(F.sum("base").alias("base"), F.sum("known").alias("known"), F.sum("more").alias("more"))
    out = parts.drop("tokens", "grams").join(tail, "row", "left")
    whole = F.col("score") + F.coalesce("more", none)
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
                      (F.col("base_score") + F.coalesce("base", none)).alias("base_score"), whole.alias("score"), "n_bytes", (-whole * F.log2(F.lit(10.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
