"""Substring dedup by recompression.

Words get names, and each level gives a new name to every maximal run of one symbol and then to every pair (left, right)
whose symbols fall in the left and the right half of the alphabet. A name is a hash of what it stands for, so all tasks
name alike, and equal substrings get equal symbols in their interior. With each symbol goes its support, the words that
determine it; a symbol whose support lies inside a repeated window is there in every copy of it.

Every Spark round takes one level. Its tasks parse the texts to that level, and each window that is still in the running
picks the symbol of lowest rank in it; a shared table of the names so picked tells which are in several documents, and
only windows whose symbol is shared go on. At the last level, where supports outgrow the window, the window itself is
the symbol. The words of every repeat are then compared with those of its source. Should unlike windows have got one name,
only the windows of such names are judged again, by their words themselves.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelworks.llm import textops as T
from panelworks.llm.common import new_path, saved

WIDTH = 13
#: Levels before the window itself. Two: supports of the third are mostly longer than a window.
LEVELS = 2
#: Names that a task holds before it merges and sends them.
HELD = 1 << 21
#: Bits of a window's name. How many decides only how many windows are judged again by their words.
NAME_BITS = 64
#: Up to this many rows are sent to every task; beyond it both sides are shuffled, or names are sent a slice at a time.
SENT_ROWS = 200_000


class Symbols:
    """The symbols of a block after some rounds: name, words covered [start, end), support [left, right), document."""

    def __init__(self, words: np.ndarray, of: np.ndarray, edges: np.ndarray):
        n = len(words)
        self.name, self.of = words, of
        self.start, self.end = np.arange(n), np.arange(n) + 1
        self.left, self.right = self.start.copy(), self.end.copy()
        self.low, self.high = edges[:-1] - 1, edges[1:] + 1  # a support that reaches over the document's edge

    def _neighbours(self):
        """For each symbol the support on either side, and whether a neighbour of the same document is there."""
        n = len(self.name)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = self.of[1:] == self.of[:-1]
        after[:-1] = before[1:]
        left, right = self.low[self.of], self.high[self.of]
        left[1:] = np.where(before[1:], self.left[:-1], left[1:])
        right[:-1] = np.where(after[:-1], self.right[1:], right[:-1])
        return before, after, left, right

    def _merge(self, head: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Joins every symbol that isn't a head to the head before it; name, left, right: of the heads."""
        at = np.flatnonzero(head)
        if not len(at):
            return
        self.end = np.maximum.reduceat(self.end, at)
        self.name, self.left, self.right, self.start, self.of = name, left, right, self.start[at], self.of[at]

    def runs(self, seed: int) -> None:
        """Renames maximal runs. A symbol is known to be (no) run from both neighbours, so its support takes them in."""
        n = len(self.name)
        if not n:
            return
        before, _, left, right = self._neighbours()
        head = np.ones(n, bool)
        head[1:] = ~before[1:] | (self.name[1:] != self.name[:-1])
        at = np.flatnonzero(head)
        count = np.diff(np.append(at, n))
        last = at + count - 1
        name = np.where(count > 1, T.mix(self.name[at] + count.astype(T.U) * T.U(0x2545F4914F6CDD1D), seed), self.name[at])
        self._merge(head, name, np.minimum(left[at], self.left[at]), np.maximum(right[last], self.right[last]))

    def pairs(self, seed: int) -> None:
        """Renames pairs. A symbol of the left half looks only to the right, one of the right half only to the left."""
        n = len(self.name)
        if not n:
            return
        before, after, left, right = self._neighbours()
        opens = (T.mix(self.name, seed) >> T.U(63)) == 0
        joined = np.zeros(n, bool)
        joined[1:] = opens[:-1] & ~opens[1:] & before[1:]
        two = np.append(joined[1:], False)
        nxt = np.append(self.name[1:], T.U(0))
        name = np.where(two, T.mix(self.name * T.U(0x9E3779B97F4A7C15) + T.mix(nxt, seed + 1), seed + 2), self.name)
        own_left = np.where(opens, self.left, np.minimum(left, self.left))
        own_right = np.where(opens, np.maximum(right, self.right), self.right)
        head = ~joined
        at = np.flatnonzero(head)
        last = np.where(two[at], at + 1, at)
        # of a pair both parts are known: the union of their own supports
        l = np.where(two[at], self.left[at], own_left[at])
        r = np.where(two[at], np.maximum(self.right[at], self.right[np.minimum(last, n - 1)]), own_right[at])
        self._merge(head, name[at], l, r)
        del after


@dataclass
class Found:
    """The windows of a block and what each is found by: ``best`` is the chosen symbol, or -1 for the window itself."""

    places: np.ndarray
    window: np.ndarray
    best: np.ndarray
    left: np.ndarray
    key: np.ndarray

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, name) of every chosen symbol, once, and of the windows without one."""
        chosen = np.zeros(len(self.left), bool)
        chosen[self.best[self.best >= 0]] = True
        alone = self.best < 0
        return np.concatenate([self.left[chosen], self.places[alone]]), np.concatenate([self.key[chosen], T.mix(self.window[alone], 41)])

    def place_of_window(self) -> np.ndarray:
        if not len(self.left):
            return self.places
        return np.where(self.best >= 0, self.left[self.best], self.places)


def parsed(h: np.ndarray, b: T.Block, level: int, width: int = WIDTH, live: np.ndarray | None = None) -> Found:
    """Every window (or the ``live`` ones) with the symbol of lowest rank of this level whose support lies in it.

    A symbol's name is a hash of the words of its support. Choice and name follow from the window's words alone."""
    places, window = T.windows(h, b.edges, width)
    if live is not None:
        places, window = places[live], window[live]
    s = Symbols(h, b.of, b.edges)
    for k in range(level):
        s.runs(20 + 4 * k)
        s.pairs(21 + 4 * k)
    inside = (s.left >= b.edges[s.of]) & (s.right <= b.edges[s.of + 1]) & (s.right - s.left <= width) if len(s.name) else np.zeros(0, bool)
    left, right = s.left[inside], s.right[inside]
    if len(left) and ((left[1:] < left[:-1]) | ((left[1:] == left[:-1]) & (right[1:] < right[:-1]))).any():
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
    key = T.mix(T.slice_hashes(h, left, right), 50 + level)
    rank = T.mix(key, 40)
    best = np.full(len(places), -1, np.int64)
    lowest = np.full(len(places), np.iinfo(np.uint64).max, T.U)
    going = np.arange(len(places))
    j = np.searchsorted(left, places)
    while len(going):
        ok = j < len(left)
        ok[ok] = left[j[ok]] < places[going[ok]] + width
        going, j = going[ok], j[ok]
        take = (right[j] <= places[going] + width) & (rank[j] < lowest[going])
        at = going[take]
        lowest[at] = rank[j[take]]
        best[at] = j[take]
        j = j + 1
    return Found(places, window, best, left, key)


def _marked(shared: pa.Array, b: T.Block) -> np.ndarray:
    """For each word of a block whether a shared symbol was picked there. ``shared``: lists of places of each text."""
    out = np.zeros(len(b.starts) + 1, bool)
    for k in range(b.first, b.last):
        spots = np.asarray(shared[k].values, np.int64)
        out[b.edges[k - b.first] + spots[spots < b.edges[k - b.first + 1] - b.edges[k - b.first]]] = True
    return out


class Held:
    """Names of a task with (doc, row, place), merged whenever many wait.

    Of a name that several documents of a task have, the rows of all but the smallest document are known to be repeats:
    they go on under names of their own, so that they spread. Under the name itself only the smallest document's rows go
    on, and one of the largest document, so a name that every document has leaves few rows for each merge."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def merged(self) -> pa.RecordBatch:
        """(name, doc, row, place, src_row, src_place): src is set for what is known: where the smallest document has it."""
        name, doc, row, place = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((place, row, doc, name))
        name, doc, row, place = name[order], doc[order], row[order], place[order]
        new = np.append(True, name[1:] != name[:-1])
        at = np.flatnonzero(new)
        lead = np.repeat(at, np.diff(np.append(at, len(name))))
        last = np.repeat(np.append(at[1:], len(name)) - 1, np.diff(np.append(at, len(name))))
        index = np.arange(len(name))
        known = doc > doc[lead]
        under = np.flatnonzero(~known | (index == last))
        pick = np.concatenate([under, np.flatnonzero(known)])
        spread = np.arange(len(pick)) >= len(under)
        own = np.where(spread, T.mix(name[pick] + row[pick].astype(T.U) * T.U(31) + place[pick].astype(T.U), 3), name[pick])
        src = np.where(spread, lead[pick], -1)
        null = src < 0
        return pa.RecordBatch.from_arrays([pa.array(T.as_long(own)), pa.array(doc[pick]), pa.array(row[pick]), pa.array(place[pick].astype(np.int32)),
                                           pa.array(row[np.maximum(src, 0)], mask=null), pa.array(place[np.maximum(src, 0)].astype(np.int32), mask=null)], names=["name", "doc", "row", "place", "src_row", "src_place"])


NAMES = "name long, doc long, row long, place int, src_row long, src_place int"


def window_names(window: np.ndarray, bits: int) -> np.ndarray:
    return T.mix(window, 60) & T.U((1 << bits) - 1)


def namer(level: int, bits: int = 64):
    """The map function of a round: (row, doc, text[, places shared in the round before]) to ``NAMES`` of this level.

    The last level's names are those of windows."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            row, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for b in T.blocks(batch.column(2)):
                h, live = b.word_hashes(), None
                if level > 1:
                    before = parsed(h, b, level - 1)
                    live = _marked(batch.column(3), b)[before.place_of_window()]
                if level > LEVELS:
                    place, key = before.places[live], window_names(before.window[live], bits)
                else:
                    place, key = parsed(h, b, level, live=live).names()
                if len(place):
                    of = b.first + b.of[place]
                    held.add(key, doc[of], row[of], place - b.edges[b.of[place]])
                if held.size > HELD:
                    yield held.merged()
        if held.size:
            yield held.merged()

    return name


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, whole, [(start, words)]) to the result rows. ``whole``: the text is a copy of a smaller document's."""
    for batch in batches:
        whole, repeats = batch.column(2).to_pylist(), batch.column(3)
        n_words, n_removed, digests, spans = [], [], [], []
        for b in T.blocks(batch.column(1)):
            gone = np.zeros(len(b.starts) + 1, np.int64)
            for k in range(b.first, b.last):
                a, z = b.edges[k - b.first], b.edges[k - b.first + 1]
                if whole[k] and z - a >= WIDTH:
                    gone[a] += 1
                    gone[z] -= 1
                elif repeats[k].is_valid:
                    start, words = (np.asarray(repeats[k].values.field(i), np.int64) for i in range(2))
                    np.add.at(gone, a + start, 1)
                    np.add.at(gone, a + start + words, -1)
            gone = np.cumsum(gone[:-1]) > 0
            text = b.data.tobytes()
            for k in range(b.first, b.last):
                a, z = b.edges[k - b.first], b.edges[k - b.first + 1]
                out = gone[a:z]
                n_words.append(int(z - a))
                n_removed.append(int(out.sum()))
                stay = np.flatnonzero(~out) + a
                digests.append(hashlib.sha256(b" ".join([text[s:e] for s, e in zip(b.starts[stay].tolist(), b.ends[stay].tolist())])).hexdigest())
                flips = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(flips[::2], flips[1::2])])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()),
                                          pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])


SPANS = "row long, start int, words int, src_row long, src_start int"


def joined_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, [(place, src_row, src_place)]) to spans: consecutive windows whose sources are consecutive too are one.

    A window may come as known and under its name; one source is enough."""
    for batch in batches:
        lists = batch.column(1)
        if not batch.num_rows:
            continue
        of = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
        place, src, at = (lists.flatten().field(k).to_numpy() for k in range(3))
        order = np.lexsort((at, src, place, of))
        of, place, src, at = of[order], place[order].astype(np.int64), src[order], at[order].astype(np.int64)
        one = np.ones(len(of), bool)
        one[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1])
        of, place, src, at = of[one], place[one], src[one], at[one]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1) | (src[1:] != src[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(of)))
        yield pa.RecordBatch.from_arrays([pa.array(of[first]), pa.array(place[first].astype(np.int32)), pa.array((n + WIDTH - 1).astype(np.int32)), pa.array(src[first]), pa.array(at[first].astype(np.int32))], names=["row", "start", "words", "src_row", "src_start"])


def read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, [(start, words)]) to (row, start, words, said): the words there, joined by one space."""
    for batch in batches:
        asked = batch.column(2)
        row = batch.column(0).to_numpy(zero_copy_only=False)
        for b in T.blocks(batch.column(1)):
            text, out = b.data.tobytes(), ([], [], [], [])
            for k in range(b.first, b.last):
                a = b.edges[k - b.first]
                for x in asked[k].as_py():
                    at = slice(a + x["start"], a + x["start"] + x["words"])
                    for column, value in zip(out, (row[k], x["start"], x["words"], b" ".join([text[s:e] for s, e in zip(b.starts[at].tolist(), b.ends[at].tolist())]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["row", "start", "words", "said"])


def dealt(rows: DataFrame) -> tuple[DataFrame, str]:
    """(``rows`` with a unique ``row``, the name of their table), written once in buckets by it: what later comes by row is brought to the texts, which stay."""
    spark = rows.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"panelworks_texts_{uuid.uuid4().hex[:12]}"
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    numbered.repartition(n, "row").write.bucketBy(n, "row").option("path", new_path(spark, "texts")).saveAsTable(name)
    return spark.table(name), name


def shared_places(names: DataFrame) -> DataFrame:
    """(row, places) of the names that several documents have."""
    by = Window.partitionBy("name")
    known = F.col("src_row").isNotNull()
    both = names.withColumns({"_lo": F.min("doc").over(by), "_hi": F.max("doc").over(by)}).where(known | (F.col("_lo") < F.col("_hi")))
    return saved(both.groupBy("row").agg(F.collect_set("place").alias("places")), "shared")


def repeated_spans(texts: DataFrame, bits: int) -> DataFrame:
    """``SPANS``: runs of windows that a document with a smaller doc has as well, each with a place where it has them."""
    rows = texts.select("row", "doc", "text")
    shared = shared_places(rows.mapInArrow(namer(1), NAMES))
    for level in range(2, LEVELS + 1):
        shared = shared_places(rows.join(shared.hint("shuffle_hash"), "row").select("row", "doc", "text", "places").mapInArrow(namer(level), NAMES))
    names = rows.join(shared.hint("shuffle_hash"), "row").select("row", "doc", "text", "places").mapInArrow(namer(LEVELS + 1, bits), NAMES)
    least = F.min(F.when(F.col("src_row").isNull(), F.struct("doc", "row", "place"))).over(Window.partitionBy("name"))
    known = F.col("src_row").isNotNull()
    names = names.withColumn("_lo", least).where(known | (F.col("_lo.doc") < F.col("doc")))
    found = F.struct("place", F.coalesce("src_row", "_lo.row").alias("src_row"), F.coalesce("src_place", "_lo.place").alias("src_place"))
    found = names.groupBy("row").agg(F.collect_list(found).alias("found"))
    return saved(found.mapInArrow(joined_windows, SPANS), "spans")


def compared(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, start, words, like): whether a span has the words of its source. Each side's words are read where the texts lie."""
    ask = spans.select("row", "start", "words").unionByName(spans.select(F.col("src_row").alias("row"), F.col("src_start").alias("start"), "words")).distinct()
    ask = ask.groupBy("row").agg(F.collect_list(F.struct("start", "words")).alias("asked"))
    said = texts.select("row", "text").join(ask.hint("shuffle_hash"), "row").select("row", "text", "asked").mapInArrow(read_words, "row long, start int, words int, said binary")
    said = saved(said, "words")
    own = spans.join(said.withColumnRenamed("said", "mine"), ["row", "start", "words"])
    theirs = said.select(F.col("row").alias("src_row"), F.col("start").alias("src_start"), "words", F.col("said").alias("theirs"))
    return saved(own.join(theirs, ["src_row", "src_start", "words"]).select("row", "start", "words", (F.col("mine") == F.col("theirs")).alias("like")), "compared")


def names_in(bits: int):
    """The map function (text, [(start, words)]) to the names of the windows in these spans."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1)
            for b in T.blocks(batch.column(0)):
                h = b.word_hashes()
                for k in range(b.first, b.last):
                    start, n = (np.asarray(asked[k].values.field(i), np.int64) for i in range(2))
                    n = n - WIDTH + 1
                    place = np.repeat(b.edges[k - b.first] + start - np.cumsum(n) + n, n) + np.arange(n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(T.as_long(np.unique(window_names(T.slice_hashes(h, place, place + WIDTH), bits))))], names=["name"])

    return name


def spoken(names: np.ndarray, bits: int):
    """The map function (row, doc, text) to (said, doc, row, start): the words of all windows that have one of ``names`` (sorted)."""

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for b in T.blocks(batch.column(2)):
                place, window = T.windows(b.word_hashes(), b.edges, WIDTH)
                key = T.as_long(window_names(window, bits))
                place = place[names[np.minimum(np.searchsorted(names, key), len(names) - 1)] == key]
                for at in (place[i:i + 4096] for i in range(0, len(place), 4096)):
                    text, of = b.data, b.of[at]
                    said = [b" ".join([text[x:y].tobytes() for x, y in zip(b.starts[p:p + WIDTH].tolist(), b.ends[p:p + WIDTH].tolist())]) for p in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(said, pa.binary()), pa.array(doc[b.first + of]), pa.array(row[b.first + of]), pa.array((at - b.edges[of]).astype(np.int32))], names=["said", "doc", "row", "start"])

    return say


def spans_by_words(texts: DataFrame, wrong: DataFrame, bits: int) -> DataFrame:
    """(row, start, words) of the windows that share a name with one of the spans ``wrong`` and are repeats by their words.

    Every window of such a name takes part, so no source is missed. Names go to the tasks in slices of about ``SENT_ROWS``; with 64
    bits there are none of them below some billions of windows. A window's words are grouped with partial sums, however frequent it is."""
    asked = wrong.groupBy("row").agg(F.collect_list(F.struct("start", "words")).alias("asked"))
    names = saved(texts.select("row", "text").join(asked.hint("shuffle_hash"), "row").select("text", "asked").mapInArrow(names_in(bits), "name long").distinct(), "names")
    slices, out = -(-names.count() // SENT_ROWS), wrong.limit(0)
    for k in range(slices):
        own = names.where(F.pmod(F.xxhash64("name"), F.lit(slices)) == k).toArrow().column(0).to_numpy()
        if not len(own):
            continue
        said = saved(texts.select("row", "doc", "text").mapInArrow(spoken(np.sort(own), bits), "said binary, doc long, row long, start int"), "said")
        least = saved(said.groupBy("said").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"), "least")
        found = said.join(F.broadcast(least) if least.count() <= SENT_ROWS else least, "said").where("least < doc")
        out = out.unionByName(found.select("row", "start", F.lit(WIDTH).alias("words")))
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key (long), ``n_words``, ``n_removed``, ``kept_sha256`` of the words left, and
    ``spans`` (word ranges removed).

    A word goes if a window of 13 words over it also starts in a document with a smaller key. Texts of fewer
    than 13 words and null texts lose nothing. Rows of equal keys don't count as smaller than each other, and each is
    judged by its own text; a row with a null key loses nothing and takes nothing. Copies of whole texts (by 128 bits of
    hashes) are found first and are cut whole; all their windows are in the smallest of them. All other repeats are
    compared word by word. The result is a written table. Very long texts are parsed whole, 2 MB of texts at a time; other columns are ignored, so
    none can clash; an empty table gives an empty result."""
    own = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own, table = dealt(own.withColumns({"_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(1), "text")}))
    try:
        return saved(_cut_texts(own), "cut").withColumnRenamed("doc_id", key)
    finally:
        docs.sparkSession.sql(f"drop table if exists {table}")


def _cut_texts(own: DataFrame) -> DataFrame:
    """``RESULT`` for dealt texts (row, doc, text, _a, _b)."""
    narrow = own.where("doc is not null").select("row", "doc", "_a", "_b")
    copies = saved(narrow.groupBy("_a", "_b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"), "copies")
    whole = saved(narrow.join(F.broadcast(copies) if copies.count() <= SENT_ROWS else copies, ["_a", "_b"]).where("least < doc").select("row"), "whole")
    left = own.where("doc is not null").join(whole.hint("shuffle_hash"), "row", "left_anti")
    spans = compared(own, repeated_spans(left, NAME_BITS))
    good, wrong = (spans.where(x).select("row", "start", "words") for x in ("`like`", "not `like`"))
    if not wrong.isEmpty():
        good = good.unionByName(spans_by_words(left, wrong, NAME_BITS))
    cuts = good.groupBy("row").agg(F.collect_list(F.struct("start", "words")).alias("cuts"))
    joined = own.select("row", "doc", "text").join(whole.withColumn("whole", F.lit(True)).hint("shuffle_hash"), "row", "left").join(cuts.hint("shuffle_hash"), "row", "left")
    joined = joined.select(F.col("doc").alias("doc_id"), "text", F.coalesce("whole", F.lit(False)).alias("whole"), "cuts")
    return joined.mapInArrow(cut, RESULT)
