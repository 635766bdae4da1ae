"""Language identification by cross-parsing.

The suffix automaton of a language's labelled text accepts exactly the substrings of that text. A new text
is parsed into phrases, each the longest match in the automaton; the language whose text needs the fewest
phrases, normalised by the length of its sample, is the prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelworks.llm import textops as T

#: The bounded sample that a language is learnt from: rows, and bytes of all of them together.
SAMPLE_ROWS, SAMPLE_BYTES = 64, 32768
#: Texts are cut into pieces of this many bytes that step side by side; where a piece would have started in another state it is done again.
PIECE = 256
#: Rounds of redoing pieces side by side, before those still wrong are walked through one after another.
PASSES = 4
#: Bytes of one text that are parsed at a time.
SEGMENT = 1 << 22
ONE = np.int32(1)
#: What a parser reads: A-Z as a-z, and all ASCII other than letters as one symbol. Every other byte is a symbol of its own.
SYMBOL = T._LOWER.copy()
SYMBOL[[c for c in range(128) if not chr(c).isalpha()]] = 0x20


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of one string; state 0 is the start."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        now = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


@dataclass
class Parser:
    """The automaton of a language as a flat table.

    ``column``: the table's column of each byte; 0 for bytes that the sample lacks, which all act alike. ``table``: entry
    state * width + column is (next state * width) << 1 | whether a phrase ends here. Where the automaton has no transition,
    the phrase ends and the next one starts with this byte. The last column, ``over``, leaves the state as it is.
    ``size``: bytes of the sample."""

    column: np.ndarray
    table: np.ndarray
    over: int
    size: int


def parser(sample: bytes) -> Parser:
    symbols = SYMBOL[np.frombuffer(sample, np.uint8)]
    own = np.unique(symbols)
    column = np.zeros(256, np.int32)
    column[own] = np.arange(1, len(own) + 1)
    step, width = automaton(column[symbols].tolist()), len(own) + 2
    start = np.zeros(width, np.int32)
    for c, to in step[0].items():
        start[c] = to * width
    table = np.empty((len(step), width), np.int32)
    table[:] = start << 1 | ONE
    for s, moves in enumerate(step):
        for c, to in moves.items():
            table[s, c] = to * width << 1
    table[:, width - 1] = np.arange(len(step), dtype=np.int32) * width << 1
    return Parser(column[SYMBOL], table.ravel(), width - 1, len(sample))


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = 41, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[tuple[str, Parser]]:
    """[(language, parser)] from at most ``rows`` rows and ``size`` bytes of each language: the first rows by a seeded hash,
    each with an equal share of the bytes (what short rows leave goes to the others), from a hashed place in its text.

    Rows without a letter or a language are not used. Only the sample comes to the driver, so memory follows the number of languages."""
    labelled = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    chance = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    some = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), chance.alias("h"))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= rows)
    place = F.pmod("h", F.greatest(F.length("text") - size, F.lit(0)) + 1).cast("int") + 1
    got = some.select("lang", "r", F.substring("text", place, F.lit(size)).alias("text")).toPandas().sort_values(["lang", "r"])
    return [(k, parser(shared([x.encode() for x in g["text"]], size))) for k, g in got.groupby("lang")] if len(got) else []


def shared(texts: list[bytes], size: int) -> bytes:
    """The texts in one, ``size`` bytes at most: equal shares, and what short ones leave goes to the longer ones."""
    order, left, most = sorted(len(x) + 1 for x in texts), size, 0
    for k, n in enumerate(order):
        most = left // (len(order) - k)
        if n > most:
            break
        left, most = left - n, size
    return b"\n".join(x[:max(most - 1, 0)] for x in texts)[:size]


def run(state: np.ndarray, codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states, ends) after every step of lanes that start in ``state``; codes: (steps, lanes)."""
    states, ends = np.empty(codes.shape, np.int32), np.empty(codes.shape, bool)
    for t in range(len(codes)):
        got = table[state + codes[t]]
        ends[t] = got & ONE
        state = got >> ONE
        states[t] = state
    return states, ends


def ended(data: np.ndarray, bounds: np.ndarray, parsers: list[Parser], began_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) numbers of phrases that end in each text, and the states that are left; ``began_in``: the states at the start.

    All pieces of a block step through an automaton side by side, each as if a phrase began with it. A piece whose
    predecessor left another state steps again from that one until both ways meet, mostly after a phrase or two. Where
    they don't meet (a text of one repeated word, a table of numbers) what a piece leaves is new again and again; so after
    ``PASSES`` rounds the pieces still wrong are walked through in order, each once, and alike pieces that start alike are walked once."""
    n = np.diff(bounds)
    pieces = -(-n // PIECE)
    of = np.repeat(np.arange(len(n)), pieces)
    out, state_of = np.zeros((len(n), len(parsers)), np.int64), began_in.copy()
    if not len(of):
        return out, state_of
    number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    place = (bounds[of] + number * PIECE)[None, :] + np.arange(PIECE)[:, None]
    outside = place >= bounds[of + 1][None, :]
    raw = data[np.minimum(place, len(data) - 1)]
    del place
    for k, p in enumerate(parsers):
        codes = p.column[raw]
        codes[outside] = p.over
        began = np.where(number == 0, began_in[of, k], 0).astype(np.int32)
        states, ends = run(began, codes, p.table)
        for _ in range(PASSES):
            want = np.where(number > 0, np.concatenate([[0], states[-1, :-1]]), began).astype(np.int32)
            lanes = np.flatnonzero(want != began)
            if not len(lanes):
                break
            began[lanes] = state = want[lanes]
            for t in range(PIECE):
                got = p.table[state + codes[t, lanes]]
                state = got >> ONE
                ends[t, lanes] = got & ONE
                apart = state != states[t, lanes]
                states[t, lanes] = state
                lanes, state = lanes[apart], state[apart]
                if not len(lanes):
                    break
        count, last = ends.sum(0), states[-1].copy()
        want = np.where(number > 0, np.concatenate([[0], last[:-1]]), began)
        step, walked = memoryview(p.table), {}
        for i in np.flatnonzero(want != began).tolist():
            while i < len(of) and number[i] and last[i - 1] != began[i]:
                began[i] = state = int(last[i - 1])
                column = codes[:, i]
                key = state, column.tobytes()
                if key not in walked:
                    found = 0
                    for c in column.tolist():
                        got = step[state + c]
                        state = got >> 1
                        found += got & 1
                    walked[key] = state, found
                last[i], count[i] = walked[key]
                i += 1
        out[:, k] = np.bincount(of, count, minlength=len(n)).astype(np.int64)
        final = np.flatnonzero(number == np.repeat(pieces, pieces) - 1)
        state_of[of[final], k] = last[final]
    return out, state_of


def phrases(data: np.ndarray, bounds: np.ndarray, parsers: list[Parser]) -> np.ndarray:
    """(texts, languages) numbers of phrases of whole texts. A long text is parsed a segment at a time, each from the state that the one before it left."""
    n = np.diff(bounds)
    out = np.zeros((len(n), len(parsers)), np.int64)
    short = n.max(initial=0) <= SEGMENT
    for first, last in [(0, len(n))] if short else [(k, k + 1) for k in range(len(n))]:
        state = np.zeros((last - first, len(parsers)), np.int32)
        if last - first != 1:
            out[first:last] = ended(data, bounds[first:last + 1], parsers, state)[0]
            continue
        for at in range(int(bounds[first]), int(bounds[last]), SEGMENT):
            got, state = ended(data, np.array([at, min(at + SEGMENT, int(bounds[last]))]), parsers, state)
            out[first] += got[0]
    return out + (n > 0)[:, None]


def predictor(model):
    """The map function: (key, text, held_out, letter) to (key, held_out, lang_pred, score)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = model.value
        names = np.array([x[0] for x in languages] + ["und"], object)
        for batch in batches:
            if not batch.num_rows:
                continue
            letter = batch.column(3).to_numpy(zero_copy_only=False)
            best, score = np.full(batch.num_rows, len(languages)), np.zeros(batch.num_rows)
            for first, last, data, bounds in T.raw_blocks(batch.column(1), 1 << 20):
                if not languages:
                    break
                cost = phrases(data, bounds, [x[1] for x in languages]) * np.array([math.log2(x[1].size + 1) for x in languages])
                order = np.argsort(cost, axis=1, kind="stable")
                at = np.arange(last - first)
                one = cost[at, order[:, 0]]
                two = cost[at, order[:, 1]] if len(languages) > 1 else np.maximum(2 * one, 1)
                live = letter[first:last]
                best[first:last] = np.where(live, order[:, 0], len(languages))
                score[first:last] = np.where(live, 1 - one / np.maximum(two, 1e-9), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=["key", "held_out", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out: str = "crc32(cast(`{key}` as string)) % 4 = 2") -> DataFrame:
    """Every row of ``docs``: key, ``held_out``, ``lang_pred`` and ``score`` (0 to 1: how much fewer phrases than the next language).

    Learns from rows that are not held out and have a text and a language. A text that is null or has no letter
    is ``und`` with score 0, and so is any if nothing could be learnt. Ties go to the first language in order.
    Repeated rows are judged alike. Very long texts are parsed whole, in one pass of phrases; time follows the bytes, whatever they are. The key may have any
    type; other columns are ignored, so none can clash. An empty table gives an empty result."""
    held = F.coalesce(F.expr(held_out.format(key=key)), F.lit(False))
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), held.alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(fit(own.where("not held_out"), "key"))
    own = own.select("key", "text", "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return own.mapInArrow(predictor(model), f"key {own.schema['key'].dataType.simpleString()}, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)
