"""Small fixtures, brute force and round trips for the operators of the llm subpackage."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelworks.llm import common, ctw, decontam, langid, mixing, quality, recompress, sharding, sigtree, textops, urlfilter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def corpus(n=120, seed=3, words=60, vocabulary=40):
    """Rows with copies, near copies, runs, blanks, nulls, a repeated row and a very long text."""
    rnd = random.Random(seed)
    v = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(vocabulary)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.15:
            texts.append(rnd.choice(texts))
        elif texts and kind < 0.35:
            t = (rnd.choice(texts) or "x").split(" ")
            for _ in range(rnd.randint(0, 2)):
                t[rnd.randrange(len(t))] = rnd.choice(v)
            texts.append(" ".join(t))
        elif kind < 0.45:
            texts.append(" ".join([rnd.choice(v)] * rnd.randint(1, 40) + rnd.choices(v, k=rnd.randint(0, 20))))
        else:
            texts.append(" ".join(rnd.choices(v, k=rnd.randint(1, words))))
    texts += [None, "", "  \t\n", "A", "a b", "A B", "a\x0bb", " ".join(rnd.choices(v, k=5000)), "Über straße " * 30]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", None, "hot", "hot", "hot"]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- shared pieces


def test_words_and_hashes_match_the_regex(rows):
    texts = [r[1] for r in rows]
    for size in (50, 4 << 20):
        seen = {}
        for b in textops.blocks(pa.array(texts, pa.string()), block_bytes=size):
            h = b.word_hashes()
            for k in range(b.first, b.last):
                a, z = b.edges[k - b.first], b.edges[k - b.first + 1]
                got = [b.data[s:e].tobytes().decode() for s, e in zip(b.starts[a:z], b.ends[a:z])]
                assert got == WORD.findall(texts[k] or "")
                for w, x in zip(got, h[a:z]):
                    assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_words_column(spark, docs, rows):
    got = docs.select("doc_id", common.words(docs["text"]).alias("w")).collect()
    want = {r[0]: WORD.findall(r[1] or "") for r in rows}
    assert all(g["w"] == want[g["doc_id"]] for g in got)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)]
    label = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {r["v"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: c for v, c in label.items() if sum(x == c for x in label.values()) > 1}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 sharding


def test_sharding(spark, docs, rows):
    out = sharding.shard(docs, 16).collect()
    assert len(out) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    slots = defaultdict(list)
    for r in out:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        assert r["law"] == "key" and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = {r["doc_id"]: r["shard"] for r in sharding.shard(docs.repartition(2), 16).collect()}
    assert all(again[r["doc_id"]] == r["shard"] for r in out)


def test_sharding_moves_few_and_follows_weights(spark):
    many = spark.range(20000).selectExpr("id as doc_id", "'x' as text")
    out = sharding.shard(many, 10).collect()
    moved = sum(r["shard"] != r["grown_shard"] for r in out)
    assert abs(moved / 20000 - 1 / 11) < 0.02
    c = Counter(r["shard"] for r in sharding.shard(many, 3, [1, 1, 2]).collect())
    assert abs(c[2] / 20000 - 0.5) < 0.02
    assert sharding.shard(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, None, 1, 1), (None, "a", 2, 2), (7, "a", 3, 3), (7, "a", 3, 3)], "doc_id long, text string, shard int, slot int")
    assert sharding.shard(odd, 4).count() == 4


# --- 2 decontamination


def agreeing(doc, item, length=13, share=0.8):
    """The best passing overlap over all alignments; no masks."""
    d, v, best = WORD.findall((doc or "").lower()), WORD.findall((item or "").lower()), None
    need = len(v) if len(v) < 8 else math.ceil(min(length, len(v)) * share - 1e-9)
    for diag in range(-len(v) + 1, len(d)):
        lo, hi = max(0, -diag), min(len(v), len(d) - diag)
        same = [v[i] == d[diag + i] for i in range(lo, hi)]
        n = max(sum(same[i:i + length]) for i in range(max(1, len(same) - length + 1)))
        best = max(best or (0, 0, 0), (n, sum(same), -diag))
    return best if v and best and best[0] >= need else None


def test_masks_see_every_passing_pattern():
    from itertools import combinations

    for n in range(8, 14):
        most = n - math.ceil(n * 0.8 - 1e-9)
        for bad in combinations(range(n), most):
            assert any(all(s + j not in bad for j, c in enumerate(m) if c == "1") for m in decontam.MASKS for s in range(n - len(m) + 1)), (n, bad)


def test_decontamination_at_every_place_of_two_changes(spark):
    from itertools import combinations

    v = [f"w{i}" for i in range(13)]
    docs = [(k, " ".join("x" if j in bad else w for j, w in enumerate(v))) for k, bad in enumerate([*combinations(range(13), 2), *combinations(range(13), 3)])]
    docs.append((9999, " ".join(["the"] * 50_000 + v + ["end"] * 50_000)))
    table, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(v)), (2, "w3 W4"), (3, "end")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.overlaps(table, items).collect()}
    assert {d for d, i in got if i == 1} == {*range(78), 9999} and got[9999, 1]["doc_start"] == 50_000
    assert {d for d, i in got if i == 2} == {d for d, t in docs if "w3 w4" in t} and {d for d, i in got if i == 3} == {9999}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.overlaps(table, none).count() == 0 and decontam.clean_rows(table, none).count() == len(docs)


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    v = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(v, k=rnd.choice([2, 5, 9, 14, 30])))) for i in range(12)] + [(99, None), (98, "")]
    docs = []
    for i in range(150):
        words = rnd.choices(v, k=rnd.randint(0, 60))
        if i % 3 == 0:
            t = rnd.choice(items[:12])[1].split(" ")
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(v)
            words[len(words) // 2:len(words) // 2] = [x.upper() for x in t[rnd.randint(0, 2):]]
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (None, items[3][1] + " " + items[2][1])]
    want = {(d, i): r for d, t in docs for i, s in items if (r := agreeing(t, s))}
    assert any(d is None for d, _ in want) and len(want) > 8
    table, bench = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id"), spark.createDataFrame(items, "item_id long, text string")
    for sent in (decontam.SENT_ROWS, 0):
        monkeypatch.setattr(decontam, "SENT_ROWS", sent)
        got = {(r["doc_id"], r["item_id"]): (r["n_best"], r["n_agree"], -r["doc_start"]) for r in decontam.overlaps(table.select("doc_id", "text"), bench).collect()}
        assert got == want
    same_ids = spark.createDataFrame([(7, t) for _, t in docs] + [(7, t) for _, t in docs], "doc_id long, text string").selectExpr("*", "1 as _bad", "2 as _a", "3 as _row")
    kept = decontam.clean_rows(same_ids, bench)
    assert kept.columns == same_ids.columns
    assert Counter(r["text"] for r in kept.collect()) == Counter(2 * [t for d, t in docs if not any(agreeing(t, s) for _, s in items)])
    kept = {r["doc_id"] for r in decontam.clean_rows(table, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.overlaps(empty(spark), bench).count() == 0


def test_decontamination_of_null_and_repeated_items(spark):
    v = [f"w{i}" for i in range(60)]
    short, long, lost = v[:8], v[8:28], v[30:44]
    doc = short[:5] + ["x"] + short[6:] + ["a", "b", "c"] + long[:8] + ["y"] * 12
    docs = spark.createDataFrame([(1, " ".join(doc)), (2, " ".join(lost)), (3, "nothing of it " * 9)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(short)), (7, " ".join(long)), (None, " ".join(lost)), (None, " ".join(v[44:58]))], "item_id long, text string")
    assert agreeing(" ".join(doc), " ".join(short))[0] == 7 and agreeing(" ".join(doc), " ".join(long)) is None
    got = sorted(((r["doc_id"], r["item_id"], r["n_best"]) for r in decontam.overlaps(docs, items).collect()))
    assert got == [(1, 7, 7), (2, None, 13)]
    assert [r["doc_id"] for r in decontam.clean_rows(docs, items).collect()] == [3]


# --- 3 language model


class BruteTree:
    """The weighted tree by its recursive definition, over dictionaries."""

    def __init__(self, texts):
        self.counts, self.below, self.memo = {}, defaultdict(set), {}
        for t in texts:
            line = b"\xff" * ctw.DEPTH + t + b"\xff"
            for at in range(ctw.DEPTH, len(line)):
                for d in range(ctw.DEPTH + 1):
                    for bit in range(8):
                        prefix = (1 << bit) | (line[at] >> (8 - bit))
                        self.counts.setdefault((line[at - d:at], prefix), [0, 0])[line[at] >> (7 - bit) & 1] += 1
                        if d:
                            self.below[line[at - d + 1:at], prefix].add(line[at - d:at])

    def kt(self, node):
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def coded(self, node):
        if node not in self.memo:
            own = self.kt(node)
            self.memo[node] = own if len(node[0]) == ctw.DEPTH else math.log(0.5) + np.logaddexp(own, sum(self.coded((c, node[1])) for c in self.below[node]))
        return self.memo[node]

    def one(self, line, at, prefix, d=0):
        node = (line[at - d:at], prefix)
        if node not in self.counts:
            return None
        a, b = self.counts[node]
        own = (b + 0.5) / (a + b + 1)
        deeper = self.one(line, at, prefix, d + 1) if d < ctw.DEPTH else None
        if deeper is None:
            return own
        w = math.exp(math.log(0.5) + self.kt(node) - self.coded(node))
        return w * own + (1 - w) * deeper

    def log10(self, text):
        line, total = b"\xff" * ctw.DEPTH + text + b"\xff", 0.0
        for at in range(ctw.DEPTH, len(line)):
            for bit in range(8):
                p = self.one(line, at, (1 << bit) | (line[at] >> (8 - bit)))
                p = 0.5 if p is None else p
                total += math.log10(p if line[at] >> (7 - bit) & 1 else 1 - p)
        return total


@pytest.mark.parametrize("head,top,rows_at_once", [(1_000_000, 2_000_000, 1 << 19), (20, 0, 50), (0, 2_000_000, 1)])
def test_ctw_matches_the_recursion(spark, monkeypatch, head, top, rows_at_once):
    monkeypatch.setattr(ctw, "HEAD_TOKENS", head)
    monkeypatch.setattr(ctw, "HEAD_GRAMS", head)
    monkeypatch.setattr(ctw, "TOP_NODES", top)
    monkeypatch.setattr(ctw, "TASK_GRAMS", rows_at_once)
    rows = corpus(30, 3, 25)
    rows += [(500 + k, f"qé{k} zz{k}", None, None, 0) for k in range(30)]
    got = defaultdict(list)
    odd = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as key", "2 as row", "3 as n_tokens", "4 as held_out").repartition(5)
    for r in ctw.score(odd).collect():
        got[r["doc_id"]].append(r)
    tokens = lambda t: [lower(w) for w in WORD.findall(t or "")] + [0]
    training = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    assert len(training) < len(rows)
    c = Counter(x for r in training for x in tokens(r[1]))
    tree = BruteTree([(r[1] or "").encode() for r in training])
    n, v = sum(c.values()), len(c)
    assert sum(map(len, got.values())) == len(rows)
    for i, text, *_ in rows:
        t, raw = tokens(text), (text or "").encode()
        for g in got[i]:
            assert (g["n_tokens"], g["n_known"], g["train_tokens"], g["n_bytes"]) == (len(t), sum(c[x] > 0 for x in t), n, len(raw))
            assert g["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))
            assert g["score"] == pytest.approx(tree.log10(raw), rel=1e-7)
            assert g["bits_per_byte"] == pytest.approx(-g["score"] * math.log2(10) / (len(raw) + 1))


def test_ctw_is_a_distribution(spark, docs):
    model = ctw.fit(docs)
    keys = [int.from_bytes(x + bytes([b]), "big") for x in (b"\xff\xff\xff\xff\xff", b"abcde", b"zzzzz", b"zz ab") for b in range(256)]
    new = spark.createDataFrame([(k,) for k in keys], "key long").join(model.grams.select("key"), "key", "left_anti")
    logs = {r["key"]: r["log"] for r in model.logs().collect()} | {r["key"]: r["log"] for r in model.logs(new).collect()}
    for at in range(0, len(keys), 256):
        assert sum(10 ** logs[k] for k in keys[at:at + 256]) == pytest.approx(1, abs=1e-9)


def test_ctw_of_little(spark):
    assert ctw.score(empty(spark)).count() == 0
    alone = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0), "ab")], "doc_id long, text string")
    r = ctw.score(alone).first()  # held out, so nothing is learnt
    assert r["train_tokens"] == r["n_known"] == 0 and r["bits_per_byte"] == pytest.approx(8)
    named = spark.createDataFrame([("x", "ab"), (None, None)], "doc_id string, text string")
    assert sorted(map(str, (r["doc_id"] for r in ctw.score(named).collect()))) == ["None", "x"]


# --- 4 quality rules


def test_quality_measures_match_brute_force(spark, docs, rows):
    more = [(900, "a b c a b c x\n\nx\na b c\nx", None, None, 0), (901, "THE THE!! OF# $%& <x> |", None, None, 0), (902, "a a a a a a", None, None, 0)]
    table = docs.unionByName(spark.createDataFrame(more, DOCS))
    got = {r["_row"]["doc_id"]: r for r in quality.judge(table, keep=["doc_id"]).collect()}
    for i, t, *_ in rows + more:
        w, g = WORD.findall(t or ""), got[i]
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k:k + 3])].append(k)
        repeat = len({k + j for x in at.values() if len(x) > 1 for k in x for j in range(3)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeat)
        assert g["base_failed"] == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (g["base_failed"] and g["kept"])
    assert quality.judge(empty(spark)).count() == 0


def test_em_finds_the_better_rules(spark):
    rnd = random.Random(2)
    rules = [quality.Rule(f"r{i}", "", "") for i in range(4)]
    votes, truth = Counter(), [0.95, 0.9, 0.85, 0.6]
    for _ in range(20000):
        good = rnd.random() < 0.75
        votes[tuple((1 if good else -1) * (1 if rnd.random() < a else -1) if rnd.random() < 0.8 else 0 for a in truth)] += 1
    table = spark.createDataFrame([(*k, n) for k, n in votes.items()], "v_r0 int, v_r1 int, v_r2 int, v_r3 int, n long")
    model = quality.estimate(table, rules)
    assert abs(model["prior"] - 0.75) < 0.03
    assert all(abs(quality.accuracy(model, f"r{i}") - a) < 0.04 for i, a in enumerate(truth))


# --- 5 URL filter


def test_url_filter(spark, monkeypatch):
    urls = ["http://WWW.Bad.net/x.html?q#f", "https://bad.net/x/", "https://ok.net/x", None, "nothing", "a://", "HTTP://m.Example.ORG/es/1", "http://example.org/en/12", "http://notexample.org/es/1", "x://de.com/fr/", "x://de.com/de/1?x", "x://com/de/", "x://a.bcom/de/", "http://x.net?/org/", "a://b#://org/"]
    table = spark.createDataFrame([(i, u, 0, "z") for i, u in enumerate(urls)] + [(0, urls[0], 0, "z")], "page_id long, url string, listed int, canonical string")
    listed = spark.createDataFrame([("bad.net/x",), ("bad.net/x",), (None,), ("",)], "canonical string")
    for sent in (urlfilter.SENT_BLOCKS, 0):
        monkeypatch.setattr(urlfilter, "SENT_BLOCKS", sent)
        got = sorted((r["_row"]["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) for r in urlfilter.judge(table, listed, ["page_id"]).collect())
        assert len(got) == len(urls) + 1
        want = {0: ("www.bad.net", "/x.html", None, "block", True), 1: ("bad.net", "/x/", None, "block", True), 2: ("ok.net", "/x", None, "allow", False), 3: ("", "", None, "allow", False), 4: ("", "", None, "allow", False), 5: ("", "", None, "allow", False),
                6: ("m.example.org", "/es/1", "example.org/es/", "block", False), 7: ("example.org", "/en/12", "example.org/en/1", "block", False), 8: ("notexample.org", "/es/1", "org/", "allow", False), 9: ("de.com", "/fr/", "com/fr/", "allow", False),
                10: ("de.com", "/de/1", "com/de/", "block", False), 11: ("com", "/de/", "com/de/", "block", False), 12: ("a.bcom", "/de/", None, "allow", False), 13: ("x.net", "", None, "allow", False), 14: ("b", "", None, "allow", False)}
        assert all(want[g[0]] == g[1:] for g in got)
    none = spark.createDataFrame([], "canonical string")
    assert all(not r["listed"] for r in urlfilter.judge(table, none, ["page_id"]).collect())


def test_listed_urls_hold_links_that_are_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://www.free-bets.net/a.html?x", '<a href="/b/?q"><a href="http://else.net/z"><a href="#top">'), (2, "http://ok.net/b", '<a href="/c">'), (3, None, None), (4, "http://blog.cheap-pills.com", None)], "page_id long, url string, html string")
    listed = urlfilter.listed_urls(pages)
    assert {r[0] for r in listed.collect()} == {"free-bets.net/a", "free-bets.net/b", "cheap-pills.com"}
    more = spark.createDataFrame([(9, "https://free-bets.net/b/#x", "z" * 9), (10, "https://free-bets.net/" + "b" * 50_000, None)], "page_id long, url string, html string")
    got = {r["_row"]["page_id"]: r["verdict"] for r in urlfilter.judge(pages.unionByName(more), listed, ["page_id"]).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block", 9: "block", 10: "allow"}
    assert urlfilter.judge(pages.limit(0), listed, ["page_id"]).count() == 0


def test_bloom_passes_every_entry_and_few_others(spark):
    listed = spark.range(2000).selectExpr("concat('u', id) as e")
    rows = spark.range(4000).selectExpr("concat('u', id) as e")
    out = urlfilter.match_listed(rows, "e", listed)
    assert out.where("listed").count() == 2000 and out.count() == 4000
    table = urlfilter.bloom(listed, "e", 125)
    probe = rows.withColumn("b", urlfilter.block_of(rows["e"], 125)).join(table, table["block"] == F_col("b"))
    may = None
    for i, x in enumerate(urlfilter.bits(F_col("e"))):
        ok = F_col(f"w{i}").bitwiseAND(x) == x
        may = ok if may is None else may & ok
    assert 2000 <= probe.where(may).count() < 2100


def F_col(x):
    from pyspark.sql import functions as F

    return F.col(x)


# --- 6 substring dedup


def cut_brute(rows, width=13):
    words = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            m = tuple(w[k:k + width])
            if i is not None:
                least[m] = min(least.get(m, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k:k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,vocabulary,words", [(1, 2, 60), (2, 5, 90), (3, 300, 60)])
def test_dedup_matches_brute_force(spark, seed, vocabulary, words):
    rows = corpus(90, seed, words, vocabulary)
    shared = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"{t or ''} {shared} {i}" if n % 7 == 0 else t, *r) for n, (i, t, *r) in enumerate(rows)] + [(None, shared, None, None, 0), (None, None, None, None, 0)]
    table = spark.createDataFrame(rows, DOCS).repartition(6)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompress.dedup(table).collect()), key=str)
    assert got == cut_brute(rows)


def test_dedup_compares_words_and_rows_of_one_key(spark, monkeypatch):
    rnd = random.Random(17)
    a, b, c = ([f"{x}{k}" for k in range(40)] for x in "abc")
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[5:30] + c[:5] + b[20:36])), (3, " ".join(c[:20] + a[20:40])), (2, " ".join(c)), (4, "x " * 500 + " ".join(c)), (None, " ".join(a)), (5, "x " * 400)]
    rows += [(10 + k, " ".join(rnd.choices(["p", "q"], k=60))) for k in range(12)]
    table = [(i, t, None, None, 0) for i, t in rows]
    docs = spark.createDataFrame(table, DOCS).selectExpr("*", "1 as row", "2 as place", "3 as whole", "4 as doc").repartition(4)
    for held, sent, bits in ((1 << 21, 200_000, 64), (60, 200_000, 0), (60, 7, 5)):  # unlike windows of one name: none, all, some
        monkeypatch.setattr(recompress, "HELD", held)
        monkeypatch.setattr(recompress, "SENT_ROWS", sent)
        monkeypatch.setattr(recompress, "NAME_BITS", bits)
        got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompress.dedup(docs).collect()), key=str)
        assert got == cut_brute(table)
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("panelworks_texts")]


def test_dedup_of_nothing(spark):
    assert recompress.dedup(empty(spark)).count() == 0


def test_supports_decide_symbols():
    rnd = random.Random(9)
    words = [f"v{rnd.randrange(4)}" for _ in range(400)]
    for a in (10, 150, 300):
        inner = words[a:a + 40]
        found = []
        for left, right in ((["l"] * 3, ["r"] * 4), (words[5:30], words[200:260])):
            b = next(textops.blocks(pa.array([" ".join(left + inner + right)])))
            s = recompress.Symbols(b.word_hashes(), b.of, b.edges)
            for k in range(3):
                s.runs(20 + 4 * k)
                s.pairs(21 + 4 * k)
            inside = (s.left >= len(left)) & (s.right <= len(left) + 40)
            found.append({(int(n), int(x) - len(left), int(y) - len(left)) for n, x, y in zip(s.name[inside], s.left[inside], s.right[inside])})
        assert found[0] == found[1] and found[0]


# --- 7 WARC


def test_warc_round_trip(spark, tmp_path):
    rnd = random.Random(4)
    html = ["<p>" + "x" * rnd.randint(0, 400) + "é</p>" for _ in range(40)]
    rows = [(i * 700, f"http://h/{i}\r\nX: y" if i % 9 == 0 else f"http://h/{i}", rnd.choice(html)) for i in range(150)] + [(900001, None, None), (900002, "u", ""), (None, "n", "only"), (5, "u", "a\r\n\r\nb"), (5, "u", "a\r\n\r\nb")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as shard", "'x' as kind").repartition(4)
    digests = []
    for k in range(2):
        base = f"file://{tmp_path}/w{k}"
        manifest = warc.write_warc(table.repartition(3 + k), base, shard_bytes=20_000, roll_bytes=3_000)
        listed = {r["file"]: (r["bytes"], r["sha256"]) for r in manifest.collect()}
        files = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / f"w{k}").glob("*.gz")}
        assert listed == files and len(files) > 3
        digests.append(files)
    assert digests[0] == digests[1]
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, base).collect()), key=str)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want, seen = [], set()
    for i, _, h in rows:
        p = (h or "").encode()
        first = best[h or ""] == (-1 if i is None else i) and (i, h) not in seen
        seen.add((i, h))
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else best[h or ""]))
    assert got == sorted(want, key=str)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == 0


def test_warc_of_many_rows_without_a_key_and_of_large_payloads(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("cast(null as long) as page_id", "concat('u', id) as url", "concat('<p>', id % 15000) as html")
    base = f"file://{tmp_path}/unkeyed"
    manifest = warc.write_warc(rows, base, shard_bytes=1 << 20).collect()
    assert len({r["shard"] for r in manifest}) > 5 and sum(r["records"] for r in manifest) == 20_000
    got = warc.read_warc(spark, base)
    assert got.where("record_type = 'response'").count() == got.select("payload_digest").distinct().count() == 15_000
    large = spark.range(40).selectExpr("id as page_id", "'u' as url", "repeat(concat('é', id % 30), 1000000) as html").repartition(1)
    sizes = large.mapInArrow(lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    with warc.small_batches(spark, warc.BATCH_BYTES):
        assert max(r["n"] for r in sizes.collect()) < 2 * warc.BATCH_BYTES  # 40 rows of 3 to 4 MB come in several batches
    before = spark.conf.get(warc.BATCH_SETTING)
    out = warc.round_trip(large).collect()
    assert spark.conf.get(warc.BATCH_SETTING) == before
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out) == sorted(
        (i, 1_000_000 * (2 + len(str(i % 30))), "revisit" if i < 10 else "response", i + 30 if i < 10 else None) for i in range(40))


def test_warc_damage_is_an_error(spark, tmp_path):
    files = warc._Files(f"file://{tmp_path}", 0, 1 << 20)
    (tmp_path / "x").write_bytes(b"abc" * 999)
    assert files.digest_of(f"{tmp_path}/x") == hashlib.sha256(b"abc" * 999).hexdigest()
    base = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string"), base)
    name = next((tmp_path / "w").glob("*.gz"))
    name.write_bytes(name.read_bytes()[:-9])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_warc(spark, base).collect()


def test_bloom_false_positives_are_removed_by_the_join(spark):
    """With one bit for each entry nearly everything passes the filter; the exact join still lists what is listed."""
    listed = spark.range(3000).selectExpr("concat('h', id, '.net/x') as e")
    rows = spark.range(2000, 9000).selectExpr("id", "concat('h', id, '.net/x') as e")
    through = {}
    for size in (1, 16):
        probe, _ = urlfilter.passed(rows, "e", listed, size)
        through[size] = probe.where("_may").count() - 1000
        assert urlfilter.match_listed(rows, "e", listed, size).where("listed").selectExpr("min(id)", "max(id)", "count(*)").first()[:] == (2000, 2999, 1000)
    assert 0 <= through[16] < 200 < 1000 < through[1]


# --- 8 n-gram Jaccard join


def jaccard_brute(rows):
    sets = {}
    for k, (i, t, *_) in enumerate(rows):
        w = WORD.findall(lower(t or ""))
        sets[k] = frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[j:j + 3]) for j in range(len(w) - 2)])
    label, links = {k: k for k in sets}, Counter()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        x, y = label[a], label[b]
        for k in label:
            if label[k] == y:
                label[k] = x
    least = defaultdict(list)
    for k, c in label.items():
        if rows[k][0] is not None:
            least[c].append(rows[k][0])
    return sorted(((rows[k][0], len(sets[k]), min(least[label[k]], default=None), links[k]) for k in sets), key=str)


@pytest.mark.parametrize("leaf,tree,sent", [(128, 1 << 22, 1_000_000), (2, 4096, 0)])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, leaf, tree, sent):
    monkeypatch.setattr(sigtree, "LEAF", leaf)
    monkeypatch.setattr(sigtree, "TREE_TOKENS", tree)
    monkeypatch.setattr(sigtree, "SENT_ROWS", sent)
    rnd = random.Random(8)
    rows = corpus(60, 11, 40, 500)
    base = [f"b{k}" for k in range(120)]
    for k in range(40):
        t = list(base)
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(120)] = f"e{rnd.randrange(9)}"
        rows.append((1000 + k, " ".join(t), None, None, 0))
    for k in range(8, 14):
        rows += [(2000 + k, " ".join(f"q{j}" for j in range(k)), None, None, 0), (None, " ".join(f"q{j}" for j in range(k)), None, None, 0)]
    table = spark.createDataFrame(rows, DOCS).repartition(6)
    got = sigtree.jaccard_components(table)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got.collect()), key=str)
    assert got == jaccard_brute(rows)


def test_leaf_pairs_drop_only_what_cannot_link():
    rnd = np.random.default_rng(1)
    base = [rnd.integers(0, 1 << 60, 80).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([rnd.choice(base[rnd.integers(6)], 76, replace=False), rnd.integers(0, 1 << 60, rnd.integers(0, 30)).astype(np.uint64)])) for _ in range(70)]
    sets.sort(key=len)
    edges = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    tree = sigtree.Tree(ids, edges, 1024, 1)
    pairs = {tuple(sorted(p)) for p in sigtree.leaf_pairs(tree, tree).tolist()}
    every = {(a, b) for a in range(70) for b in range(a, 70)}
    links = {(a, b) for a, b in every if 190 * len(np.intersect1d(sets[a], sets[b])) >= 90 * (len(sets[a]) + len(sets[b]))}
    assert links <= pairs and len(pairs) < len(every) // 2


def test_signatures_of_linking_sets_meet():
    rnd = np.random.default_rng(2)
    for n in (8, 9, 10, 11, 19, 20, 40, 100, 700):
        for _ in range(20):
            a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
            drop = rnd.integers(0, n // 10 + 1)
            b = np.unique(np.concatenate([a[drop:], rnd.integers(0, 1 << 62, rnd.integers(0, n // 10 + 1)).astype(np.uint64)]))
            if 190 * len(np.intersect1d(a, b)) < 90 * (len(a) + len(b)) or len(a) == len(b) == len(np.intersect1d(a, b)):
                continue
            who, key = sigtree.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert set(key[who == 0].tolist()) & set(key[who == 1].tolist())


@pytest.mark.parametrize("shingle,num", [(3, 90), (5, 80), (2, 55)])
def test_signatures_meet_at_any_threshold(shingle, num):
    rnd = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 50, 120, 600):
        for _ in range(30):
            a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
            most = n * (100 - num) // 100 + 1
            b = np.unique(np.concatenate([a[rnd.integers(0, min(n, most) + 1):], rnd.integers(0, 1 << 62, rnd.integers(0, most + 1)).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if not len(b) or 100 * common < num * (len(a) + len(b) - common) or len(a) == len(b) == common:
                continue
            who, key = sigtree.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, 100)
            assert set(key[who == 0].tolist()) & set(key[who == 1].tolist())


def linked_by(a, b, shingle, num):
    x, y = ({tuple(w[j:j + shingle]) for j in range(max(1, len(w) - shingle + 1))} if w else set() for w in (WORD.findall(lower(t or "")) for t in (a, b)))
    return bool(x and y) and 100 * len(x & y) >= num * len(x | y)


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(21)
    stops = quality.STOPS[:10]
    texts, items = [], [(i, " ".join(f"leak{i}x{j}" for j in range(14))) for i in range(3)]
    for k in range(25):
        base = [rnd.choice(stops) if rnd.random() < 0.3 else f"word{rnd.randrange(900)}" for _ in range(rnd.choice([100, 60, 250]))]
        texts.append(list(base))
        for n in range(rnd.randrange(5)):
            near = list(base)
            for at in rnd.sample(range(10, len(base) - 10, 6), n):
                near[at] = f"new{k}"
            texts.append(near)
        if k % 6 == 0:
            texts.append([f"only{k}x{j}" if j % 3 else rnd.choice(stops) for j in range(70)] + items[k // 6 % 3][1].split(" ") + ["the", "end"])
        if k % 8 == 0:
            texts.append(base[:30])
    rnd.shuffle(texts)
    rows = [(i, " ".join(t), "en", "one", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {i: t for i, t, *_ in rows if len(t.split(" ")) >= 50}
    pairs = [(a, b) for a in left for b in left if a < b and linked_by(left[a], left[b], 5, 80)]
    assert any(not linked_by(left[a], left[b], 3, 90) for a, b in pairs)
    label = {i: i for i in left}
    for _ in left:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    left = {i: t for i, t in left.items() if label[i] == i}
    leaks = {i for i, t in left.items() if any(agreeing(t, s) for _, s in items)}
    got = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert leaks and got == sorted(set(left) - leaks)


def test_copies_of_a_text_never_meet(spark, monkeypatch):
    """Of 3,000 copies and a near copy one row stays, and the join sees each text once; blank copies all stay."""
    rnd, seen, join = random.Random(4), [], sigtree.jaccard_components
    words = [f"w{rnd.randrange(500)}" for _ in range(120)]
    near = " ".join([*words[:60], "other", *words[61:]])
    rows = [(i, " ".join(words), None, None, 0) for i in range(10, 3000)] + [(None, " ".join(words), None, None, 0)] * 10 + [(5, near, None, None, 0), (6, near, None, None, 0), (6, near, None, None, 0)] + [(7000 + i, " ", None, None, 0) for i in range(4)] + [(8000, "alone with a few words", None, None, 0)]

    def spy(docs, *more):
        seen.append(docs.groupBy().count().first()[0])
        return join(docs, *more)

    monkeypatch.setattr(sigtree, "jaccard_components", spy)
    kept = sigtree.one_of_each(spark.createDataFrame(rows, DOCS).repartition(6), shingle=5, num=80, den=100).collect()
    assert seen == [4] and sorted(r["doc_id"] for r in kept) == [5, 7000, 7001, 7002, 7003, 8000]


def test_one_of_each_judges_rows(spark):
    base = " ".join(f"w{k}" for k in range(40))
    near = base.replace("w39", "x")
    other = " ".join(f"z{k}" for k in range(40))
    rows = [(1, base), (1, other), (2, near), (1, base), (3, other), (None, base), (None, "alone in the world of words"), (None, None), (4, None), (4, " "), (5, "t " * 20_000), (6, "t " * 30_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _gone", "2 as _n", "3 as _r", "4 as _a", "5 as _row", "6 as _c", "7 as v").repartition(3)
    kept = sigtree.one_of_each(table, shingle=5, num=80, den=100)
    assert kept.columns == table.columns
    want = [(1, base), (1, other), (None, "alone in the world of words"), (None, None), (4, None), (4, " "), (5, "t " * 20_000)]
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(want)
    assert sigtree.one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "benchmark_leaks", "mixed_sources", "shards"])
def test_stages_take_anything(spark, tmp_path, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(None, None), (None, "seven words that no document has here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = " ".join(f"{a} {b}" for a, b in zip(quality.STOPS * 3, (f"word{k}" for k in range(90))))
    rows = [(1, clean, "en", "a", 1), (1, clean, "en", "a", 1), (None, clean + " more", None, None, None), (2, None, None, None, None), (3, "", "en", "a", 0), (4, clean + " and " + " ".join(f"long{k}" for k in range(30_000)), "en", "b", 9)]
    table = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as _row", "'y' as _key", "'z' as size", "'u' as shard", "'v' as kept")
    out = stage(spark, table, str(tmp_path))
    got = out.collect()
    if name == "shards":
        assert len(got) == len(rows) and sorted(r["doc_id"] or 0 for r in got) == [0, 1, 1, 2, 3, 4]
    else:
        assert out.columns == table.columns and {r["text"] for r in got} <= {r[1] for r in rows}
    if name == "benchmark_leaks":
        assert len(got) == len(rows)
    if name == "near_duplicates":
        assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((r[0], r[1] or "") for r in [rows[0], *rows[3:]])
    assert stage(spark, table.limit(0), str(tmp_path)).count() == 0


# --- 9 mixing


def test_mixing(spark, docs, rows):
    out = mixing.mix(docs, ["doc_id", "source"]).collect()
    assert len(out) == len(rows)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    total = sum(size[r[0]] for r in rows)
    sources = Counter()
    for r in rows:
        sources[r[3]] += size[r[0]]
    order = sorted((s for s in sources if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sources[s] for s in capped)
        target = {s: 3 * sources[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        more = {s for s in free if target[s] > 3 * sources[s]}
        if not more:
            break
        capped |= more
    took = Counter()
    for r in out:
        s = r["_row"]["source"]
        assert r["size"] == size[r["_row"]["doc_id"]] and r["source_size"] == sources[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        took[s] += r["taken"]
    longest = {s: max(size[r[0]] for r in rows if r[3] == s) for s in order}
    assert all(abs(took[s] - target[s]) <= longest[s] for s in order)
    again = sorted((r["_row"]["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(2), ["doc_id"]).collect())
    assert again == sorted((r["_row"]["doc_id"], r["copies"]) for r in out)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mix(empty(spark)).count() == 0


def test_fill_reaches_the_budget():
    rnd = random.Random(6)
    for _ in range(200):
        lengths = sorted(rnd.sample(range(1, 400), rnd.randint(1, 40)))
        counts = [rnd.randint(1, 30) for _ in lengths]
        size = sum(n * c for n, c in zip(lengths, counts))
        budget = rnd.randint(0, size)
        take = mixing.fill(lengths, counts, budget)
        got = sum(n * t for n, t in zip(lengths, take))
        assert all(0 <= t <= c for t, c in zip(take, counts)) and budget - lengths[-1] < got <= budget
    assert mixing.fill([3, 5], [4, 4], 11) == [2, 1]


# --- 10 language


def folded(data):
    return bytes(langid.SYMBOL[np.frombuffer(data, np.uint8)])


def test_parser_counts_longest_matches():
    rnd = random.Random(7)
    for alphabet, other in ((b"abcd ", b"abcdx 1"), (b"ab", b"abc"), (bytes(range(0x80, 0xF0)) + b"ab ", bytes(range(0x70, 0xF5)))):
        sample = bytes(rnd.choice(alphabet) for _ in range(300))
        p = langid.parser(sample)
        texts = [bytes(rnd.choice(other) for _ in range(n)) for n in (0, 1, 40, 255, 256, 257, 700, 3000)] + [sample[:290] * 4, b"ab" * 900]
        data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = langid.phrases(data, bounds, [p])[:, 0]
        for t, g in zip(texts, got.tolist()):
            want, k, sy, sa = (1 if t else 0), 0, folded(t), folded(sample)
            for j in range(len(t)):
                if sy[k:j + 1] not in sa:
                    want, k = want + 1, j if sy[j:j + 1] in sa else j + 1
            assert g == want


def test_parsing_takes_time_by_bytes_alone():
    """Text whose phrases never fall into step: as many phrases as byte by byte, in seconds for 10 MB, segments or not."""
    import time

    rnd = random.Random(3)
    numbers = b"".join(b"%d %d.%d\n" % (rnd.randrange(10**6), rnd.randrange(99), rnd.randrange(10)) for _ in range(9000))
    parsers = [langid.parser(x) for x in (b"ab cd, 12 " * 700 + b"q", numbers[:7000] + b" und so weiter", b"the " * 3 + b"x" * 500 + b"1" * 77)]

    def slow(text, p):
        state, found = 0, 0
        for c in p.column[np.frombuffer(text, np.uint8)].tolist():
            got = int(p.table[state + c])
            state, found = got >> 1, found + (got & 1)
        return found + (len(text) > 0)

    texts = [numbers[:70_000], b"1 " * 40_000, b"x" * 30_001, b"", b"ab cd, " * 5000]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    want = [[slow(t, p) for p in parsers] for t in texts]
    assert langid.phrases(data, bounds, parsers).tolist() == want
    for segment in (1000, 65_536):
        whole, langid.SEGMENT = langid.SEGMENT, segment
        try:
            assert langid.phrases(data, bounds, parsers).tolist() == want
        finally:
            langid.SEGMENT = whole
    for long in (numbers * (10**7 // len(numbers)), b"xy1 " * 2_500_000, b"0" * 10**7):
        began = time.time()
        langid.phrases(np.frombuffer(long, np.uint8), np.array([0, len(long)]), parsers)
        assert time.time() - began < 60


def test_language_matches_brute_force(spark):
    rnd = random.Random(12)
    v = {"en": ["the", "thing", "with", "that", "and"], "de": ["der", "und", "nicht", "für", "sch"], "ру": ["это", "не", "так", "что"]}
    rows = [(i, " ".join(rnd.choices(v[k], k=rnd.randint(1, 30)) + rnd.choices(sum(v.values(), []), k=5)), k, None, 0) for i, k in enumerate(rnd.choices(list(v), k=60))]
    rows += [(700, " ".join(rnd.choices(v["de"], k=40_000)), None, None, 0), (701, "it " * 3000, None, None, 0)]
    table = spark.createDataFrame(rows, DOCS)
    model = dict(langid.fit(table.where("crc32(cast(doc_id as string)) % 4 <> 2")))
    assert sorted(model) == sorted(v)
    sample = {k: b"\n".join(sorted((t.encode() for i, t, g, *_ in rows if g == k and zlib.crc32(str(i).encode()) % 4 != 2))) for k in v}
    for k in v:  # the sample is small enough to be whole
        assert model[k].size == len(sample[k])
    order = {r["text"]: r["h"] for r in table.selectExpr("text", "xxhash64(41, doc_id, text) as h").collect()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(table.select("*").withColumnsRenamed({"n_chars": "letter"})).collect()}
    for i, t, *_ in rows[::5] + rows[-2:]:
        cost = {}
        for k in sorted(v):
            text = folded(b"\n".join(x.encode() for x in sorted((x for j, x, g, *_ in rows if g == k and zlib.crc32(str(j).encode()) % 4 != 2), key=order.get)))
            sy, n, at = folded(t.encode()), 1, 0
            for j in range(len(sy)):
                if sy[at:j + 1] not in text:
                    n, at = n + 1, j if sy[j:j + 1] in text else j + 1
            cost[k] = n * math.log2(len(text) + 1)
        best = sorted(cost, key=lambda k: (cost[k], k))
        assert got[i][0] == best[0] and got[i][1] == pytest.approx(1 - cost[best[0]] / cost[best[1]])


def test_samples_share_the_bytes():
    assert langid.shared([b"a" * 9, b"b" * 3, b"c" * 90], 40) == b"a" * 9 + b"\n" + b"bbb" + b"\n" + b"c" * 25
    assert langid.shared([b"x" * 50] * 4, 20) == b"\n".join([b"xxxx"] * 4) and langid.shared([b"ab", b"c"], 99) == b"ab\nc"


def test_language(spark):
    rnd = random.Random(1)
    v = {"en": ["the", "thing", "with", "that", "and"], "de": ["der", "und", "nicht", "für", "sch"], "fr": ["le", "que", "eau", "été", "dans"]}
    rows = [(i, " ".join(rnd.choices(v[k], k=30)), k, None, 0) for i, k in enumerate(rnd.choices(list(v), k=150))] + [(900, None, "en", None, 0), (901, "12 !!", "en", None, 0), (902, "", None, None, 0), (None, "the thing with that", "en", None, 0)]
    got = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    assert all(g["lang_pred"] == (lang[g["doc_id"]] if g["doc_id"] not in (900, 901, 902) else "und") and 0 <= g["score"] <= 1 for g in got)
    assert all(g["held_out"] == (g["doc_id"] is not None and zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2) for g in got)
    assert langid.identify(empty(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, "the", None, None, 0)], DOCS)
    assert langid.identify(unlabelled).first()["lang_pred"] == "und"


# --- all: extra columns whose names the operators use themselves


def test_clashing_column_names_do_no_harm(spark):
    from pyspark.sql import functions as F

    rows = corpus(20, 5)[:22]
    plain = spark.createDataFrame(rows, DOCS)
    names = ["size", "shard", "slot", "law", "v", "w", "key", "n", "comp", "seed", "at", "item_id", "code", "whole", "place", "_rank", "taken", "copies", "letter", "held_out", "score", "kept", "p_good", "n_words", "_m", "r"]
    odd = plain.select("*", *[F.lit("x").alias(c) for c in names])
    items = spark.createDataFrame([(1, rows[3][1] or "a b c d e f g h i j")], "item_id long, text string")
    got = lambda df: sorted(map(str, df.collect()))
    for run in (sharding.shard, sigtree.jaccard_components, recompress.dedup, langid.identify, lambda d: mixing.mix(d, ["doc_id"])):
        assert run(odd).count() == len(rows)
    assert got(decontam.overlaps(odd, items)) == got(decontam.overlaps(plain, items))
    for run in (quality.kept_rows, lambda d: decontam.clean_rows(d, items), mixing.mixed_rows):
        out = run(odd)
        assert out.columns == odd.columns and got(out.select(*plain.columns)) == got(run(plain))
