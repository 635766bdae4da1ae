"""SimHash near duplicates, divergence of sources and whitening against brute force on small fixtures."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from panelworks.llm import divergence, simhash, whitening

DOCS = "doc_id long, text string, lang string, source string, fp string, root string"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


# --- 11 SimHash


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def slow_components(fps, distance=3):
    """Smallest id by fingerprint."""
    own = sorted(set(fps.values()))
    label = {f: f for f in own}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= distance:
                label[root(a)] = root(b)
    least = {}
    for k, f in fps.items():
        least[root(f)] = min(least.get(root(f), k), k)
    return {k: least[root(f)] for k, f in fps.items()}


def texts(n=150, seed=5):
    rnd = random.Random(seed)
    v = ["".join(rnd.choice("abcdeÉü") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            t = rnd.choice(out).split(" ")
            for _ in range(rnd.randint(0, 2)):
                t[rnd.randrange(len(t))] = rnd.choice(v)
            out.append(" ".join(t))
        else:
            out.append(" ".join(rnd.choices(v, k=rnd.choice([1, 2, 3, 30, 200]))))
    return out + [None, "", " \t\n", "A", "a", "A B", "a\x0bb", " ".join(rnd.choices(v, k=9000)), "Straße " * 40]


def test_simhash_against_brute_force(spark):
    rows = [(i, t, "en", "s", "x", "y") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + rows[:3], DOCS).repartition(4)
    got = simhash.near_duplicates(docs).collect()
    want = {r[0]: slow_fingerprint(r[1]) for r in rows}
    group = slow_components(want)
    assert len(got) == len(rows) + 3 and len(set(group.values())) < len(group) - 20
    for r in got:
        assert r["fingerprint"] == f"{want[r['doc_id']]:016x}" and r["component_id"] == group[r["doc_id"]]


def test_simhash_hashes_long_texts_in_pieces(monkeypatch):
    t = texts()[-2] + " Ünd\t ende"
    monkeypatch.setattr(simhash, "PIECE", 7)
    pieces = list(simhash.pieces(t.encode(), 50))
    assert b"".join(pieces) == t.encode() and len(pieces) > 100
    assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


@pytest.mark.parametrize("parts", [None, [(list(range(32)), 1), (list(range(32, 64)), 1)], [(list(range(20)), 2), (list(range(20, 64)), 0)], [(list(range(0, 64, 2)), 3), (list(range(1, 64, 2)), -1)]])
def test_links_of_any_allotment_miss_nothing(spark, parts):
    """Random balls of fingerprints, blocks far larger than a chunk, and the parts that the operator would choose itself."""
    rnd, fps = random.Random(8), set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(40)}
    fps |= {rnd.getrandbits(64) & 0xFFFF for _ in range(150)}  # 48 bits in common
    values = np.array(sorted(fps), np.uint64)
    table = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long").repartition(3)
    if parts is None:
        seen = simhash.totals(table, simhash.together, 4097)
        assert seen[-1] == len(fps) and seen[0] == sum(x & 1 for x in fps)
        groups = simhash.grouped_bits(seen[:-1].reshape(64, 64), len(fps))
        counts = np.concatenate([np.bincount(np.packbits(simhash.bits(values)[:, g], axis=1, bitorder="little").ravel(), minlength=256) for g in groups])
        shares = simhash.distances(groups, counts, len(fps))
        assert sorted(b for g in groups for b in g) == list(range(64)) and all(abs(s.sum() - 1) < 1e-9 for s in shares)
        parts = simhash.allotted(groups, shares, len(fps))
    assert sum(t + 1 for _, t in parts) >= 4
    parts = [p for p in parts if p[1] >= 0]
    ids = {int(f): i for i, f in enumerate(values)}
    want = slow_components({i: f for f, i in ids.items()})
    for chunk in (16, 4096):
        label = {i: i for i in want}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in simhash.links(table, parts, chunk=chunk).collect():
            a, b = a & (1 << 64) - 1, b & (1 << 64) - 1
            a, b = sorted((root(ids[a]), root(ids[b])))
            label[b] = a
        assert {i: root(i) for i in want} == want


def test_thresholds_follow_the_counts():
    even = [np.array([0.5**8 * v for v in (1, 8, 28, 56, 70, 56, 28, 8, 1)])] * 8
    groups = [list(range(8 * g, 8 * g + 8)) for g in range(8)]
    few, many = simhash.allotted(groups, even, 10**4), simhash.allotted(groups, even, 10**10)
    assert [t for _, t in few] == [0] * 4 and len(many) < 4 and max(t for _, t in many) > 0
    same = [np.eye(9)[0]] * 2 + even[:6]  # two groups that tell nothing apart
    skewed = simhash.allotted(groups, same, 10**6)
    assert all(len(set(b) - set(range(16))) >= 8 for b, t in skewed) and sum(t + 1 for _, t in skewed) == 4


def test_simhash_empty_and_null(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "q w e r t y")], "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter({(None, 4): 1, (4, 4): 1, (None, None): 1})


# --- 12 divergence


def slow_audit(rows, min_docs=10, top=10):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t or "")))) for _, t, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = [t for t, n in df.items() if n >= min_docs]
        sums = defaultdict(Counter)
        for _, s, c in own:
            sums[s].update({t: c[t] for t in kept if t in c})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, whole = {s: share(c) for s, c in sums.items()}, share(sum(sums.values(), Counter()))
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sums:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sums if o != s)
            terms = sorted((-gap(p[s][t], whole[t]), t.encode(), t) for t in kept if sums[s][t] and p[s][t] > whole[t])[:top]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)]
    return Counter(out)


def sources(n=260, seed=2):
    rnd = random.Random(seed)
    v = ["".join(rnd.choice("abcÉÜß語") for _ in range(rnd.randint(1, 5))) for _ in range(80)] + ["Don't", "x1y", "A_B", "𝔘n"]
    rows = []
    for i in range(n):
        s = rnd.choice(["s1", "s2", "s3", "Ünder", None, "hot", "hot", "hot"])
        words = rnd.choices(v, weights=[1 + 9 * (k % 3 == 0) if s == "hot" else 1 for k in range(len(v))], k=rnd.choice([0, 1, 5, 30]))
        rows.append((i, " ".join(words) if rnd.random() > 0.05 else None, rnd.choice(["en", "en", "en", "de", None]), s, "x", "y"))
    return rows + [(n, " ".join(rnd.choices(v, k=20000)), "en", "s1", "", ""), (n + 1, "one two", "rare", "s1", "", ""), (n + 2, None, "rare", "s2", "", ""), (n + 3, "123", "en", "silent", "", ""), rows[3], rows[3]]


@pytest.mark.parametrize("slice_terms", [1 << 20, 12])
def test_divergence_against_brute_force(spark, slice_terms):
    rows = sources()
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(4), slice_terms=slice_terms).collect()
    assert Counter(tuple(r) for r in got) == slow_audit(rows)
    assert any(r["part"] == "term" for r in got) and any(r["lang"] == "rare" and r["value"] == 0 for r in got)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_shares_beyond_64_bits(spark):
    got = spark.createDataFrame([(10**15, 10**17, 10**6)], "n long, total long, V long").select(divergence.share("n", "total", "V").alias("p")).first()[0]
    assert got == 1 + 10**9 * (10**15 + 2) // (10**17 + 2 * 10**6)


# --- 13 whitening


@pytest.mark.parametrize("kind", ["random", "cluster", "diagonal", "rank one", "zero"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 60])
def test_leading_components(kind, n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    a = {"random": (q * rng.uniform(0, 9, n)) @ q.T, "cluster": (q * np.where(np.arange(n) < 5, 3.0, 1e-9)) @ q.T, "diagonal": np.diag(rng.integers(1, 4, n).astype(float)), "rank one": np.outer(q[0], q[0]), "zero": np.zeros((n, n))}[kind]
    a = (a + a.T) / 2
    values, vectors = whitening.principal(a, 16)
    top = np.linalg.eigvalsh(a)[::-1][:16]
    scale = max(abs(top[0]), 1e-300)
    assert np.abs(values - top).max() <= 1e-13 * scale and np.abs(a @ vectors - vectors * values).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 20)) * np.geomspace(3, 0.05, 20) + 2
    rows = [(i, [float(np.float32(c)) for c in v], i % 3) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(150)] + [rows[5]]  # a third are copies of one vector
    bad = [(2000, None, 1), (2001, [None, *rows[1][1][1:]], 1), (2002, [float("nan"), *rows[1][1][1:]], 1), (2003, [*rows[1][1][1:], float("-inf")], 1)]
    short = [(None, rows[2][1][:-1], 2), (3001, [], 2)]
    table = spark.createDataFrame(rows + bad + short, "vec_id long, embedding array<float>, n int").repartition(4)
    kept = [(k, [*v, *[0.0] * (20 - len(v))]) for k, v, _ in rows + short]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    got = defaultdict(list)
    for r in whitening.whiten(table).collect():
        got[r["vec_id"], r["component"]].append(r)
    assert sum(map(len, got.values())) == 16 * len(kept)
    sign = {}
    for (k, _), own in zip(kept, x):
        for c in range(16):
            want = (own - s / n) @ vectors[:, c] / np.sqrt(values[c])
            for r in got[k, c + 1]:
                assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, s))
                assert abs(r["explained"] - values[c] / np.trace(y.T @ y / n)) < 1e-9 and r["identity_error"] < 1e-9
                if abs(want) > 1e-6:
                    sign.setdefault(c, np.sign(want * r["whitened"]))
                    assert abs(want * sign[c] - r["whitened"]) < 1e-6 * max(1, abs(want))


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], kind)).collect() == []
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["n"], r["deviation"]) for r in two) == [(1, 1, 1.0, 2, 128**2), (2, 1, 1.0, 2, 128**2)]
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38]), (2, [-3e38])], kind)).collect()
    assert [r["deviation"] for r in huge] == [None, None] and sorted(round(r["whitened"], 6) for r in huge) == [-1.0, 1.0]
