"""Hand-computed fixtures: joins, roll-ups, geometry, networks, consensus and estimators."""

import math

import pytest
from pyspark.sql import functions as F

from panelworks.functions import columns as C
from panelworks.operators import aggregate as A
from panelworks.operators import annotate as B
from panelworks.operators import estimate as E
from panelworks.operators import joins as J
from panelworks.operators import network as N
from panelworks.operators import spatial as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_asof_nearest_takes_the_earlier_year_on_ties(spark):
    left = spark.createDataFrame([("a", 2005), ("a", 2010), ("b", 2005), (None, 2005)], "k string, year int")
    right = spark.createDataFrame([("a", 2003, 1.0), ("a", 2007, 2.0), ("b", 2001, 3.0), ("b", None, 9.0)], "k string, release int, v double")
    got = {(r["k"], r["year"]): (r["v"], r["matched_year"]) for r in J.asof_nearest(left, right, ["k"], "year", "release", ["v"], 2, []).collect()}
    assert got == {("a", 2005): (1.0, 2003), ("a", 2010): (None, None), ("b", 2005): (None, None), (None, 2005): (None, None)}


def test_asof_backward_checks_the_window(spark):
    left = spark.createDataFrame([("e", 20100101), ("e", 20150101), ("e", 19990101), ("x", 20100101)], "k string, at int")
    right = spark.createDataFrame([("e", 20000101, 20150101, 3000.0), ("e", 20150101, 99991231, 5000.0)], "k string, valid_from int, valid_to int, adt double")
    got = {(r["k"], r["at"]): r["adt"] for r in J.asof_backward(left, right, ["k"], "at", "valid_from", "valid_to", ["adt"]).collect()}
    assert got == {("e", 20100101): 3000.0, ("e", 20150101): 5000.0, ("e", 19990101): None, ("x", 20100101): None}


def test_interval_years(spark):
    df = spark.createDataFrame([(1, 2014, 2016), (2, 2016, 2014), (3, None, 2014)], "k int, lo int, hi int")
    assert [r["year"] for r in J.interval_years(df, "lo", "hi").orderBy("year").collect()] == [2014, 2015, 2016]


def test_duplicate_right_key_fails(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="duplicate key"):
        J.many_to_one(left, right, ["k"]).collect()
    assert J.many_to_one(left, right.limit(1), ["k"]).count() == 1


def test_range_join_keeps_the_tolerance(spark):
    p = spark.createDataFrame([("r", 9.9), ("r", 9.8), ("r", 20.1), ("q", 10.0)], "k string, pos double")
    r = spark.createDataFrame([("r", 10.0, 20.0)], "k string, b double, e double")
    assert sorted(x["pos"] for x in J.in_range(p, r, ["k"], "pos", "b", "e", 0.1, 3.0).collect()) == [9.9, 20.1]


def test_weighted_mean_and_z(spark):
    df = spark.createDataFrame([("c", 30000.0, 3.0), ("c", 10000.0, 1.0), ("c", None, 5.0)], "k string, x double, w double")
    assert df.groupBy("k").agg(A.weighted_mean(F.col("x"), F.col("w")).alias("m")).first()["m"] == 25000
    z = A.z_within(spark.createDataFrame([("c", 1.0), ("c", 2.0), ("c", 3.0), ("d", 5.0)], "k string, x double"), ["k"], "x", "z")
    assert {(r["x"], r["z"]) for r in z.collect()} == {(1.0, -1.0), (2.0, 0.0), (3.0, 1.0), (5.0, None)}
    w = spark.createDataFrame([("c", 1.0, 1.0), ("c", 3.0, 1.0), ("c", 5.0, None), ("d", 1.0, 0.0)], "k string, x double, w double")
    assert {(r["x"], r["z"]) for r in A.weighted_z_within(w, ["k"], "x", "w", "z").collect()} == {(1.0, -1.0), (3.0, 1.0), (5.0, 3.0), (1.0, None)}


def test_columns(spark):
    L = F.lit
    r = one(spark, a=C.parse_number(L("~1 234,5")), b=C.parse_number(L("..")), c=C.range_set(L("PK, 3-5")), d=C.range_set(L(None).cast("string")), e=C.scaled(L(0.25), 1, 1), f=C.fixed_key([(L(3), 2), (L("17"), 4)]),
            g=C.fixed_key([(L(0), 2), (L("17"), 4)]), h=C.release_tag(L("jul26"))[0], i=C.release_tag(L("jul26"))[1], j=C.release_tag(L("xyz26"))[0], k=C.position_km(L("66+280")), m=C.distance_bin(L(100), [100, 200]), n=C.distance_bin(L(0), [100, 200]))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"], r["g"], r["h"], r["i"], r["j"], r["k"], r["m"], r["n"]) == (1234.5, None, [-1, 3, 4, 5], [], 0.2, "030017", None, 2026, 7, None, 66280, "0-100m", "0-100m")


def test_within_and_nearest_match_brute_force(spark):
    import random

    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-90, 90), rnd.uniform(-90, 90)) for i in range(40)]
    seg = [(i, *[rnd.uniform(-100, 100) for _ in range(4)]) for i in range(15)] + [(99, 5.0, 5.0, 5.0, 5.0)]

    def dist(p, s):
        dx, dy = s[3] - s[1], s[4] - s[2]
        n = dx * dx + dy * dy
        f = max(0.0, min(1.0, ((p[1] - s[1]) * dx + (p[2] - s[2]) * dy) / n)) if n else 0.0
        return math.hypot(p[1] - s[1] - f * dx, p[2] - s[2] - f * dy)

    P, G = spark.createDataFrame(pts, "p int, x double, y double"), spark.createDataFrame(seg, "l int, x1 double, y1 double, x2 double, y2 double")
    got = {(r["p"], r["l"]) for r in S.within(P, G, 10.0, "p", "l").collect()}
    assert got == {(p[0], s[0]) for p in pts for s in seg if dist(p, s) <= 10}
    best = {r["p"]: r["l"] for r in S.nearest(P, G, 2.0, 20.0, "p", "l").collect()}
    for p in pts:
        d, l = min((dist(p, s), s[0]) for s in seg)
        assert best[p[0]] == (l if d <= 20 else None)


def test_transverse_mercator_known_point(spark):
    e, n = S.transverse_mercator(F.lit(15.0), F.lit(60.0), 15.0)
    r = one(spark, e=e, n=n)
    assert abs(r["e"] - 500000) < 1e-6 and abs(r["n"] - 6651411.190) < 0.01


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "a long, b long")
    assert rows(N.components(e)) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]


def panel(spark, data):
    return spark.createDataFrame(data, "u int, year int, y double, first int")


def test_att_of_one_cohort_is_a_double_difference(spark):
    p = panel(spark, [(1, 1, 1.0, 2), (1, 2, 3.0, 2), (2, 1, 1.0, None), (2, 2, 2.0, None)])
    d = E.changes(p, "u", "year", "y", "first")
    assert rows(E.group_time(d, "year")) == [(2, 2, 1.0, 1, 1)]
    assert E.overall(E.group_time(d, "year")).first()["att"] == 1.0


def test_absorbed_regression_matches_dummies(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = [(u, y, float(rng.normal() + u * 0.3 + y * 0.1 + (1.5 if u < 6 and y >= 3 else 0)), float(u < 6 and y >= 3)) for u in range(12) for y in range(6) if (u + 2 * y) % 7]
    r, info = E.regression(spark.createDataFrame(data, "u int, year int, y double, d double"), "y", ["d"], ["u", "year"], "u")
    x = np.zeros((len(data), 19))
    for i, (u, y, _, d) in enumerate(data):
        x[i, 0], x[i, 1 + u], x[i, 13 + y] = d, 1, 1
    b = np.linalg.lstsq(x, np.array([z[2] for z in data]), rcond=None)[0]
    assert r[0]["coef"] == pytest.approx(b[0], abs=1e-6) and info["n"] == len(data)


def test_draws_do_not_depend_on_partitions(spark):
    u = spark.range(50).select(F.col("id").alias("u"), F.when(F.col("id") < 9, F.col("id")).alias("first"))
    a, b = (rows(E.permuted_first(u.repartition(k), "u", "first", 3, 1)) for k in (2, 8))
    assert a == b and len(a) == 150


def test_loudness_falls_from_the_reference_distance(spark):
    d = [1.0, 25.0, 50.0, 100.0, 800.0, 50_000.0]
    got = [r["x"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(d)], "k int, d double").select("k", C.loudness_reduction_pct(F.col("d")).alias("x")).orderBy("k").collect()]
    assert got[0] == pytest.approx(got[1]) and 0 <= max(got) <= 40
    assert all(a > b > 0 for a, b in zip(got[1:], got[2:]))
    assert (got[1], got[3], got[4]) == pytest.approx((38.4, 16.7, 4.8), abs=0.05)


def test_distance_bins(spark):
    df = spark.createDataFrame([(50.0,), (150.0,), (450.0,), (750.0,), (5000.0,)], "d double")
    assert [r["b"] for r in df.select("d", C.distance_bin(F.col("d"), [100, 200, 500, 1000]).alias("b")).orderBy("d").collect()] == ["0-100m", "100-200m", "200-500m", "500-1000m", "beyond_1000m"]


def test_entity_names(spark):
    same = [("Älvegårdsskolan 4-9", "Älvegårdsskolan 1-9"), ("Hallernaskolan 7-9 enhet 2", "Hallernaskolan enhet 1"), ("RONNASKOLAN H", "Ronnaskolan"), ("Sånnaskolan LM", "Sånnaskolan M"),
            ("Spängerskolan MH", "Spängerskolan LMH"), ("Vegalyckan särskola", "Vegalyckan"), ("Hagalundskolan Särskola", "Hagalundskolan"), ("Rydsbergsskolan grundsärskola", "Rydsbergsskolan"),
            ("Herrgårdsgymnasiet", "Herrgårdsgymnasiet anpassad gymnasieskola")]
    got = spark.createDataFrame([(*p,) for p in same], "a string, b string").select(C.norm_entity(F.col("a")).alias("a"), C.norm_entity(F.col("b")).alias("b")).collect()
    assert all(r["a"] == r["b"] and r["a"] for r in got)
    r = one(spark, m=C.norm_entity(F.lit("Malmö skola")), u=C.norm_entity(F.lit("Enhet Nord")), t=C.numbered_twins(F.lit("Vasaskolan 1"), F.lit("Vasaskolan 2")), f=C.numbered_twins(F.lit("Skolan 4-9"), F.lit("Skolan 1-9 B")))
    assert (r["m"], r["u"], r["t"], r["f"]) == ("malmö skola", "enhet nord", True, False)


def test_stitched_series_standardises_each_side_of_the_break(spark):
    df = spark.createDataFrame([("s1", 2010, "old", 200.0, 10.0), ("s2", 2011, "old", 220.0, 30.0), ("s1", 2016, "new", 260.0, None), ("s2", 2017, "new", 280.0, 0.0), ("s3", 2017, "new", None, 5.0)], "s string, year int, era string, v double, w double")
    got = {(r["outcome"], r["year"]): r["value"] for r in A.stitched(df, "era", "v", "w", "m", ["s", "year", "era"]).collect()}
    assert set(got) == {("m_z", 2010), ("m_z", 2011), ("m_z", 2016), ("m_z", 2017), ("m_zw", 2010), ("m_zw", 2011)}
    assert got["m_z", 2010] == pytest.approx(-math.sqrt(0.5)) == -got["m_z", 2011] and got["m_z", 2016] < 0 < got["m_z", 2017]
    assert got["m_zw", 2010] == pytest.approx(-15 / math.sqrt(75)) and got["m_zw", 2011] == pytest.approx(5 / math.sqrt(75))


def test_adjudicator_decides_conflicts_alone(spark):
    a = [("t1", "one", 1, "right", -6.8, None), ("t1", "boss", 2, "both_sides", 12.2, -7.0), ("t2", "one", 1, "left", 3.0, None), ("t2", "two", 1, "left", 3.0, None), ("t2", "boss", 2, "right", -3.0, None),
         ("t3", "one", 1, "right", -6.8, None), ("t3", "boss", 2, "occluded", None, None), ("t4", "one", 1, "left", 3.0, None), ("t4", "one", 2, "left", 5.0, None), ("t4", "boss", 2, "left", 7.0, None),
         ("t5", "one", 1, "left", 3.0, None), ("t5", "two", 1, "right", -4.0, None), ("t6", "one", 1, "unsure", None, None), ("t7", "one", 1, "centre", 0.5, None)]
    got = {r["t"]: (r["decision"], r["adjudicated"], r["lat_m"], r["lat_other_m"]) for r in B.consensus(spark.createDataFrame(a, "t string, reviewer string, at int, category string, lat_m double, other double"), "t", "boss").collect()}
    assert got == {"t1": ("both_sides", True, 12.2, -7.0), "t2": ("side", True, -3.0, None), "t3": ("side", False, -6.8, None), "t4": ("side", False, 6.0, None), "t5": ("conflict", False, None, None), "t6": ("unsure", False, None, None), "t7": ("centre", False, None, None)}


def test_asof_backward_over_blocks_and_nulls(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    windows = [(k, s, s + rnd.randint(1, 30), float(i)) for i, (k, s) in enumerate(sorted({(rnd.choice("ab"), rnd.randrange(1000)) for _ in range(120)}))] + [(None, 1, 2000, -1.0), ("a", None, 5, -2.0)]
    left = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(0, 1100, 7)])) for i in range(300)]
    want = {}
    for i, k, at in left:
        held = [w for w in windows if k is not None and at is not None and w[0] == k and w[1] is not None and w[1] <= at]
        best = max(held, key=lambda w: w[1], default=None)
        want[i] = best[3] if best and at < best[2] else None
    for rows_at_once in (100_000, 10):
        monkeypatch.setattr(J, "BLOCK_ROWS", rows_at_once)
        got = J.asof_backward(spark.createDataFrame(left, "i int, k string, at int"), spark.createDataFrame(windows, "k string, f int, u int, v double"), ["k"], "at", "f", "u", ["v"])
        assert {r["i"]: r["v"] for r in got.collect()} == want


def test_exact_cuts_match_numpy_with_a_hot_value_and_a_null_group(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    data = [(g, float(v)) for g in ("a", None) for v in [*rng.normal(size=40), *[0.25] * 30]] + [("b", 7.0), ("c", None)]
    df, at = spark.createDataFrame(data, "g string, x double"), [0.0, 0.1, 0.5, 0.73, 1.0]
    want = {g: np.percentile([x for h, x in data if h == g], [100 * p for p in at]) for g in ("a", None, "b")}
    got = {r["g"]: r["cuts"] for r in A.exact_cuts(df, "x", at, ["g"]).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(list(want[g]), abs=1e-12) for g in want)
    assert A.exact_cuts(df, "x", at).first()["cuts"] == pytest.approx(list(np.percentile([x for _, x in data if x is not None], [100 * p for p in at])), abs=1e-12)
    assert A.exact_cuts(df.where("g = 'c'"), "x", at).first()["cuts"] is None


def test_holm_over_range_partitions(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    data = [(f, i, float(p)) for f, n in (("x", 60), (None, 7)) for i, p in enumerate(rng.uniform(size=n) ** 4)] + [("x", 99, None)]
    want = {}
    for f in ("x", None):
        own, high = sorted((p, i) for g, i, p in data if g == f and p is not None), 0.0
        for k, (p, i) in enumerate(own):
            high = max(high, min(1.0, (len(own) - k) * p))
            want[f, i] = high
    got = {(r["f"], r["i"]): r["adj"] for r in A.holm(spark.createDataFrame(data, "f string, i int, p double").repartition(3), ["f"], "p", "adj").collect()}
    assert got.pop(("x", 99)) is None and got == pytest.approx(want)


def test_overlaps_match_all_pairs_at_any_step(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    a, b = ([(int(k), i, float(s), float(s + n)) for i, (k, s, n) in enumerate(zip(rng.integers(0, 2, 40), rng.integers(-20, 60, 40), rng.integers(0, 25, 40), strict=True))] for _ in range(2))
    want = sorted((k, i, j, min(e, f) - max(s, r)) for k, i, s, e in a for h, j, r, f in b if k == h and min(e, f) - max(s, r) > 0 and e > s and f > r)
    left, right = spark.createDataFrame([*a, (0, 90, None, 5.0)], "k int, i int, s1 double, e1 double"), spark.createDataFrame(b, "k int, j int, s2 double, e2 double")
    for step in (3.0, 500.0):
        assert sorted(tuple(r) for r in J.overlapping(left, right, ["k"], "s1", "e1", "s2", "e2", step).select("k", "i", "j", "overlap").collect()) == want


def test_best_matches_see_every_name(spark):
    from difflib import SequenceMatcher

    import numpy as np

    from panelworks.operators import lineage as L

    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcd "), 8))
    lost, register = [(i, word(), i % 2) for i in range(20)] + [(50, None, 0)], [(i, word(), i % 2) for i in range(30)]
    want = []
    for o, a, area in lost:
        sims = [(SequenceMatcher(None, a, b).ratio(), n) for n, b, k in register if k == area] if a is not None else []
        top = max((s for s, _ in sims), default=0.0)
        if top >= 0.5:
            best = [n for s, n in sims if s >= top - 1e-9]
            want.append((o, min(best), round(top, 9), len(best) > 1, sum(s >= 0.8 for s, _ in sims)))
    got = L.best_matches(spark.createDataFrame(lost, "old int, name string, area int"), spark.createDataFrame(register, "new int, name string, area int"), "area").collect()
    assert sorted((r["old"], r["new"], round(r["name_sim"], 9), r["tie"], r["n_close"]) for r in got) == want


def test_name_candidates_lose_no_pair_and_leave_most_out(spark, monkeypatch):
    from difflib import SequenceMatcher

    import numpy as np

    from panelworks.operators import lineage as L

    rng = np.random.default_rng(11)
    word = lambda n, s: "".join(rng.choice(list(s), rng.integers(0, n)))
    base = [word(16, "abcdefghijklmnopqrst") for _ in range(50)]
    edit = lambda w: "".join(c for c in w if rng.random() > 0.12) + word(3, "xyz")
    a = [(1, w) for w in base] + [(2, word(6, "ab\U0001f600")) for _ in range(40)] + [(1, None), (None, "abc"), (1, ""), (2, "aaaaaaaa")]
    b = [(1, edit(w)) for w in base] + [(2, word(6, "ab\U0001f600")) for _ in range(40)] + [(1, None), (None, "abc"), (1, ""), (2, "aaaaaa"), (2, "")]
    left, right = spark.createDataFrame(a, "k int, a string"), spark.createDataFrame(b, "k int, b string")
    for least, direct in ((0.5, 0), (0.7, 1 << 20), (0.7, 0), (0.8, 0), (0.8, 2000), (0.95, 0)):
        monkeypatch.setattr(L, "DIRECT_PAIRS", direct)
        want = {(k, x, y) for k, x in a for m, y in b if k is not None and k == m and x is not None and y is not None and SequenceMatcher(None, x, y).ratio() >= least}
        assert sorted((r["k"], r["a"], r["b"]) for r in L.scored(left, right, ["k"], "a", "b", least).collect()) == sorted(want)
    names = [f"{x}{y}skolan" for x in ("Berg", "Lund", "Ek", "Sjö", "Kvarn", "Norr", "Vallby", "Ås") for y in ("a", "mo", "torp", "hults", "vik", "backs", "gårds", "dals", "fors", "by")]
    t = spark.createDataFrame([(1, x) for x in names], "k int, a string")
    assert L.candidates(t, t.withColumnRenamed("a", "b"), ["k"], "a", "b", 0.95).count() < len(names) ** 2 / 20


def test_doubly_robust_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.normal(size=60)
    treated = rng.uniform(size=60) < 1 / (1 + np.exp(-x))
    dy = 0.7 * x + 2.0 * treated + rng.normal(size=60) * 0.1
    z = (x - x.mean()) / x.std(ddof=1)
    design, ab = np.column_stack([np.ones(60), z]), np.zeros(2)
    for _ in range(40):  # logit by Newton's steps
        p = 1 / (1 + np.exp(-design @ ab))
        ab += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (treated - p))
    c, w = design[~treated], np.exp(design[~treated] @ ab)
    line = np.linalg.solve(c.T @ (c * w[:, None]), c.T @ (w * dy[~treated]))
    want = (dy[treated] - design[treated] @ line).mean()
    d = spark.createDataFrame([(1, 2, float(v), bool(t), float(k)) for v, t, k in zip(dy, treated, x, strict=True)], "base int, year int, dy double, treated boolean, x double")
    got = E.doubly_robust(d, "year", "x").first()
    assert got["att"] == pytest.approx(want, abs=1e-6) and got["n_treated"] == treated.sum() and abs(want - 2.0) < 0.2


def test_wild_bootstrap_is_exact_for_its_draws(spark):
    s = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 1.5, -0.5, 0.7, 1.1])], "g int, s double")
    got = E.wild_bootstrap(s, "g", "s", 499, 3).first()
    assert got["t_stat"] == pytest.approx(5.8 / math.sqrt(1 + 4 + 2.25 + 0.25 + 0.49 + 1.21)) and got["draws"] == 499
    assert 0.03 < got["p_value"] < 0.2 and E.wild_bootstrap(s.repartition(3), "g", "s", 499, 3).first()["p_value"] == got["p_value"]


def test_weighted_regression_error_and_joint_test_match_dummies(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    data = [(u, y, u // 2, float(rng.normal() + 0.2 * u), float(u < 6 and y >= 3), float((u + y) % 3 == 0), float(rng.integers(1, 5))) for u in range(12) for y in range(6) if (u + y) % 5]
    r, info = E.regression(spark.createDataFrame(data, "u int, year int, g int, y double, d double, e double, w double"), "y", ["d", "e"], ["u", "year"], "g", "w")
    v, n = np.array(data), len(data)
    x = np.column_stack([v[:, 4], v[:, 5], v[:, :1] == np.arange(12), v[:, 1:2] == np.arange(6)])
    w, inverse = v[:, 6], np.linalg.pinv(x.T @ (x * v[:, 6:7]))
    b = inverse @ x.T @ (w * v[:, 3])
    scores = np.array([(x * (w * (v[:, 3] - x @ b))[:, None])[v[:, 2] == g].sum(axis=0) for g in range(6)])
    cov = (inverse @ scores.T @ scores @ inverse * 6 / 5 * (n - 1) / (n - 2))[:2, :2]
    assert [k["coef"] for k in r] == pytest.approx(list(b[:2]), abs=1e-6) and [k["se"] for k in r] == pytest.approx(list(np.sqrt(np.diag(cov))), abs=1e-6)
    assert E.wald(info["b"], info["V"]) == pytest.approx(b[:2] @ np.linalg.inv(cov) @ b[:2], rel=1e-5) and info["clusters"] == 6 and info["n"] == n


def test_lineage_links_need_one_place_one_best_and_shared_grades(spark):
    from panelworks.operators import lineage as L

    units = [(1, "Sånnaskolan M", True, [7, 8], "p"), (2, "Sånnaskolan LM", False, [8, 9], "p"), (3, "Hagaskolan", False, [8], "p"),
             (4, "Bergskolan", True, [1, 2], "q"), (5, "Bergskolan", False, [7, 8], "q"), (6, "Lundskolan enhet 1", True, [1], "r"), (7, "Lundskolan enhet 2", False, [1], "r"),
             (8, "Ekskolan", True, None, "s"), (9, "Ekskolan", False, [3], "s"), (10, "Alskolan", True, [1], "t"), (11, "Alskolan", False, [1], "t"), (12, "Alskolan", False, [1], "t"),
             (13, "Holmskolan", True, [1], None), (14, "Holmskolan", False, [1], None)]
    df = spark.createDataFrame(units, "code int, name string, retired boolean, grades array<int>, place string")
    assert rows(L.lineage_links(df, ["place"])) == [(1, 2, 1.0), (8, 9, 1.0)]  # q: disjoint grades, r: numbered siblings, t: a tie


def test_similarity_and_its_bound(spark):
    from difflib import SequenceMatcher

    import numpy as np

    from panelworks.functions.text import similarity, similarity_bound

    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abå\U0001f600 "), rng.integers(0, 9)))
    data = [(word(), word()) for _ in range(120)] + [("abcd", "bcde"), ("", ""), (None, "a"), ("a", None)]
    df = spark.createDataFrame(data, "a string, b string").select("a", "b", similarity("a", "b").alias("s"), similarity_bound(F.col("a"), F.col("b")).alias("most"))
    for a, b, s, most in df.collect():
        if a is None or b is None:
            assert s is None
        else:
            assert s == SequenceMatcher(None, a, b).ratio() <= most + 1e-12


def test_many_groups_share_a_call(spark):
    from panelworks.operators import tables as T

    rows = [(k, i, "", float((k * 7 + i * i) % 11)) for k in range(300) for i in range(1 + k % 4)] + [(None, i, "", 2.0 * i) for i in range(3)]
    calls = spark.sparkContext.accumulator(0)
    fit = T.trend("y")

    def counted(g):
        calls.add(1)
        return fit(g)

    df = spark.createDataFrame(rows, "k long, o long, o_orderdate string, y double")
    got = {(r["k"], r["o"]): r["trend"] for r in T.group_apply(df, ["k"], ["o_orderdate", "o"], counted, "k long, o long, trend double").collect()}
    assert len(got) == len(rows) and calls.value <= 3
    for k in {r[0] for r in rows}:
        y = [v for g, _, _, v in rows if g == k]
        mean, mid = sum(y) / len(y), (len(y) - 1) / 2
        spread = sum((i - mid) ** 2 for i in range(len(y)))
        slope = sum((i - mid) * (v - mean) for i, v in enumerate(y)) / spread if spread else 0.0
        assert [got[k, i] for i in range(len(y))] == [pytest.approx(mean + slope * (i - mid)) for i in range(len(y))]
