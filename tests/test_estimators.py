"""Absorption, models by cutoff and inference by draws against numpy on small panels."""

from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.operators import estimate as E


def panel(n_units=24, years=6, seed=1, missing=0.15):
    rnd = random.Random(seed)
    rows = []
    for u in range(n_units):
        first = rnd.choice([2001, 2002, 2004, None, None])
        for k in range(years):
            if rnd.random() < missing:
                continue
            year = 2000 + k
            d = float(first is not None and year >= first)
            a = rnd.choice("pqr") if rnd.random() > 0.1 else None
            x = rnd.gauss(u % 3, 1)
            rows.append((u, year, a, f"s{u % 5}", x, d, d * (u % 2), rnd.gauss(d * 2 + u * 0.3 + k * 0.5 + x * k * 0.2 + (len(a or "") * 0.7), 1), rnd.uniform(0.5, 3), first))
    return rows


COLS = "unit int, year int, a string, site string, x double, d double, dz double, y double, w double, first int"


def dummies(rows, factors, slopes, terms, weights):
    names = COLS.replace(",", "").split()[::2]
    at = {n: k for k, n in enumerate(names)}
    design = [[r[at[t]] for r in rows] for t in terms]
    for f in factors:
        design += [[float(r[at[f]] == v) for r in rows] for v in {r[at[f]] for r in rows}]
    for f, x in slopes:
        design += [[float(r[at[f]] == v) for r in rows] for v in {r[at[f]] for r in rows}]
        design += [[r[at[x]] * (r[at[f]] == v) for r in rows] for v in {r[at[f]] for r in rows}]
    w = np.sqrt([r[at["w"]] if weights else 1.0 for r in rows])
    m, y = np.array(design).T * w[:, None], np.array([r[at["y"]] for r in rows]) * w
    return np.linalg.lstsq(m, y, rcond=None)[0][:len(terms)]


@pytest.mark.parametrize("factors", [list(p) for p in itertools.permutations(["year", "a", "unit"])][::2] + [["unit", "year", "a", "site"]])
def test_absorption_equals_dummies_in_any_order(spark, factors):
    rows = panel()
    got, _ = E.regression(spark.createDataFrame(rows, COLS), "y", ["d", "dz"], factors, "unit", "w")
    assert [r["coef"] for r in got] == pytest.approx(list(dummies(rows, factors, [], ["d", "dz"], True)), abs=1e-6)


def test_absorbed_slopes_equal_dummies(spark):
    rows = panel(seed=3)
    df = spark.createDataFrame(rows, COLS)
    for factors, slopes, weight in ((["unit", "year"], [("year", "x")], "w"), (["unit", "year", "a"], [("year", "x")], None), (["unit"], [("year", "x"), ("a", "x")], None)):
        got, info = E.regression(df, "y", ["d"], factors, "site", weight, slopes)
        assert got[0]["coef"] == pytest.approx(dummies(rows, factors, slopes, ["d"], weight)[0], abs=1e-6) and info["n"] == len(rows)


def test_factors_take_turns_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(E, "DIRECT", 0)
    rows = panel(n_units=6, years=4, missing=0.0, seed=4)[:-1]
    got, _ = E.regression(spark.createDataFrame(rows, COLS), "y", ["d"], ["year", "unit"], "unit", "w", [("year", "x")])
    assert got[0]["coef"] == pytest.approx(dummies(rows, ["year", "unit"], [("year", "x")], ["d"], True)[0], abs=1e-6)


def test_absorption_of_odd_rows(spark):
    rows = panel(seed=5)
    odd = [(*rows[0][:7], None, *rows[0][8:]), (*rows[1][:8], 0.0, None), (*rows[2][:8], None, None)]
    df = spark.createDataFrame(rows + odd, COLS)
    plain, _ = E.regression(spark.createDataFrame(rows, COLS), "y", ["d"], ["unit", "a"], "unit", "w")
    got, info = E.regression(df, "y", ["d"], ["unit", "a"], "unit", "w")
    assert got == [pytest.approx(r) for r in plain] and info["n"] == len(rows)
    d = E.demeaned(df.select("unit", "y"), ["y"], ["unit"])
    assert d.count() == len(rows) + 2 and max(abs(r[0]) for r in d.groupBy("unit").agg(F.avg("y")).select("avg(y)").collect()) < 1e-9


def test_models_share_one_absorption(spark):
    df = spark.createDataFrame(panel(seed=7), COLS).withColumn("far", F.col("d") - F.col("dz"))
    both = E.models(df, "y", {"one": ["d"], "two": ["dz", "far"]}, ["unit", "year"], "unit")
    for name, xs in (("one", ["d"]), ("two", ["dz", "far"])):
        alone, info = E.regression(df, "y", xs, ["unit", "year"], "unit")
        assert [(r["coef"], r["se"]) for r in both[name][0]] == [pytest.approx((r["coef"], r["se"])) for r in alone]
    rows, info = both["two"]
    v = info["V"]
    assert E.equal_terms(info["b"], v) == pytest.approx((rows[0]["coef"] - rows[1]["coef"]) ** 2 / (v[0, 0] + v[1, 1] - 2 * v[0, 1]))


def slow_att(y, first):
    """Overall effect from outcomes {(unit, year): y} and first years {unit: year or None}."""
    years = sorted({t for _, t in y})
    total, weight = 0.0, 0
    for i, j in itertools.combinations(years, 2):
        change = {u: y[u, j] - y[u, i] for u in first if (u, i) in y and (u, j) in y}
        t, c = [v for u, v in change.items() if first[u] == i + 1], [v for u, v in change.items() if first[u] is None or first[u] > j]
        if t and c:
            total, weight = total + len(t) * (sum(t) / len(t) - sum(c) / len(c)), weight + len(t)
    return total / weight


def test_randomized_effects_against_every_draw(spark):
    rows = panel(seed=9)
    df = spark.createDataFrame(rows, COLS)
    y, first = {(r[0], r[1]): r[7] for r in rows}, {r[0]: r[9] for r in rows}
    units = spark.createDataFrame(list(first.items()), "unit int, first int")
    drawn = {}
    for r in E.permuted_first(units, "unit", "first", 12, 4).collect():
        drawn.setdefault(r["draw"], {})[r["unit"]] = r["first"]
    assert len(drawn) == 12 and all(sorted(map(str, d.values())) == sorted(map(str, first.values())) for d in drawn.values())
    assert len({tuple(sorted(d.items(), key=str)) for d in drawn.values()}) == 12
    for parts in (1, 5):
        got = {r["draw"]: r["att"] for r in E.randomized_effects(df.repartition(parts), "unit", "year", "y", "first", 12, 4, block=7).collect()}
        assert got == pytest.approx({0: slow_att(y, first)} | {k: slow_att(y, d) for k, d in drawn.items()})
    again = E.changes(df, "unit", "year", "y", "first")
    assert E.overall(E.group_time(again, "year")).first()["att"] == pytest.approx(slow_att(y, first))


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_draws_are_permutations(n):
    seen = [tuple(E.shuffled(np.arange(n), n, k, 3).tolist()) for k in range(1, 30)]
    assert all(sorted(s) == list(range(n)) for s in seen) and (n < 64 or len(set(seen)) == 29)
    if n == 64:  # no place is favoured
        places = np.array([E.shuffled(np.arange(n), n, k, 3)[0] for k in range(1, 4001)])
        assert np.bincount(places, minlength=n).max() < 110 and np.bincount(places, minlength=n).min() > 25


def test_effects_by_key_have_errors_by_key(spark):
    rows = panel(seed=11, n_units=40)
    df = spark.createDataFrame(rows, COLS)
    both = df.withColumn("m", F.explode(F.array(F.lit(1), F.lit(2)))).where("m = 1 or unit % 2 = 0 or first is null")
    got = {r["m"]: (r["att"], r["se"], r["n_clusters"]) for r in E.att_error(E.changes(both, "unit", "year", "y", "first", ["m"]), "year", "unit", ["m"]).collect()}
    for m, part in ((1, df), (2, df.where("unit % 2 = 0 or first is null"))):
        alone = E.att_error(E.changes(part, "unit", "year", "y", "first"), "year", "unit").first()
        assert got[m] == pytest.approx((alone["att"], alone["se"], alone["n_clusters"]))


def test_wild_bootstrap_against_numpy(spark):
    rnd = random.Random(2)
    scores = [(f"c{k}", rnd.gauss(0.4, 1)) for k in range(25)]
    runs = [E.wild_bootstrap(spark.createDataFrame(scores, "c string, s double").repartition(parts), "c", "s", 1999, 8, block=6).first() for parts in (1, 4)]
    assert runs[0]["p_value"] == runs[1]["p_value"] and runs[0]["draws"] == 1999 and runs[0]["t_stat"] == pytest.approx(runs[1]["t_stat"])
    s = np.array([x for _, x in scores])
    assert runs[0]["t_stat"] == pytest.approx(abs(s.sum()) / math.sqrt((s * s).sum()))
    w = np.array(E.WEBB)[np.random.default_rng(zlib.crc32(b"w")).integers(0, 6, (40_000, 25))]
    t = np.abs((w * s).sum(1)) / np.sqrt(((w * s) ** 2).sum(1))
    assert runs[0]["p_value"] == pytest.approx((t >= runs[0]["t_stat"]).mean(), abs=0.035)
