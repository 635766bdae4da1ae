"""Reports and checks of annotation, and rules of windows and duplicates, on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.functions.columns import norm_entity
from panelworks.operators import aggregate as A
from panelworks.operators import annotate as B
from panelworks.operators import spatial as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_import_verdicts_give_the_first_reason(spark):
    good = [("good", "b1", "r1", t) for t in (1, 2, 2)]
    files = good + [("mixed", "b1", "r1", 1), ("mixed", "b2", "r2", 9), ("two", "b1", "r1", 1), ("two", "b1", None, 1), ("strange", "b1", "r1", 77), ("strange", "b1", "r1", 78), ("old", "b1", "r1", 1), ("null", None, "r1", 1)]
    f = spark.createDataFrame(files, "file string, batch string, reviewer string, task int")
    v = B.import_verdicts(f, spark.createDataFrame([("b1", 1), ("b1", 2), ("b2", 1)], "batch string, task int"), spark.createDataFrame([("old", 2), ("good", 3)], "file string, n long"))
    assert rows(v) == [("good", 3, 1, 1, 0, "accepted"), ("mixed", 2, 2, 2, 1, "batches"), ("null", 1, 1, 1, 1, "unknown tasks"), ("old", 1, 1, 1, 0, "fewer than stored"), ("strange", 2, 1, 1, 2, "unknown tasks"), ("two", 2, 1, 2, 0, "reviewers")]
    assert rows(B.accepted(f, v)) == sorted(good)


def test_validation_report_by_aid(spark):
    data = [("m", "side", 1, 1, 10, True, None), ("m", "side", 1, -1, 10, True, False), ("m", "side", -1, -1, 11, False, True), ("m", "conflict", None, 1, 12, True, False), ("m", "side", None, 1, 13, False, False), ("q", "centre", None, 1, 14, False, False)]
    df = spark.createDataFrame(data, "method string, decision string, manual_sign int, barrier_sign int, task int, street boolean, infrared boolean")
    got = {(r["method"], r["aid"]): (r["n"], r["n_sided"], r["n_walls"], r["agree"], r["share"]) for r in B.validation_report(df, ["street", "infrared"]).collect()}
    assert got == {("m", "all"): (5, 3, 2, 2, 0.667), ("m", "street"): (3, 2, 1, 1, 0.5), ("m", "infrared"): (1, 1, 1, 1, 1.0), ("q", "all"): (1, 0, 0, 0, None)}


def test_double_coding(spark):
    kind = "task int, reviewer string, category string, lat_m double"
    data = [(1, "a", "left", 3.0), (1, "b", "left", 5.0), (2, "a", "left", 4.0), (2, "b", "right", -4.0), (3, "a", "centre", 0.0), (3, "b", "centre", 0.5), (4, "a", "left", 9.0), (5, "a", "right", -7.0), (5, "b", "right", -8.0), (5, "c", "right", None)]
    got = B.double_coding(spark.createDataFrame(data, kind)).first()
    pairs = [("left", "left"), ("left", "right"), ("centre", "centre")] + [("right", "right")] * 3
    same, n = sum(a == b for a, b in pairs) / 6, 6
    chance = sum(sum(a == c for a, _ in pairs) / n * sum(b == c for _, b in pairs) / n for c in ("left", "right", "centre"))
    assert (got["n"], got["share_same"], got["kappa"], got["median_diff"]) == (6, round(same, 3), round((same - chance) / (1 - chance), 3), 1.5)
    none = B.double_coding(spark.createDataFrame([(1, "a", "left", 1.0)], kind)).first()
    assert tuple(none) == (0, None, None, None)


def test_current_row_else_the_latest(spark):
    df = spark.createDataFrame([(1, 5, False, "x"), (1, 3, True, "y"), (2, 1, None, "p"), (2, 2, False, "q"), (3, 1, True, "u"), (3, 4, True, "v")], "k int, at int, open boolean, v string")
    assert rows(A.current_or_latest(df, ["k"], F.col("open"), [F.col("at")]).select("k", "v")) == [(1, "y"), (2, "q"), (3, "v")]


def test_gaps_changes_and_groups(spark):
    r = spark.createDataFrame([("l", 0.0, 4.0), ("l", 5.0, 9.0), ("l", 8.0, 10.0)], "link string, a double, b double")
    assert [x["gap"] for x in A.gap_to_previous(r, "link", "a", "b", "gap").orderBy("a").collect()] == [None, 1.0, -1.0]
    y = spark.createDataFrame([(1, 2000, 5.0), (1, 2001, 7.0), (1, 2003, 1.0)], "u int, year int, v double")
    assert rows(A.yearly_changes(y, ["u"], "year", "v", "c")) == [(1, 2001, 2.0)]
    q = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "x double").select("x", A.quantile_group(F.col("x"), F.array(F.lit(1.0), F.lit(2.0)), 3).alias("g"))
    assert sorted((r["x"] or 0, r["g"]) for r in q.collect() if r["x"]) == [(1, 1), (2, 2), (2, 2), (3, 3)] and q.where("x is null").first()["g"] is None


def test_sides_by_label_and_cells_by_flag(spark):
    df = spark.createDataFrame([(1, 1, "N"), (1, -1, "S"), (-1, 0, "E"), (1, None, " "), (0, -1, "S"), (None, None, None)], "seen int, told int, label string")
    m, s, c = S.side_check(F.col("seen"), F.col("told"), F.col("label"))
    assert [tuple(r) for r in df.select(m, s, c).collect()] == [("geometric_offset", 1, "agrees"), ("geometric_offset", 1, "disagrees"), ("geometric_offset", -1, "undecided"), ("geometric_offset", 1, None), ("label", -1, None), ("unknown", 0, None)]
    cells, table = spark.createDataFrame([("a",), ("b",)], "cell string"), spark.createDataFrame([("a", 1, None)], "cell string, p int, q int")
    assert rows(S.flagged(cells, table, "cell", ["p", "q"])) == [("a", 1, 0), ("b", 0, 0)]


def test_equal_geometries_go_by_precedence(spark):
    def line(k, status, *pts):
        return [(k, status, i, *a, *b) for i, (a, b) in enumerate(zip(pts, pts[1:]))]

    a, b = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 1.0))
    data = line(4, "built", *a) + line(2, "built", *a) + line(3, "proposed", *a) + line(5, "proposed", *b) + line(6, "proposed", *b) + line(7, "built", *a[::-1])
    df = spark.createDataFrame(data, "line int, status string, seq int, x1 double, y1 double, x2 double, y2 double").repartition(3)
    assert rows(S.without_duplicates(df, "line", "status", "built")) == [(2, "built"), (5, "proposed"), (6, "proposed"), (7, "built")]


def test_names_of_entities_by_words(spark):
    names = {"Norra skolan F-9": "norra skolan", "Norra Skolan, enhet 2": "norra skolan", "Norra skolan åk 7 – 9": "norra skolan", "Norra-skolan (LM)": "norra skolan", "Norra grundsärskolan": "norra", "Norra anpassad grundskola": "norra", "Anpassad verksamhet": "anpassad verksamhet", "Enhet Nord": "enhet nord", "3:e skolan": "e skolan", "F7-9 Öster": "öster", "": "", "Halm": "halm"}
    df = spark.createDataFrame([(k,) for k in names] + [(None,)], "n string").select("n", norm_entity(F.col("n")).alias("s"))
    got = {r["n"]: r["s"] for r in df.collect()}
    assert got.pop(None) is None
    assert got == names | {"Norra skolan F-9": got["Norra skolan F-9"]}
