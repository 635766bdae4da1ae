"""Queries over panel estimators (E operators). Unit: customer; outcome: mean order price of a year; treatment: first urgent order above 200,000."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelworks.operators import aggregate as A
from panelworks.operators import estimate as E
from panelworks.plans.q_aggregate import FT, first_treat
from panelworks.plans.registry import query
from panelworks.session import saved
from panelworks.session import table as t

PANEL = f"(SELECT u.*, CAST(g AS INTEGER) AS first FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) / 1000 AS y, count(*) AS n FROM orders GROUP BY 1, 2) u LEFT JOIN ({FT}) f USING (o_custkey))"
DY = f"(SELECT b.o_custkey, a.year AS base, b.year, b.y - a.y AS dy, coalesce(b.first = a.year + 1, false) AS treated, b.first IS NULL OR b.first > b.year AS control FROM {PANEL} a JOIN {PANEL} b ON a.o_custkey = b.o_custkey AND b.year > a.year)"
CELLS = f"(SELECT CAST(base + 1 AS INTEGER) AS cohort, year, avg(dy) FILTER (WHERE treated) - avg(dy) FILTER (WHERE control AND NOT treated) AS att, count(*) FILTER (WHERE treated) AS n_treated, count(*) FILTER (WHERE control AND NOT treated) AS n_control FROM {DY} GROUP BY 1, 2 HAVING count(*) FILTER (WHERE treated) > 0 AND count(*) FILTER (WHERE control AND NOT treated) > 0)"


def panel(spark, d):
    o = t(spark, d, "orders")
    u = o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg((F.avg("o_totalprice") / 1000).alias("y"), F.count(F.lit(1)).alias("n"))
    return u.join(first_treat(spark, d).withColumnRenamed("g", "first"), "o_custkey", "left")


def dy(spark, d):
    return E.changes(panel(spark, d), "o_custkey", "year", "y", "first")


def small(spark, rows):
    """A result of a few numbers as a table."""
    return spark.createDataFrame(rows)


@query("e01_collapse", "SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS y, sum(l_quantity) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def e01(spark, d):
    li = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * F.col("l_quantity")).alias("a"), F.sum("l_quantity").alias("w"))
    return t(spark, d, "orders").join(li, "o_orderkey").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("a") / F.sum("w"), 6).alias("y"), F.sum("w").alias("weight"))


@query("e02_group_time_att", f"SELECT cohort, year, round(att, 6) AS att, n_treated, n_control FROM {CELLS}")
def e02(spark, d):
    return E.group_time(dy(spark, d), "year").withColumn("att", F.round("att", 6))


NEVER = CELLS.replace("control AND NOT treated", "f IS NULL").replace("FROM (SELECT b.o_custkey", "FROM (SELECT b.first AS f, b.o_custkey")
SHARES = "round(sum(att * n_treated) / sum(n_treated), 6), CAST(sum(n_treated) AS BIGINT)"


@query("e03_overall_att", f"""SELECT 'overall' AS kind, NULL AS level, round(sum(att * n_treated) / sum(n_treated), 6) AS att, CAST(sum(n_treated) AS BIGINT) AS n_treated FROM {CELLS} UNION ALL SELECT 'event', year - cohort, {SHARES} FROM {CELLS} GROUP BY 2 UNION ALL SELECT 'cohort', cohort, {SHARES} FROM {CELLS} GROUP BY 2
  UNION ALL SELECT 'never overall', NULL, {SHARES} FROM {NEVER} UNION ALL SELECT 'never event', year - cohort, {SHARES} FROM {NEVER} GROUP BY 2""")
def e03(spark, d):
    changes = dy(spark, d)
    never = E.changes(panel(spark, d).withColumn("f", F.col("first")), "o_custkey", "year", "y", "first", carry=["f"])
    out = []
    for name, cells in (("", E.group_time(changes, "year")), ("never ", E.group_time(never, "year", never_only=F.col("f").isNull()))):
        cells = saved(cells, "cells")
        out.append(E.overall(cells).select(F.lit(f"{name}overall").alias("kind"), F.lit(None).cast("int").alias("level"), "att", "n_treated"))
        out.append(E.overall(cells, [(F.col("year") - F.col("cohort")).alias("level")]).select(F.lit(f"{name}event").alias("kind"), "level", "att", "n_treated"))
        if not name:
            out.append(E.overall(cells, [F.col("cohort").alias("level")]).select(F.lit("cohort").alias("kind"), "level", "att", "n_treated"))
    return reduce(lambda a, b: a.unionByName(b), out).withColumn("att", F.round("att", 6))


@query("e04_att_error", f"""WITH d AS {DY}, c AS (SELECT base, year, avg(dy) FILTER (WHERE treated) AS mt, avg(dy) FILTER (WHERE control AND NOT treated) AS mc, count(*) FILTER (WHERE treated) AS nt, count(*) FILTER (WHERE control AND NOT treated) AS nc FROM d GROUP BY 1, 2 HAVING nt > 0 AND nc > 0),
  g AS (SELECT sum(nt) AS n, sum((mt - mc) * nt) / sum(nt) AS att FROM c), p AS (SELECT o_custkey, sum(nt / n * CASE WHEN treated THEN (dy - mt) / nt ELSE -(dy - mc) / nc END) AS s FROM d JOIN c USING (base, year), g WHERE treated OR control GROUP BY 1) SELECT round(max(att), 6) AS att, round(sqrt(sum(s * s)), 6) AS se, count(*) AS n_clusters FROM p, g""")
def e04(spark, d):
    return E.att_error(dy(spark, d), "year", "o_custkey").select(F.round("att", 6).alias("att"), F.round("se", 6).alias("se"), "n_clusters")


@query("e05_doubly_robust")
def e05(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("x"))
    ch = E.changes(panel(spark, d).join(c, "o_custkey"), "o_custkey", "year", "y", "first", carry=["x"])
    return E.doubly_robust(ch, "year", "x").withColumn("att", F.round("att", 6))


def balanced(spark, d):
    p = panel(spark, d).withColumn("d", F.coalesce(F.col("year") >= F.col("first"), F.lit(False)).cast("double"))
    full = p.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c")).where("c = 7").select("o_custkey")
    return p.join(full, "o_custkey")


BALANCED = f"(SELECT p.*, CASE WHEN year >= first THEN 1.0::DOUBLE ELSE 0 END AS d, c_nationkey AS site, CASE WHEN c_acctbal > 5000 THEN 1.0::DOUBLE ELSE 0 END AS rich FROM {PANEL} p JOIN customer ON c_custkey = o_custkey WHERE o_custkey IN (SELECT o_custkey FROM {PANEL} GROUP BY 1 HAVING count(*) = 7))"


def inside(*cols):
    """SQL that takes unit and year means out of columns of a balanced panel."""
    return ", ".join(f"{c} - avg({c}) OVER (PARTITION BY o_custkey) - avg({c}) OVER (PARTITION BY year) + avg({c}) OVER () AS {c}" for c in cols)


def inside_rich(*cols):
    """The same with each year's slope of ``rich`` taken out as well: it is 0 or 1 and a unit's own, so these are means by year and kind."""
    return ", ".join(f"{c} - avg({c}) OVER (PARTITION BY o_custkey) - avg({c}) OVER (PARTITION BY year, rich) + avg({c}) OVER (PARTITION BY rich) AS {c}" for c in cols)


@query("e06_two_way_fixed_effects", f"""WITH p AS {BALANCED}, q AS (SELECT *, d * rich AS dr, rich * (year - 1998) AS slope FROM p), r AS (SELECT {inside("y", "d", "dr", "slope")} FROM q),
  m AS (SELECT sum(d * d) AS dd, sum(d * dr) AS de, sum(dr * dr) AS ee, sum(d * y) AS dy, sum(dr * y) AS ey, sum(slope * slope) AS ss, sum(d * slope) AS ds, sum(slope * y) AS sy, count(*) AS n FROM r)
  SELECT 'plain' AS model, 'd' AS term, round(dy / dd, 5) AS coef, n FROM m UNION ALL SELECT 'interaction', 'd', round((ee * dy - de * ey) / (dd * ee - de * de), 5), n FROM m UNION ALL SELECT 'interaction', 'd_rich', round((dd * ey - de * dy) / (dd * ee - de * de), 5), n FROM m
  UNION ALL SELECT 'absorbed slopes', 'd', (SELECT round(sum(d * y) / sum(d * d), 5) FROM (SELECT {inside_rich("y", "d")} FROM q)), n FROM m
  UNION ALL SELECT 'slope by year', 'd', round((ss * dy - ds * sy) / (dd * ss - ds * ds), 5), n FROM m UNION ALL SELECT 'slope by year', 'rich_trend', round((dd * sy - ds * dy) / (dd * ss - ds * ds), 5), n FROM m""")
def e06(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 5000).cast("double").alias("rich"))
    p = saved(balanced(spark, d).join(c, "o_custkey").withColumns({"d_rich": F.col("d") * F.col("rich"), "rich_trend": F.col("rich") * (F.col("year") - 1998)}), "balanced")
    out = []
    found = E.models(p, "y", {"plain": ["d"], "interaction": ["d", "d_rich"], "slope by year": ["d", "rich_trend"]}, ["o_custkey", "year"], "o_custkey")
    found |= E.models(p, "y", {"absorbed slopes": ["d"]}, ["o_custkey", "year"], "o_custkey", slopes=[("year", "rich")])
    for model, (rows, info) in found.items():
        out += [{"model": model, "term": r["term"], "coef": round(r["coef"], 5), "n": info["n"]} for r in rows]
    return small(spark, out)


@query("e07_clustered_covariance", f"""WITH p AS {BALANCED}, r AS (SELECT site, {inside("y", "d")} FROM p), b AS (SELECT sum(d * y) / sum(d * d) AS b, sum(d * d) AS dd, count(*) AS n FROM r), s AS (SELECT site, sum(r.d * (r.y - b.b * r.d)) AS s FROM r, b GROUP BY 1)
  SELECT 'd' AS term, round(max(b), 5) AS coef, round(sqrt(sum(s * s) / pow(max(dd), 2) * (count(*) / (count(*) - 1))), 5) AS se, count(*) AS clusters FROM s, b""")
def e07(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows, info = E.regression(balanced(spark, d).join(c, "o_custkey"), "y", ["d"], ["o_custkey", "year"], "c_nationkey")
    return small(spark, [{"term": r["term"], "coef": round(r["coef"], 5), "se": round(r["se"], 5), "clusters": info["clusters"]} for r in rows])


@query("e08_event_study")
def e08(spark, d):
    k = F.col("year") - F.col("first")
    leads, lags = [-4, -3, -2], [0, 1, 2, 3]
    terms = {f"lead_{-v}": (k <= v) if v == leads[0] else (k == v) for v in leads} | {f"lag_{v}": (k >= v) if v == lags[-1] else (k == v) for v in lags}
    p = balanced(spark, d).select("o_custkey", "year", "y", *[F.coalesce(c, F.lit(False)).cast("double").alias(n) for n, c in terms.items()])
    rows, info = E.regression(p, "y", list(terms), ["o_custkey", "year"], "o_custkey")
    joint = E.wald(info["b"][:3], info["V"][:3, :3])
    return small(spark, [{"term": r["term"], "coef": round(r["coef"], 5), "se": round(r["se"], 5), "joint_leads": round(joint, 5)} for r in rows])


@query("e09_randomization_inference")
def e09(spark, d):
    att = saved(E.randomized_effects(panel(spark, d), "o_custkey", "year", "y", "first", 1999, 5), "draws")
    own = att.where("draw = 0").select(F.abs("att").alias("own"))
    at_least = F.count_if(F.abs("att") >= F.col("own") * (1 - 1e-9))
    return att.where("draw > 0").crossJoin(F.broadcast(own)).groupBy(F.round("own", 6).alias("abs_att")).agg(((at_least + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("draws"))


@query("e10_wild_bootstrap")
def e10(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    p = E.demeaned(balanced(spark, d).join(c, "o_custkey").select("o_custkey", "year", "c_nationkey", "y", "d"), ["y", "d"], ["o_custkey", "year"])
    scores = p.groupBy("c_nationkey").agg(F.sum(F.col("d") * F.col("y")).alias("s"))
    return E.wild_bootstrap(scores, "c_nationkey", "s", 9999, 3).select(F.round("t_stat", 6).alias("t_stat"), "p_value", "draws")


@query("e11_leave_one_out", f"""WITH x AS (SELECT p.*, c_nationkey // 5 AS part FROM {PANEL} p JOIN customer ON c_custkey = o_custkey), d AS (SELECT k.part AS dropped, b.o_custkey, a.year AS base, b.year, b.y - a.y AS dy, coalesce(b.first = a.year + 1, false) AS treated, b.first IS NULL OR b.first > b.year AS control FROM (SELECT DISTINCT part FROM x) k JOIN x a ON a.part <> k.part JOIN x b ON a.o_custkey = b.o_custkey AND b.year > a.year),
  c AS (SELECT dropped, base, year, avg(dy) FILTER (WHERE treated) - avg(dy) FILTER (WHERE control AND NOT treated) AS att, count(*) FILTER (WHERE treated) AS nt FROM d GROUP BY ALL HAVING nt > 0 AND count(*) FILTER (WHERE control AND NOT treated) > 0) SELECT CAST(dropped AS BIGINT) AS dropped, round(sum(att * nt) / sum(nt), 6) AS att FROM c GROUP BY 1""")
def e11(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.floor(F.col("c_nationkey") / 5).alias("part"))
    ch = E.changes(panel(spark, d).join(c, "o_custkey"), "o_custkey", "year", "y", "first", carry=["part"])
    # moments by part first: leaving a part out is then the total less its own, not one more pass over the rows
    t_, c_ = F.when(F.col("treated"), F.col("dy")), F.when(F.col("control") & ~F.col("treated"), F.col("dy"))
    m = saved(ch.groupBy("part", "base", "year").agg(F.sum(t_).alias("st"), F.count(t_).alias("nt"), F.sum(c_).alias("sc"), F.count(c_).alias("nc")), "moments")
    drop = m.select(F.col("part").alias("dropped")).distinct()
    cells = m.crossJoin(F.broadcast(drop)).where("part <> dropped").groupBy("dropped", "base", "year").agg(*[F.sum(x).alias(x) for x in ("st", "nt", "sc", "nc")]).where("nt > 0 and nc > 0")
    att = F.col("st") / F.col("nt") - F.col("sc") / F.col("nc")
    return cells.groupBy("dropped").agg(F.round(F.sum(att * F.col("nt")) / F.sum("nt"), 6).alias("att"))


SPLITS = [("cutoff", str(c), f"c_acctbal <= {c}", "true") for c in (0, 2000, 4000, 6000)] + [("bin", f"{a}-{a + 2500}", f"c_acctbal > {a} AND c_acctbal <= {a + 2500}", f"c_acctbal > {a} AND c_acctbal <= {a + 2500} OR c_acctbal > 7500") for a in (0, 2500, 5000)] + [
    ("type", k, "c_acctbal <= 4000", f"c_mktsegment = '{k}'") for k in ("AUTOMOBILE", "BUILDING", "MACHINERY")] + [("baseline", k, "c_acctbal <= 4000", f"{c} (base > 200)") for k, c in (("high", ""), ("low", "NOT"))]


@query("e12_cutoff_sweep", f"WITH p AS (SELECT *, arg_min(y, year) OVER (PARTITION BY o_custkey) AS base FROM {PANEL} JOIN customer ON c_custkey = o_custkey) " + " UNION ALL ".join(f"SELECT '{k}' AS split, '{v}' AS level, count(*) FILTER (WHERE {near}) AS n_near, round(avg(y) FILTER (WHERE {near}) - avg(y) FILTER (WHERE NOT ({near})), 6) AS diff FROM p WHERE {rows}" for k, v, near, rows in SPLITS))
def e12(spark, d):
    """Near minus far by cutoff, by bin against the farthest, by type, and by the level at the start: one pass over the panel."""
    p = panel(spark, d)
    base = p.groupBy("o_custkey").agg(F.min_by("y", "year").alias("base"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    return E.splits(p.join(base, "o_custkey").join(c, "o_custkey"), "y", SPLITS).withColumn("diff", F.round("diff", 6))


CUTOFFS = (1000, 3000, 5000, 7000)


def _cutoff_sql(m):
    return f"""SELECT CAST({m} AS INTEGER) AS cutoff, n_near, round((ff * ny - nf * fy) / det, 5) AS near, round((nn * fy - nf * ny) / det, 5) AS far, round(sqrt(v11), 5) AS near_se, round(sqrt(v22), 5) AS far_se, round(((ff * ny - nf * fy) / det - (nn * fy - nf * ny) / det) ** 2 / (v11 + v22 - 2 * v12), 4) AS equal FROM (
  SELECT *, c * (ff * ff * s11 - 2 * ff * nf * s12 + nf * nf * s22) / det ** 2 AS v11, c * (nf * nf * s11 - 2 * nn * nf * s12 + nn * nn * s22) / det ** 2 AS v22, c * (-ff * nf * s11 + (ff * nn + nf * nf) * s12 - nf * nn * s22) / det ** 2 AS v12 FROM (
    SELECT any_value(nn) AS nn, any_value(nf) AS nf, any_value(ff) AS ff, any_value(ny) AS ny, any_value(fy) AS fy, any_value(n_near) AS n_near, any_value(nn * ff - nf * nf) AS det, count(*) / (count(*) - 1.0) * any_value((n - 1.0) / (n - 2.0)) AS c, sum(s1 * s1) AS s11, sum(s1 * s2) AS s12, sum(s2 * s2) AS s22 FROM (
      SELECT o_custkey, any_value(nn) AS nn, any_value(nf) AS nf, any_value(ff) AS ff, any_value(ny) AS ny, any_value(fy) AS fy, any_value(n) AS n, any_value(n_near) AS n_near,
        sum(near * (y - near * (ff * ny - nf * fy) / (nn * ff - nf * nf) - far * (nn * fy - nf * ny) / (nn * ff - nf * nf))) AS s1, sum(far * (y - near * (ff * ny - nf * fy) / (nn * ff - nf * nf) - far * (nn * fy - nf * ny) / (nn * ff - nf * nf))) AS s2
      FROM r{m}, (SELECT sum(near * near) AS nn, sum(near * far) AS nf, sum(far * far) AS ff, sum(near * y) AS ny, sum(far * y) AS fy, count(*) AS n FROM r{m}), (SELECT count(DISTINCT o_custkey) AS n_near FROM q WHERE first IS NOT NULL AND c_acctbal <= {m}) GROUP BY o_custkey)))"""


@query("e12_cutoff_models", f"WITH q AS (SELECT b.*, c_acctbal FROM {BALANCED} b JOIN customer ON c_custkey = o_custkey), " + ", ".join(
    f"r{m} AS (SELECT o_custkey, {inside('y', 'near', 'far')} FROM (SELECT o_custkey, year, y, CASE WHEN c_acctbal <= {m} THEN d ELSE 0 END AS near, CASE WHEN c_acctbal <= {m} THEN 0 ELSE d END AS far FROM q))" for m in CUTOFFS) + " " + " UNION ALL ".join(_cutoff_sql(m) for m in CUTOFFS))
def e12_models(spark, d):
    """The effect near and far at every cutoff, clustered by unit, and the test that both are equal: one absorption for all cutoffs."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    p = balanced(spark, d).join(c, "o_custkey")
    p = saved(p.withColumns({f"{k}{m}": F.when((F.col("c_acctbal") <= m) == (k == "near"), F.col("d")).otherwise(0.0) for m in CUTOFFS for k in ("near", "far")}), "cutoffs")
    counts = p.where("first is not null").agg(*[F.count_distinct(F.when(F.col("c_acctbal") <= m, F.col("o_custkey"))) for m in CUTOFFS]).first()
    found = E.models(p, "y", {str(m): [f"near{m}", f"far{m}"] for m in CUTOFFS}, ["o_custkey", "year"], "o_custkey")
    out = []
    for m, n in zip(CUTOFFS, counts, strict=True):
        rows, info = found[str(m)]
        out.append((m, n, *[round(r["coef"], 5) for r in rows], *[round(r["se"], 5) for r in rows], round(E.equal_terms(info["b"], info["V"]), 4)))
    return spark.createDataFrame(out, "cutoff int, n_near long, near double, far double, near_se double, far_se double, equal double")


@query("e12_cutoff_effects", " UNION ALL ".join(f"""SELECT CAST({m} AS INTEGER) AS cutoff, round(sum(att * nt) / sum(nt), 6) AS att, CAST(sum(nt) AS BIGINT) AS n_treated FROM (SELECT base, year, avg(dy) FILTER (WHERE treated) - avg(dy) FILTER (WHERE control AND NOT treated) AS att, count(*) FILTER (WHERE treated) AS nt
  FROM {DY.replace("(SELECT b.o_custkey", "(SELECT b.first AS f, b.o_custkey")} JOIN customer ON c_custkey = o_custkey WHERE f IS NULL OR c_acctbal <= {m} GROUP BY ALL HAVING nt > 0 AND count(*) FILTER (WHERE control AND NOT treated) > 0)""" for m in CUTOFFS))
def e12_effects(spark, d):
    """The group-time effect of the treated up to each cutoff against all never and not yet treated: a unit goes on once for each cutoff that has it."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    p = panel(spark, d).join(c, "o_custkey").withColumn("cutoff", F.explode(F.array(*[F.lit(m) for m in CUTOFFS]))).where("first is null or c_acctbal <= cutoff")
    cells = E.group_time(E.changes(p, "o_custkey", "year", "y", "first", keys=["cutoff"]), "year", ["cutoff"])
    return E.overall(cells, [F.col("cutoff")]).select("cutoff", F.round("att", 6).alias("att"), "n_treated")


@query("e13_within_site", f"""WITH x AS (SELECT c_nationkey AS site, c_acctbal <= 3000 AS near, year >= 1998 AS post, y FROM {PANEL} JOIN customer ON c_custkey = o_custkey), m AS (SELECT site, avg(y) FILTER (WHERE near AND post) - avg(y) FILTER (WHERE near AND NOT post) - avg(y) FILTER (WHERE NOT near AND post) + avg(y) FILTER (WHERE NOT near AND NOT post) AS dd, count(*) AS n FROM x GROUP BY 1 HAVING dd IS NOT NULL)
  SELECT round(sum(dd * n) / sum(n), 6) AS dd, round(sum(dd * n) FILTER (WHERE site % 2 = 0) / sum(n) FILTER (WHERE site % 2 = 0) - sum(dd * n) FILTER (WHERE site % 2 = 1) / sum(n) FILTER (WHERE site % 2 = 1), 6) AS ddd, count(*) AS n_sites FROM m""")
def e13(spark, d):
    x = panel(spark, d).join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("site"), (F.col("c_acctbal") <= 3000).alias("near")), "o_custkey").withColumn("post", F.col("year") >= 1998)
    m = lambda a, b: F.avg(F.when((F.col("near") == a) & (F.col("post") == b), F.col("y")))
    s = x.groupBy("site").agg((m(True, True) - m(True, False) - m(False, True) + m(False, False)).alias("dd"), F.count(F.lit(1)).alias("n")).where("dd is not null")
    part = lambda k: F.sum(F.when(F.col("site") % 2 == k, F.col("dd") * F.col("n"))) / F.sum(F.when(F.col("site") % 2 == k, F.col("n")))
    return s.agg(F.round(F.sum(F.col("dd") * F.col("n")) / F.sum("n"), 6).alias("dd"), F.round(part(0) - part(1), 6).alias("ddd"), F.count(F.lit(1)).alias("n_sites"))


@query("e14_weighting_variants")
def e14(spark, d):
    p = balanced(spark, d)
    z = A.weighted_z_within(p, ["year"], "y", "n", "zw").select("o_custkey", "year", "d", "y", "zw", "n")
    out = []
    for name, y, w in (("plain", "y", None), ("weighted_outcome", "zw", None), ("weighted_fit", "y", "n")):
        rows, info = E.regression(z, y, ["d"], ["o_custkey", "year"], "o_custkey", w)
        out.append({"variant": name, "coef": round(rows[0]["coef"], 5), "se": round(rows[0]["se"], 5), "n": info["n"]})
    return small(spark, out)


@query("e15_window_check", f"SELECT count(*) FILTER (WHERE g < 1996) AS n_before, count(*) FILTER (WHERE g BETWEEN 1996 AND 2000) AS n_inside, count(*) FILTER (WHERE g > 2000) AS n_after FROM ({FT})")
def e15(spark, d):
    g = F.col("g")
    return first_treat(spark, d).agg(F.count_if(g < 1996).alias("n_before"), F.count_if(g.between(1996, 2000)).alias("n_inside"), F.count_if(g > 2000).alias("n_after"))
