"""Queries over roll-ups, windows, sorts and set operations (A, W, T, U and S operators on tables)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from panelworks.functions import columns as C
from panelworks.operators import aggregate as A
from panelworks.operators import joins as J
from panelworks.plans.registry import query
from panelworks.session import table as t

def Y():  # noqa: N802
    return F.year("o_orderdate")


@query("a01_weighted_mean", "SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS wmean FROM lineitem GROUP BY 1")
def a01(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(A.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("wmean"))


@query("a02_length_weighted_rollup", """SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS wmean, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n, count(DISTINCT l_linenumber) AS n_lines, sum(l_quantity) AS total,
  (SELECT min(f) FROM (SELECT l_returnflag AS f, count(*) AS c FROM lineitem i WHERE i.l_suppkey = o.l_suppkey AND year(i.l_shipdate) = year(o.l_shipdate) GROUP BY 1 QUALIFY rank() OVER (ORDER BY c DESC) = 1)) AS modal_flag, max(l_shipdate) AS latest FROM lineitem o GROUP BY l_suppkey, year(l_shipdate)""".replace("(SELECT min(f) FROM (SELECT l_returnflag AS f, count(*) AS c FROM lineitem i WHERE i.l_suppkey = o.l_suppkey AND year(i.l_shipdate) = year(o.l_shipdate) GROUP BY 1 QUALIFY rank() OVER (ORDER BY c DESC) = 1))",
  "CASE WHEN count(*) FILTER (WHERE l_returnflag = 'A') >= count(*) FILTER (WHERE l_returnflag = 'N') AND count(*) FILTER (WHERE l_returnflag = 'A') >= count(*) FILTER (WHERE l_returnflag = 'R') THEN 'A' WHEN count(*) FILTER (WHERE l_returnflag = 'N') >= count(*) FILTER (WHERE l_returnflag = 'R') THEN 'N' ELSE 'R' END"))
def a02(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year"))
    return g.agg(F.round(A.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("wmean"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("n_lines"),
                 F.sum("l_quantity").alias("total"), F.mode("l_returnflag", True).alias("modal_flag"), F.max("l_shipdate").alias("latest"))


@query("a03_count_any_sum", """SELECT c_custkey, count(o_orderkey) AS n, coalesce(bool_or(o_orderpriority = '1-URGENT'), false) AS any_urgent, min(o_orderdate) AS first, max(o_orderdate) AS last, coalesce(round(sum(o_totalprice), 2), 0) AS total
  FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 350000) ON o_custkey = c_custkey GROUP BY 1""")
def a03(spark, d):
    e = t(spark, d, "orders").where("o_totalprice > 350000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t(spark, d, "customer").select("c_custkey").join(e, "c_custkey", "left").fillna({"n": 0, "any_urgent": False, "total": 0.0})


def QUAL():  # noqa: N802
    return {"a": F.col("o_totalprice") > 100000, "b": (F.col("o_totalprice") > 100000) & (F.col("o_orderpriority") == "1-URGENT"), "c": (F.col("o_totalprice") > 300000) & (F.col("o_orderpriority") == "1-URGENT")}


def YEAR_OR_NULL():  # noqa: N802
    return F.when(F.col("o_orderkey") % 5 != 0, Y())


SQL_Y = "CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) END"


def _tier(name, cond):
    return f"CAST(min(CASE WHEN {cond} THEN {SQL_Y} END) AS INTEGER) AS first_{name}, bool_or({cond}) AS ever_{name}, bool_or({cond} AND o_orderkey % 5 = 0) AS unknown_{name}"


TIERS = {"a": "o_totalprice > 100000", "b": "(o_totalprice > 100000 AND o_orderpriority = '1-URGENT')", "c": "(o_totalprice > 300000 AND o_orderpriority = '1-URGENT')"}


@query("a04_first_event", f"SELECT o_custkey, {_tier('b', TIERS['b'])} FROM orders GROUP BY 1")
def a04(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(*A.first_event(YEAR_OR_NULL(), QUAL()["b"], "b"))


@query("a05_tiered_first_event", f"SELECT o_custkey, {', '.join(_tier(k, v) for k, v in TIERS.items())} FROM orders GROUP BY 1")
def a05(spark, d):
    return A.tiered_first_event(t(spark, d, "orders"), ["o_custkey"], YEAR_OR_NULL(), QUAL())


@query("a06_buffer_dose", """SELECT l_suppkey, count(*) FILTER (WHERE l_quantity <= 5) AS n_5, count(*) FILTER (WHERE l_quantity <= 10) AS n_10, count(*) FILTER (WHERE l_quantity <= 25) AS n_25, sum(CASE WHEN l_quantity <= 10 THEN l_linenumber ELSE 0 END)::BIGINT AS len_10, bool_or(l_quantity <= 10) AS ever_10 FROM lineitem GROUP BY 1""")
def a06(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.count_if(q <= r).alias(f"n_{r}") for r in (5, 10, 25)], F.sum(F.when(q <= 10, F.col("l_linenumber")).otherwise(0)).alias("len_10"), F.bool_or(q <= 10).alias("ever_10"))


@query("a07_nearest_and_dating", f"""SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS nearest, arg_min(o_orderkey, (coalesce({SQL_Y}, 9999), o_totalprice, o_orderkey)) AS dating FROM orders GROUP BY 1""")
def a07(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.min_by(k, F.struct("o_totalprice", k)).alias("nearest"), F.min_by(k, F.struct(F.coalesce(YEAR_OR_NULL(), F.lit(9999)), F.col("o_totalprice"), k)).alias("dating"))


@query("a08_pivot", """SELECT o_custkey, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS "F", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS "O", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'X'), 2) AS "X" FROM orders GROUP BY 1""")
def a08(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "X"]).agg(F.round(F.sum("o_totalprice"), 2))


@query("a09_unpivot", "SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def a09(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("p_size"), "p_retailprice")
    return p.unpivot(["p_partkey"], ["p_size", "p_retailprice"], "name", "value").where("value is not null")


@query("a10_last_in_period", "SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last FROM orders WHERE o_totalprice > 50000 GROUP BY 1, 2")
def a10(spark, d):
    return t(spark, d, "orders").where("o_totalprice > 50000").groupBy("o_custkey", Y().alias("year")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last"))


@query("a11_conditional_totals", """WITH u AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem), n AS (SELECT l_suppkey, count(*) AS num FROM u WHERE l_returnflag = 'R' AND l_suppkey % 3 <> 0 GROUP BY 1), m AS (SELECT l_suppkey, count(*) AS total FROM u WHERE l_suppkey % 5 <> 0 GROUP BY 1)
  SELECT l_suppkey, num, total, CASE WHEN total > 0 THEN num / total END AS share FROM n FULL JOIN m USING (l_suppkey)""")
def a11(spark, d):
    u = t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    n = u.where("l_returnflag = 'R' AND l_suppkey % 3 <> 0").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("num"))
    m = u.where("l_suppkey % 5 <> 0").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("total"))
    return n.join(m, "l_suppkey", "full").withColumn("share", C.share(F.col("num"), F.col("total")))


@query("a12_merge_rules", """SELECT o_custkey // 2 AS code, min(o_totalprice) AS nearest, max(o_orderkey) AS n_max, bool_or(o_orderpriority = '1-URGENT') AS ever FROM orders GROUP BY 1""")
def a12(spark, d):
    rules = {"nearest": F.min("o_totalprice"), "n_max": F.max("o_orderkey"), "ever": F.bool_or(F.col("o_orderpriority") == "1-URGENT")}
    return t(spark, d, "orders").groupBy(F.floor(F.col("o_custkey") / 2).alias("code")).agg(*[v.alias(k) for k, v in rules.items()])


@query("a13_row_sum", """SELECT p_partkey, CASE WHEN p_size > 25 OR p_size % 2 = 0 OR p_size < 5 THEN coalesce(CASE WHEN p_size > 25 THEN p_size END, 0) + coalesce(CASE WHEN p_size % 2 = 0 THEN 2 END, 0) + coalesce(CASE WHEN p_size < 5 THEN 3 END, 0) END AS total FROM part""")
def a13(spark, d):
    s = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", C.row_sum([F.when(s > 25, s), F.when(s % 2 == 0, 2), F.when(s < 5, 3)]).alias("total"))


@query("a14_max_over_directions", "SELECT l_partkey, l_suppkey, max(l_quantity) AS busiest FROM lineitem GROUP BY 1, 2")
def a14(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("busiest"))


@query("a15_local_intensity", """WITH r AS (SELECT l_suppkey, year(l_shipdate) AS year, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2), e AS (SELECT l_suppkey, l_partkey, avg(l_quantity) AS v FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY 1, 2),
  k AS (SELECT l_suppkey, l_partkey, CASE WHEN m > 0 THEN v / m END AS ratio FROM e JOIN r USING (l_suppkey) WHERE year = 1998) SELECT l_suppkey, l_partkey, CAST(r.year AS INTEGER) AS year, round(ratio, 9) AS intensity, round(ratio * m, 6) AS scaled FROM k JOIN r USING (l_suppkey)""")
def a15(spark, d):
    li = t(spark, d, "lineitem")
    route = li.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.avg("l_quantity").alias("m"))
    own = li.where(F.year("l_shipdate") == 1998).groupBy("l_suppkey", "l_partkey").agg(F.avg("l_quantity").alias("v"))
    return A.local_intensity(own, route, "l_suppkey", "l_partkey", "v", "year", "m", 1998).withColumns({"intensity": F.round("intensity", 9), "scaled": F.round("scaled", 6)})


@query("a16_run_report", """SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_units, CAST(min(year(o_orderdate)) AS INTEGER) AS first, CAST(max(year(o_orderdate)) AS INTEGER) AS last, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_custkey END) AS n_loose, count(DISTINCT CASE WHEN o_totalprice > 300000 THEN o_custkey END) AS n_strict,
  count(DISTINCT CASE WHEN o_totalprice > 300000 AND o_orderpriority = '1-URGENT' THEN o_custkey END) AS n_strictest, count(c_custkey) AS n_matched, round(count(c_custkey) / count(*), 6) AS match_rate, count(*) FILTER (WHERE o_totalprice > 300000) AS rows_strict FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def a16(spark, d):
    c = t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    o = t(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    strict = F.col("o_totalprice") > 300000
    tiers = {"loose": F.col("o_totalprice") > 100000, "strict": strict, "strictest": strict & (F.col("o_orderpriority") == "1-URGENT")}
    return A.run_report(o, "o_custkey", Y(), tiers, F.col("c_custkey"), {"rows_strict": F.count_if(strict)})


@query("a17_cross_tab", """SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) AS n FROM orders GROUP BY 1""")
def a17(spark, d):
    return t(spark, d, "orders").groupBy(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("status")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count(F.lit(1)).alias("n"))


@query("a18_coverage", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0 END), 9) AS covered FROM orders GROUP BY 1""")
def a18(spark, d):
    v = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))
    return t(spark, d, "orders").groupBy(Y().alias("year")).agg(F.round(F.avg(v.isNotNull().cast("double")), 9).alias("covered"))


@query("a19_distribution", """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS lo, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS q9 FROM orders GROUP BY 1""")
def a19(spark, d):
    x, q = F.col("o_totalprice"), F.col("q")
    g = t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sd"), F.min(x).alias("lo"))
    g = A.beside(g, A.exact_cuts(t(spark, d, "orders"), "o_totalprice", [0.25, 0.5, 0.9], ["o_orderpriority"]).withColumnRenamed("cuts", "q"), ["o_orderpriority"])
    return g.select("o_orderpriority", "n", "mean", "sd", "lo", F.round(q[0], 4).alias("q1"), F.round(q[1], 4).alias("med"), F.round(q[2], 4).alias("q9"))


@query("a20_pairwise_correlation", """WITH u AS (SELECT o_custkey, o_orderpriority AS s, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT a.s AS a, b.s AS b, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM u a JOIN u b USING (o_custkey) WHERE a.s < b.s GROUP BY 1, 2""")
def a20(spark, d):
    u = t(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    a, b = u.select("o_custkey", F.col("o_orderpriority").alias("a"), F.col("v").alias("x")), u.select("o_custkey", F.col("o_orderpriority").alias("b"), F.col("v").alias("y"))
    return a.join(b, "o_custkey").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("r"))


@query("a21_consistency_shares", """SELECT round(avg(CASE WHEN l_discount + l_tax BETWEEN 0.02 AND 0.1 THEN 1.0 ELSE 0 END), 9) AS in_band, round(avg(CASE WHEN l_quantity > 45 THEN 1.0 ELSE 0 END), 9) AS suppressed, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem""")
def a21(spark, d):
    li = t(spark, d, "lineitem")
    keys = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("l_discount") + F.col("l_tax")).between(0.02, 0.1)).alias("b"), F.count_if(F.col("l_quantity") > 45).alias("s"))
    n = F.sum("n")
    return keys.agg(F.round(F.sum("b") / n, 9).alias("in_band"), F.round(F.sum("s") / n, 9).alias("suppressed"), (n - F.count(F.lit(1))).alias("n_duplicates"))


@query("a22_churn", """WITH u AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), p AS (SELECT DISTINCT y FROM u) SELECT CAST(p.y AS INTEGER) AS year, count(*) FILTER (WHERE a.y IS NULL) AS entered, count(*) FILTER (WHERE b.y IS NULL) AS leaving FROM u p LEFT JOIN u a ON a.o_custkey = p.o_custkey AND a.y = p.y - 1 LEFT JOIN u b ON b.o_custkey = p.o_custkey AND b.y = p.y + 1 GROUP BY 1""")
def a22(spark, d):
    u = t(spark, d, "orders").select("o_custkey", Y().alias("year")).distinct()
    w = Window.partitionBy("o_custkey").orderBy("year")
    e = u.withColumn("before", F.lag("year").over(w)).withColumn("after", F.lead("year").over(w))
    out = lambda c, k: F.count_if(F.col(c).isNull() | (F.abs(F.col(c) - F.col("year")) != k))
    return e.groupBy("year").agg(out("before", 1).alias("entered"), out("after", 1).alias("leaving"))


@query("a23_transition_means", """SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997), 4) AS before, round(avg(o_totalprice) FILTER (WHERE year(o_orderdate) = 1999), 4) AS after, round(avg(o_totalprice) FILTER (WHERE year(o_orderdate) = 1999) - avg(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997), 4) AS change FROM orders GROUP BY 1""")
def a23(spark, d):
    m = lambda y: F.avg(F.when(Y() == y, F.col("o_totalprice")))
    return t(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(m(1997), 4).alias("before"), F.round(m(1999), 4).alias("after"), F.round(m(1999) - m(1997), 4).alias("change"))


FT = "SELECT o_custkey, min(year(o_orderdate)) AS g FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000 GROUP BY 1"


def first_treat(spark, d):
    o = t(spark, d, "orders")
    return o.where("o_orderpriority = '1-URGENT' AND o_totalprice > 200000").groupBy("o_custkey").agg(F.min(Y()).alias("g"))


@query("a24_identifying_units", f"""SELECT o_custkey, CAST(min(year(o_orderdate)) AS INTEGER) AS first, CAST(max(year(o_orderdate)) AS INTEGER) AS last, count(*) FILTER (WHERE year(o_orderdate) >= g) AS n_post FROM orders JOIN ({FT}) USING (o_custkey) GROUP BY 1 HAVING bool_or(year(o_orderdate) < g) AND bool_or(year(o_orderdate) >= g)""")
def a24(spark, d):
    o = t(spark, d, "orders").join(first_treat(spark, d), "o_custkey")
    g = o.groupBy("o_custkey").agg(F.min(Y()).alias("first"), F.max(Y()).alias("last"), F.count_if(Y() >= F.col("g")).alias("n_post"), F.bool_or(Y() < F.col("g")).alias("pre"))
    return g.where("pre and n_post > 0").drop("pre")


@query("a25_combined_first_year", """WITH a AS (SELECT o_custkey, min(year(o_orderdate)) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000) AS a, min(year(o_orderdate)) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 400000) AS b, bool_or(o_orderkey % 101 = 0) AS unknown FROM orders GROUP BY 1)
  SELECT o_custkey, CAST(least(a, b) AS INTEGER) AS first FROM a WHERE NOT (unknown AND least(a, b) IS NULL)""")
def a25(spark, d):
    p = F.col("o_totalprice")
    a = t(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.when((F.col("o_orderpriority") == "1-URGENT") & (p > 300000), Y())).alias("a"), F.min(F.when((F.col("o_orderstatus") == "P") & (p > 400000), Y())).alias("b"), F.bool_or(F.col("o_orderkey") % 101 == 0).alias("unknown"))
    return a.withColumn("first", F.least("a", "b")).where("not (unknown and first is null)").select("o_custkey", "first")


@query("a26_mixed_cohorts", "SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_acctbal < -900) AS n_near FROM customer GROUP BY 1 HAVING count(*) FILTER (WHERE c_acctbal < -900) BETWEEN 1 AND count(*) - 1")
def a26(spark, d):
    g = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < -900).alias("n_near"))
    return g.where("0 < n_near and n_near < n")


@query("a27_spanning_groups", "SELECT o_custkey, o_orderpriority FROM orders GROUP BY 1, 2 HAVING bool_or(year(o_orderdate) < 1998) AND bool_or(year(o_orderdate) >= 1998)")
def a27(spark, d):
    g = t(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.bool_or(Y() < 1998).alias("pre"), F.bool_or(Y() >= 1998).alias("post"))
    return g.where("pre and post").select("o_custkey", "o_orderpriority")


@query("w01_z_score", """SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w, 6) AS z FROM orders WINDOW w AS (PARTITION BY year(o_orderdate), o_orderpriority)""")
def w01(spark, d):
    return A.z_within(t(spark, d, "orders").withColumn("year", Y()), ["year", "o_orderpriority"], "o_totalprice", "z").select("o_orderkey", F.round("z", 6).alias("z"))


@query("w02_weighted_z", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS x, CASE WHEN l_linenumber > 1 THEN l_quantity END AS w FROM lineitem), m AS (SELECT l_suppkey, sum(w * x) / sum(CASE WHEN w IS NOT NULL THEN w END) AS m FROM x GROUP BY 1), v AS (SELECT l_suppkey, sqrt(sum(w * pow(x - m, 2)) / sum(w)) AS s FROM x JOIN m USING (l_suppkey) GROUP BY 1)
  SELECT l_orderkey, l_linenumber, l_partkey, round((x - m) / s, 6) AS z FROM x JOIN m USING (l_suppkey) JOIN v USING (l_suppkey)""")
def w02(spark, d):
    x = t(spark, d, "lineitem").withColumn("w", F.when(F.col("l_linenumber") > 1, F.col("l_quantity")))
    return A.weighted_z_within(x, ["l_suppkey"], "l_extendedprice", "w", "z").select("l_orderkey", "l_linenumber", "l_partkey", F.round("z", 6).alias("z"))


@query("w03_stitched_series", """WITH x AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN year(o_orderdate) < 1998 THEN 'old' ELSE 'new' END AS era, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN year(o_orderdate) < 1998 THEN o_totalprice ELSE o_totalprice / 10 + 3 END AS v, o_orderkey % 4 AS w FROM orders),
  m AS (SELECT era, sum(w * v) / sum(w) AS m, sum(w) AS n FROM x WHERE v IS NOT NULL AND w > 0 GROUP BY 1), s AS (SELECT era, m, sqrt(sum(w * pow(v - m, 2)) / n) AS s FROM x JOIN m USING (era) WHERE v IS NOT NULL AND w > 0 GROUP BY era, m, n)
  SELECT o_orderkey, year, era, 'price_z' AS outcome, round((v - avg(v) OVER (PARTITION BY era)) / stddev_samp(v) OVER (PARTITION BY era), 6) AS value FROM x WHERE v IS NOT NULL
  UNION ALL SELECT o_orderkey, year, era, 'price_zw', round((v - m) / s, 6) FROM x JOIN s USING (era) WHERE v IS NOT NULL AND w > 0""")
def w03(spark, d):
    p = F.col("o_totalprice")
    v = F.when(F.col("o_orderkey") % 7 != 0, F.when(Y() < 1998, p).otherwise(p / 10 + 3))
    x = t(spark, d, "orders").select("o_orderkey", Y().alias("year"), F.when(Y() < 1998, "old").otherwise("new").alias("era"), v.alias("v"), (F.col("o_orderkey") % 4).alias("w"))
    return A.stitched(x, "era", "v", "w", "price", ["o_orderkey", "year", "era"]).withColumn("value", F.round("value", 6))


@query("w04_baseline", "SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS base FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def w04(spark, d):
    return t(spark, d, "orders").where("o_totalprice > 100000").groupBy("o_custkey").agg(F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("base"))


@query("w05_latest_record", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def w05(spark, d):
    return A.latest(t(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")])


@query("w06_keep_first", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def w06(spark, d):
    return A.earliest(t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w07_consecutive_differences", "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 4) AS change FROM orders")
def w07(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 4).alias("change"))


@query("w08_share_of_group", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS weight FROM lineitem")
def w08(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    whole = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("whole"))
    return li.join(whole, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_quantity") / F.col("whole"), 9).alias("weight"))


@query("w09_dense_ids", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority, year(o_orderdate)) AS INTEGER) AS cell_id FROM orders")
def w09(spark, d):
    return A.dense_ids(t(spark, d, "orders").select("o_orderkey", "o_orderpriority", Y().alias("year")), ["o_orderpriority", "year"], "cell_id").select("o_orderkey", "cell_id")


@query("w10_quantile_groups", """WITH c AS (SELECT quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) AS q FROM customer) SELECT c_custkey, CAST(CASE WHEN c_acctbal <= q[1] THEN 1 WHEN c_acctbal <= q[2] THEN 2 WHEN c_acctbal <= q[3] THEN 3 WHEN c_acctbal <= q[4] THEN 4 ELSE 5 END AS INTEGER) AS quintile FROM customer, c""")
def w10(spark, d):
    c = t(spark, d, "customer")
    cuts, x = F.col("cuts"), F.col("c_acctbal")
    q = F.when(x <= cuts[0], 1).when(x <= cuts[1], 2).when(x <= cuts[2], 3).when(x <= cuts[3], 4).otherwise(5)
    return c.crossJoin(F.broadcast(A.exact_cuts(c, "c_acctbal", [0.2, 0.4, 0.6, 0.8]))).select("c_custkey", q.alias("quintile"))


@query("w11_holm", """WITH p AS (SELECT p_brand, p_partkey, p_size / 1000.0::DOUBLE AS p FROM part), s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) + 1) * p) AS s FROM p)
  SELECT p_brand, p_partkey, p, round(max(s) OVER (PARTITION BY p_brand ORDER BY p, p_partkey ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM s""")
def w11(spark, d):
    p = t(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") / 1000.0).alias("p"))
    return A.holm(p, ["p_brand"], "p", "adjusted").withColumn("adjusted", F.round("adjusted", 9))


@query("w12_treatment_clock", f"""SELECT o_orderkey, coalesce(year(o_orderdate) >= g, false) AS post, coalesce(g <= min(year(o_orderdate)) OVER (PARTITION BY o_custkey), false) AS always FROM orders LEFT JOIN ({FT}) USING (o_custkey)""")
def w12(spark, d):
    o = t(spark, d, "orders")
    first = o.groupBy("o_custkey").agg(F.min(Y()).alias("first"))
    clock = first.join(first_treat(spark, d), "o_custkey", "left")
    return o.join(clock, "o_custkey").select("o_orderkey", F.coalesce(Y() >= F.col("g"), F.lit(False)).alias("post"), F.coalesce(F.col("g") <= F.col("first"), F.lit(False)).alias("always"))


@query("w13_permutation_rank")
def w13(spark, d):
    return A.permutation_rank(t(spark, d, "customer"), 20, 7, "c_custkey", top=10)


@query("t01_ordered_output", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer ORDER BY balance NULLS LAST, c_custkey")
def t01(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance")).orderBy(F.asc_nulls_last("balance"), "c_custkey")


@query("t02_top_k", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def t02(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@query("t03_mutual_best", """WITH p AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY s DESC) AS a, rank() OVER (PARTITION BY l_partkey ORDER BY s DESC) AS b FROM p),
  k AS (SELECT *, count(*) FILTER (WHERE a = 1) OVER (PARTITION BY l_suppkey) AS ta, count(*) FILTER (WHERE b = 1) OVER (PARTITION BY l_partkey) AS tb FROM r) SELECT l_suppkey, l_partkey, s FROM k WHERE a = 1 AND b = 1 AND ta = 1 AND tb = 1""")
def t03(spark, d):
    p = t(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("s"))
    return A.mutual_best(p, "l_suppkey", "l_partkey", "s")


@query("u01_union_unlike", "SELECT 'c' AS kind, c_custkey AS k, c_acctbal AS balance, NULL AS size FROM customer UNION ALL SELECT 'p', p_partkey, NULL, p_size FROM part")
def u01(spark, d):
    c = t(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    p = t(spark, d, "part").select(F.lit("p").alias("kind"), F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    return c.unionByName(p, allowMissingColumns=True)


@query("u02_set_difference", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000 EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
def u02(spark, d):
    c = t(spark, d, "customer")
    near = c.where("c_acctbal > 0 and c_mktsegment <> 'MACHINERY'").select("c_custkey")
    return near.join(t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("u03_nesting", f"SELECT count(*) FILTER (WHERE c AND NOT b) AS strict_not_loose, count(*) FILTER (WHERE b AND NOT c) AS loose_not_strict FROM (SELECT o_custkey, bool_or({TIERS['b']}) AS b, bool_or({TIERS['c']}) AS c FROM orders GROUP BY 1)")
def u03(spark, d):
    tiers = A.tiered_first_event(t(spark, d, "orders"), ["o_custkey"], YEAR_OR_NULL(), QUAL())
    return tiers.agg(F.count_if(F.col("ever_c") & ~F.col("ever_b")).alias("strict_not_loose"), F.count_if(F.col("ever_b") & ~F.col("ever_c")).alias("loose_not_strict"))


@query("u04_duplicates_by_precedence", """WITH a AS (SELECT p_name || p_brand AS g, min(p_partkey) AS k FROM part WHERE p_size < 25 GROUP BY 1), b AS (SELECT p_name || p_brand AS g, min(p_partkey) AS k FROM part WHERE p_size >= 25 GROUP BY 1) SELECT g, k, 'built' AS status FROM a UNION ALL SELECT g, k, 'proposed' FROM b WHERE g NOT IN (SELECT g FROM a)""")
def u04(spark, d):
    p = t(spark, d, "part").select(F.concat("p_name", "p_brand").alias("g"), F.col("p_partkey").alias("k"), F.when(F.col("p_size") < 25, "built").otherwise("proposed").alias("status"))
    return p.groupBy("g").agg(F.min_by(F.struct("k", "status"), F.struct("status", "k")).alias("r")).select("g", "r.*")


@query("w05_current_else_latest", "SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'N' DESC, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1")
def w05_current(spark, d):
    """The row of the open window ('N') of each part, else its most recent one."""
    li = t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return A.current_or_latest(li, ["l_partkey"], F.col("l_returnflag") == "N", [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")


RANGES = "SELECT l_orderkey AS link, l_linenumber * 10.0::DOUBLE AS start, l_linenumber * 10.0::DOUBLE + l_quantity / 5 AS stop FROM lineitem"


@query("w07_gap_to_previous_end", f"SELECT link, start, round(start - lag(stop) OVER (PARTITION BY link ORDER BY start, stop), 6) AS gap FROM ({RANGES})")
def w07_gap(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("link"), (F.col("l_linenumber") * 10.0).alias("start"), (F.col("l_linenumber") * 10.0 + F.col("l_quantity") / 5).alias("stop"))
    return A.gap_to_previous(li, "link", "start", "stop", "gap").select("link", "start", F.round("gap", 6).alias("gap"))


UNIT_YEARS = "SELECT o_custkey, year(o_orderdate) AS year, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2"


@query("w07_change_quantiles", f"SELECT c_mktsegment, count(*) AS n, [round(q, 4) FOR q IN quantile_cont(b.y - a.y, [0.05, 0.25, 0.5, 0.75, 0.95])] AS cuts FROM ({UNIT_YEARS}) a JOIN ({UNIT_YEARS}) b ON a.o_custkey = b.o_custkey AND b.year = a.year + 1 JOIN customer ON c_custkey = a.o_custkey GROUP BY 1")
def w07_quantiles(spark, d):
    """Year-to-year changes of the units of each segment: number and quantiles."""
    u = t(spark, d, "orders").groupBy("o_custkey", Y().alias("year")).agg(F.avg("o_totalprice").alias("y"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    ch = A.yearly_changes(u, ["o_custkey"], "year", "y", "change").join(c, "o_custkey")
    cuts = A.exact_cuts(ch, "change", [0.05, 0.25, 0.5, 0.75, 0.95], ["c_mktsegment"])
    return ch.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).join(cuts, "c_mktsegment").select("c_mktsegment", "n", F.transform("cuts", lambda q: F.round(q, 4)).alias("cuts"))


@query("w10_quantile_means", f"""WITH u AS (SELECT c_custkey, c_acctbal AS x, y, g IS NOT NULL AS treated FROM customer JOIN (SELECT o_custkey AS c_custkey, avg(o_totalprice) AS y FROM orders GROUP BY 1) USING (c_custkey) LEFT JOIN (SELECT o_custkey AS c_custkey, g FROM ({FT})) USING (c_custkey)),
  c AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS q, quantile_cont(x, 0.5) FILTER (WHERE treated) AS m FROM u), l AS (SELECT *, CASE WHEN x <= q[1] THEN 1 WHEN x <= q[2] THEN 2 WHEN x <= q[3] THEN 3 WHEN x <= q[4] THEN 4 ELSE 5 END AS k FROM u, c)
  SELECT 'quintile' AS split, CAST(k AS INTEGER) AS level, count(*) AS n, round(avg(y), 4) AS mean FROM l GROUP BY 2 UNION ALL SELECT 'treated above median', CAST(x > m AS INTEGER), count(*), round(avg(y), 4) FROM l WHERE treated GROUP BY 2""")
def w10_means(spark, d):
    """Mean outcome by quintile of the balance, and of the treated below and above their own median."""
    y = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("y"))
    u = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x")).join(y, "c_custkey").join(first_treat(spark, d).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    cuts, middle = A.exact_cuts(u, "x", [0.2, 0.4, 0.6, 0.8]), A.exact_cuts(u.where("g is not null"), "x", [0.5]).select(F.col("cuts").alias("m"))
    both = u.crossJoin(F.broadcast(cuts)).crossJoin(F.broadcast(middle))  # one row each
    row = lambda name, level: F.struct(F.lit(name).alias("split"), level.cast("int").alias("level"))
    levels = F.array(row("quintile", A.quantile_group(F.col("x"), F.col("cuts"), 5)), F.when(F.col("g").isNotNull(), row("treated above median", F.col("x") > F.col("m")[0])))
    return both.select("y", F.inline(F.filter(levels, lambda s: s.isNotNull()))).groupBy("split", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 4).alias("mean"))


@query("panel_mini", """WITH u AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS y, count(*) AS n FROM orders GROUP BY 1, 2), f AS (SELECT o_custkey, CAST(min(year(o_orderdate)) AS INTEGER) AS first FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000 GROUP BY 1),
  s AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS release, count(*) AS traffic FROM lineitem WHERE year(l_shipdate) % 2 = 0 GROUP BY 1, 2)
  SELECT u.o_custkey, u.year, round(y, 4) AS outcome, n AS weight, c_mktsegment, n_name, r_name, traffic, first AS first_treat_year, u.year - first AS event_time, first IS NOT NULL AS ever_treated
  FROM u JOIN customer ON c_custkey = u.o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN f ON f.o_custkey = u.o_custkey LEFT JOIN s ON l_suppkey = u.o_custkey % 100 AND abs(release - u.year) <= 2
  QUALIFY row_number() OVER (PARTITION BY u.o_custkey, u.year ORDER BY abs(release - u.year), release) = 1""")
def panel_mini(spark, d):
    """Unit-year outcomes with covariates, the nearest year's traffic and the treatment clock: one wide shuffle by unit, all else small."""
    o = t(spark, d, "orders").groupBy("o_custkey", Y().alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("outcome"), F.count(F.lit(1)).alias("weight"))
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    o = J.many_to_one(o, c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name", "r_name"), ["o_custkey"])
    s = t(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("release")).agg(F.count(F.lit(1)).alias("traffic")).where("release % 2 = 0")
    o = J.asof_nearest(o.withColumn("l_suppkey", F.col("o_custkey") % 100), s, ["l_suppkey"], "year", "release", ["traffic"], 2, ["o_custkey", "year"])
    o = o.join(first_treat(spark, d).withColumnRenamed("g", "first_treat_year"), "o_custkey", "left")
    return o.select("o_custkey", "year", "outcome", "weight", "c_mktsegment", "n_name", "r_name", "traffic", "first_treat_year", C.event_time(F.col("year"), F.col("first_treat_year")).alias("event_time"), F.col("first_treat_year").isNotNull().alias("ever_treated"))
