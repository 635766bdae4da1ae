"""Queries over joins (J operators)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelworks.operators import joins as J
from panelworks.operators import tables as T
from panelworks.plans.registry import query
from panelworks.session import table as t


def supplier_years(spark, d, even=True):
    """(l_suppkey, year, n, price): the yearly side table, even years only where asked."""
    li = t(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    li = li.where("year % 2 = 0") if even else li
    return li.groupBy("l_suppkey", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


SY = "SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem {w} GROUP BY 1, 2"
OW = """SELECT o_custkey, o_orderkey, o_totalprice, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS valid_from,
  coalesce(CAST(strftime(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%Y%m%d') AS INTEGER), 99991231) AS valid_to FROM orders"""


@query("j01_many_to_one", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def j01(spark, d):
    c = t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return J.many_to_one(t(spark, d, "orders"), c, ["o_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("j02_group_values", "SELECT c_custkey, n_name, coalesce(r_name, 'none') AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3")
def j02(spark, d):
    r = t(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    n = t(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return T.left_fill(t(spark, d, "customer").join(n, "c_nationkey", "left"), r, ["n_regionkey"], {"region": "none"}).select("c_custkey", "n_name", "region")


@query("j03_entity_year", f"WITH s AS ({SY.format(w='')}) SELECT o_orderkey, n, price FROM orders LEFT JOIN s ON s.l_suppkey = o_custkey % 100 AND s.year = year(o_orderdate)")
def j03(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("l_suppkey"), F.year("o_orderdate").alias("year"))
    return o.join(supplier_years(spark, d, False), ["l_suppkey", "year"], "left").select("o_orderkey", "n", "price")


@query("j04_asof_nearest", f"""WITH s AS ({SY.format(w="WHERE year(l_shipdate) % 2 = 0")}), o AS (SELECT o_orderkey, o_custkey % 100 AS k, year(o_orderdate) AS y FROM orders)
  SELECT o_orderkey, n, s.year AS matched_year FROM o LEFT JOIN s ON s.l_suppkey = k AND abs(s.year - y) <= 2 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(s.year - y), s.year) = 1""")
def j04(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("l_suppkey"), F.year("o_orderdate").alias("year"))
    s = supplier_years(spark, d).withColumnRenamed("year", "release")
    return J.asof_nearest(o, s, ["l_suppkey"], "year", "release", ["n"], 2, ["o_orderkey"]).select("o_orderkey", "n", "matched_year")


@query("j05_asof_backward", f"""WITH w AS ({OW}), e AS (SELECT event_id, user_id, 19950101 + CAST(event_id % 7 AS INTEGER) * 10000 AS at FROM events)
  SELECT event_id, CASE WHEN e.at < valid_to THEN o_totalprice END AS o_totalprice FROM e LEFT JOIN w ON w.o_custkey = e.user_id AND w.valid_from <= e.at
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY valid_from DESC, valid_to DESC, o_totalprice DESC) = 1""".replace(" AS at", " AS tm").replace("e.at", "e.tm"))
def j05(spark, d):
    w = T.order_windows(t(spark, d, "orders")).select(F.col("o_custkey").alias("user_id"), "valid_from", "valid_to", "o_totalprice")
    e = t(spark, d, "events").select("event_id", "user_id", (19950101 + (F.col("event_id") % 7).cast("int") * 10000).alias("at"))
    return J.asof_backward(e, w, ["user_id"], "at", "valid_from", "valid_to", ["o_totalprice"]).select("event_id", "o_totalprice")


@query("j06_window_cover_max", f"""WITH w AS ({OW}), y AS (SELECT unnest(range(1996, 2002)) AS year)
  SELECT o_custkey, CAST(year AS INTEGER) AS year, max(o_totalprice) AS busiest FROM w JOIN y ON valid_from <= year * 10000 + 101 AND year * 10000 + 101 < valid_to GROUP BY 1, 2""")
def j06(spark, d):
    w = T.order_windows(t(spark, d, "orders"))
    first = F.floor((F.col("valid_from") - 101 + 9999) / 10000).cast("int")
    last = F.least(F.floor((F.col("valid_to") - 102) / 10000).cast("int"), F.lit(2001))
    w = w.withColumn("lo", F.greatest(first, F.lit(1996))).withColumn("hi", last)
    return J.interval_years(w, "lo", "hi").groupBy("o_custkey", "year").agg(F.max("o_totalprice").alias("busiest"))


@query("j07_interval_years", """WITH i AS (SELECT l_orderkey, min(year(l_shipdate)) AS lo, max(year(l_shipdate)) - CASE WHEN l_orderkey % 9 = 0 THEN 3 ELSE 0 END AS hi FROM lineitem GROUP BY 1),
  x AS (SELECT l_orderkey, unnest(range(lo, hi + 1)) AS year FROM i WHERE lo <= hi) SELECT CAST(year AS INTEGER) AS year, count(*) AS n_active FROM x GROUP BY 1""")
def j07(spark, d):
    y = F.year("l_shipdate")
    i = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(y).alias("lo"), (F.max(y) - F.when(F.col("l_orderkey") % 9 == 0, 3).otherwise(0)).alias("hi"))
    return J.interval_years(i, "lo", "hi").groupBy("year").agg(F.count(F.lit(1)).alias("n_active"))


@query("j08_position_in_range", """SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n_hits FROM lineitem JOIN part ON p_partkey = l_partkey AND l_quantity BETWEEN p_size - 2 AND p_size + 5 + 2 GROUP BY 1, 2, 3""")
def j08(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("b"), (F.col("p_size") + 5.0).alias("e"))
    hits = J.in_range(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), p, ["l_partkey"], "l_quantity", "b", "e", 2.0, 8.0)
    return hits.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n_hits"))


def ranges(spark, d):
    """Ranges on links: parts as links, [linenumber, linenumber + quantity)."""
    return t(spark, d, "lineitem").select("l_partkey", "l_orderkey", F.col("l_linenumber").cast("double").alias("s"), (F.col("l_linenumber") + F.col("l_quantity")).alias("e"))


@query("j09_largest_overlap", """SELECT a.p_partkey AS l_partkey, count(*) AS n_covered, max(least(e, 20.0) - greatest(s, p_size)) AS overlap, arg_min(k, (-(least(e, 20.0) - greatest(s, p_size)), k)) AS primary_row
  FROM part a JOIN (SELECT l_partkey, l_orderkey AS k, l_linenumber AS s, l_linenumber + l_quantity AS e FROM lineitem) ON l_partkey = p_partkey WHERE least(e, 20.0) - greatest(s, p_size) > 0 GROUP BY 1""")
def j09(spark, d):
    links = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("b0"), F.lit(20.0).alias("b1"))
    pairs = J.overlapping(links, ranges(spark, d), ["l_partkey"], "b0", "b1", "s", "e", 16.0)
    return pairs.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_covered"), F.max("overlap").alias("overlap"), F.min_by("l_orderkey", F.struct(-F.col("overlap"), F.col("l_orderkey"))).alias("primary_row"))


@query("j10_overlap_pairs", """SELECT l_partkey, l_orderkey, s, e, least(e, p_size + 3.0) - greatest(s, p_size) AS overlap FROM part JOIN (SELECT l_partkey, l_orderkey, CAST(l_linenumber AS DOUBLE) AS s, l_linenumber + l_quantity AS e FROM lineitem) ON l_partkey = p_partkey
  WHERE least(e, p_size + 3.0) - greatest(s, p_size) > 0""")
def j10(spark, d):
    links = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("b0"), (F.col("p_size") + 3.0).alias("b1"))
    return J.overlapping(links, ranges(spark, d), ["l_partkey"], "b0", "b1", "s", "e", 16.0).select("l_partkey", "l_orderkey", "s", "e", "overlap")


@query("j11_opposite_labels", """WITH r AS (SELECT DISTINCT l_partkey, l_orderkey, l_returnflag AS side, CAST(l_linenumber AS DOUBLE) AS s, l_linenumber + l_quantity AS e FROM lineitem WHERE l_returnflag IN ('A', 'R')),
  p AS (SELECT a.l_partkey, a.l_orderkey AS x, b.l_orderkey AS y FROM r a JOIN r b ON a.l_partkey = b.l_partkey AND a.side = 'A' AND b.side = 'R' WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 0.5 * least(a.e - a.s, b.e - b.s))
  SELECT l_partkey, x AS l_orderkey FROM p UNION SELECT l_partkey, y FROM p""")
def j11(spark, d):
    r = ranges(spark, d).withColumn("side", F.lit(None).cast("string"))
    r = t(spark, d, "lineitem").select("l_partkey", "l_orderkey", F.col("l_returnflag").alias("side"), F.col("l_linenumber").cast("double").alias("s"), (F.col("l_linenumber") + F.col("l_quantity")).alias("e")).distinct()
    a = r.where("side = 'A'").select("l_partkey", F.col("l_orderkey").alias("x"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = r.where("side = 'R'").select("l_partkey", F.col("l_orderkey").alias("y"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    both = J.overlapping(a, b, ["l_partkey"], "s1", "e1", "s2", "e2", 16.0).where(F.col("overlap") >= 0.5 * F.least(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2")))
    return both.select("l_partkey", F.explode(F.array("x", "y")).alias("l_orderkey")).distinct()


@query("j12_statewide_expansion", """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id % 25 END AS n FROM events)
  SELECT n_nationkey, event_type, count(*) AS n_events FROM nation JOIN e ON e.n = n_nationkey OR e.n IS NULL GROUP BY 1, 2""")
def j12(spark, d):
    e = t(spark, d, "events").select("event_type", F.when(F.col("event_id") % 50 != 0, F.col("event_id") % 25).alias("n"))
    counts = e.groupBy("event_type", "n").agg(F.count(F.lit(1)).alias("c"))  # counted first: the expansion is nations x types
    n = t(spark, d, "nation").select("n_nationkey")
    wide = counts.where("n is null").crossJoin(F.broadcast(n)).select("n_nationkey", "event_type", "c")
    own = counts.where("n is not null").join(n, F.col("n") == F.col("n_nationkey")).select("n_nationkey", "event_type", "c")
    return own.unionByName(wide).groupBy("n_nationkey", "event_type").agg(F.sum("c").alias("n_events"))


@query("j13_full_outer", """WITH a AS (SELECT o_custkey % 200 AS k, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS a FROM orders GROUP BY 1, 2), b AS (SELECT l_suppkey AS k, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
  c AS (SELECT c_custkey % 150 AS k, 1997 AS year, count(*) AS c FROM customer GROUP BY 1) SELECT * FROM a FULL JOIN b USING (k, year) FULL JOIN c USING (k, year)""")
def j13(spark, d):
    a = t(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("k"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("a"))
    b = t(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("b"))
    c = t(spark, d, "customer").groupBy((F.col("c_custkey") % 150).alias("k")).agg(F.count(F.lit(1)).alias("c")).withColumn("year", F.lit(1997))
    return reduce(lambda x, y: x.join(y, ["k", "year"], "full"), [a, b, c])


@query("j14_vintage_lookup", """SELECT o_orderkey, n_name FROM (SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1998 THEN o_custkey % 25 ELSE (o_custkey + 1) % 25 END AS k FROM orders) LEFT JOIN nation ON n_nationkey = k""")
def j14(spark, d):
    vintage = F.when(F.year("o_orderdate") < 1998, 1990).otherwise(2000)
    n = t(spark, d, "nation")
    match = n.select(F.lit(1990).alias("vintage"), F.col("n_nationkey").cast("long").alias("area"), "n_name").unionByName(n.select(F.lit(2000).alias("vintage"), F.pmod(F.col("n_nationkey") - 1, F.lit(25)).cast("long").alias("area"), "n_name"))
    return t(spark, d, "orders").select("o_orderkey", vintage.alias("vintage"), (F.col("o_custkey") % 25).alias("area")).join(match, ["vintage", "area"], "left").select("o_orderkey", "n_name")


@query("j15_keep_unmatched", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON o_custkey = c_custkey")
def j15(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 450000")
    return t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j16_guarded_remap", """WITH p AS (SELECT o_custkey AS code, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT *, CASE WHEN code % 7 = 0 THEN code + 1 END AS new_code FROM p),
  h AS (SELECT code, year FROM m WHERE new_code IS NULL) SELECT CASE WHEN m.new_code IS NOT NULL AND h.code IS NULL THEN m.new_code ELSE m.code END AS code, m.year, n, m.new_code IS NOT NULL AND h.code IS NULL AS moved, m.new_code IS NOT NULL AND h.code IS NOT NULL AS blocked
  FROM m LEFT JOIN h ON h.code = m.new_code AND h.year = m.year""")
def j16(spark, d):
    p = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    walk = p.where("code % 7 = 0").select(F.col("code").alias("old_code"), (F.col("code") + 1).alias("new_code")).distinct()
    return J.remap_guarded(p, walk, "code", ["year"])


@query("j17_modal_crosswalk", """WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, arg_min(c_mktsegment, (-n, c_mktsegment)) AS c_mktsegment, max(n) / sum(n) AS share FROM n GROUP BY 1""")
def j17(spark, d):
    return J.modal(t(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query("j18_fill_in", """WITH u AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer), l AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS f FROM orders WHERE o_totalprice > 100000 GROUP BY 1)
  SELECT c_custkey, coalesce(v, f) AS v, CASE WHEN v IS NOT NULL THEN 'own' WHEN f IS NOT NULL THEN 'lookup' END AS tag FROM u LEFT JOIN l ON o_custkey = c_custkey""")
def j18(spark, d):
    u = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    look = t(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("v"))
    return J.fill_latest(u, look, "c_custkey", "o_orderkey", "v", "tag")


@query("j19_membership", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS ever_urgent FROM customer")
def j19(spark, d):
    k = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return J.member_flag(t(spark, d, "customer").select("c_custkey"), k, "c_custkey", "ever_urgent")


@query("j20_anti_join", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47)")
def j20(spark, d):
    used = t(spark, d, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("p_partkey"))
    return t(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("j21_pairing", """WITH a AS (SELECT l_partkey AS task, l_suppkey AS reviewer, max(l_returnflag) AS answer FROM lineitem GROUP BY 1, 2) SELECT x.task, x.reviewer AS a, y.reviewer AS b, x.answer = y.answer AS agree FROM a x JOIN a y ON x.task = y.task AND x.reviewer < y.reviewer""")
def j21(spark, d):
    a = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("task"), F.col("l_suppkey").alias("reviewer")).agg(F.max("l_returnflag").alias("answer"))
    x, y = a.select("task", F.col("reviewer").alias("a"), F.col("answer").alias("u")), a.select("task", F.col("reviewer").alias("b"), F.col("answer").alias("v"))
    return x.join(y, "task").where("a < b").select("task", "a", "b", (F.col("u") == F.col("v")).alias("agree"))


@query("j22_skeleton", """WITH s AS (SELECT o_custkey, min(year(o_orderdate)) AS opened, max(year(o_orderdate)) AS closed FROM orders GROUP BY 1), y AS (SELECT unnest(range(1995, 2002)) AS year), o AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS year FROM orders)
  SELECT s.o_custkey, CAST(y.year AS INTEGER) AS year, o.o_custkey IS NOT NULL AS tested, CASE WHEN o.o_custkey IS NOT NULL THEN 'seen' WHEN y.year BETWEEN opened AND closed THEN 'dates' ELSE 'none' END AS source FROM s, y LEFT JOIN o ON o.o_custkey = s.o_custkey AND o.year = y.year""")
def j22(spark, d):
    o = t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    s = o.groupBy("o_custkey").agg(F.min("year").alias("opened"), F.max("year").alias("closed")).withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    out = s.join(o.distinct().withColumn("tested", F.lit(True)), ["o_custkey", "year"], "left").withColumn("tested", F.coalesce("tested", F.lit(False)))
    return out.select("o_custkey", "year", "tested", F.when(F.col("tested"), "seen").when(F.col("year").between(F.col("opened"), F.col("closed")), "dates").otherwise("none").alias("source"))


@query("j23_extent_share", """WITH e AS (SELECT l_partkey, min(l_linenumber) AS lo, max(l_linenumber + l_quantity) AS hi FROM lineitem GROUP BY 1) SELECT p_type, round(avg(CASE WHEN p_size BETWEEN lo - 1 AND hi + 1 THEN 1.0 ELSE 0 END), 9) AS inside FROM part JOIN e ON l_partkey = p_partkey GROUP BY 1""")
def j23(spark, d):
    e = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_linenumber").alias("lo"), F.max(F.col("l_linenumber") + F.col("l_quantity")).alias("hi"))
    ok = F.col("p_size").between(F.col("lo") - 1, F.col("hi") + 1)
    return t(spark, d, "part").join(e, "p_partkey").groupBy("p_type").agg(F.round(F.avg(ok.cast("double")), 9).alias("inside"))


@query("j24_referential_integrity", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0) AND o_custkey <> 100")
def j24(spark, d):
    spine = t(spark, d, "customer").where("c_custkey % 50 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    listed = t(spark, d, "customer").where("c_custkey = 100").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").select("o_custkey").distinct().join(spine, "o_custkey", "left_anti").join(listed, "o_custkey", "left_anti")


@query("j25_protecting_record", f"""WITH s AS ({SY.format(w="WHERE year(l_shipdate) % 2 = 0")}), p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 100 END AS road FROM customer)
  SELECT o_orderkey, n FROM orders JOIN p ON c_custkey = o_custkey LEFT JOIN s ON s.l_suppkey = road AND abs(s.year - year(o_orderdate)) <= 1 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(s.year - year(o_orderdate)), s.year) = 1""")
def j25(spark, d):
    p = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 100).alias("l_suppkey"))
    o = t(spark, d, "orders").join(p, "o_custkey").select("o_orderkey", "l_suppkey", F.year("o_orderdate").alias("year"))
    return J.asof_nearest(o, supplier_years(spark, d).withColumnRenamed("year", "release"), ["l_suppkey"], "year", "release", ["n"], 1, ["o_orderkey"]).select("o_orderkey", "n")


@query("j26_outer_merge_year", """WITH a AS (SELECT c_nationkey AS k, sum(c_acctbal) AS a FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY 1)
  SELECT k, round(a, 2) AS a, b, k < 10 AS is_county FROM a FULL JOIN b USING (k) WHERE k <> 0""")
def j26(spark, d):
    a = t(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("a"))
    b = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k", "full").where("k <> 0").withColumn("is_county", F.col("k") < 10)


@query("j27_two_hop_values", """WITH v AS (SELECT s_nationkey, year(l_shipdate) AS year, sum(l_extendedprice) AS p, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT c_custkey, CAST(year AS INTEGER) AS year, round(p / n, 4) AS value FROM customer JOIN v ON s_nationkey = c_nationkey""")
def j27(spark, d):
    s = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("p"), F.count(F.lit(1)).alias("n"))
    by = s.join(t(spark, d, "supplier"), "s_suppkey").groupBy(F.col("s_nationkey").alias("c_nationkey"), "year").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return t(spark, d, "customer").join(by, "c_nationkey").select("c_custkey", "year", F.round(F.col("p") / F.col("n"), 4).alias("value"))
