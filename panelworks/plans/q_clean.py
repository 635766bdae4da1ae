"""Queries over the cleaning functions (P and X operators)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from panelworks.functions import columns as C
from panelworks.operators import tables as T
from panelworks.plans.registry import query
from panelworks.session import table as t


@query("p01_rename_ordered", "SELECT c_mktsegment AS segment, c_custkey AS unit, c_name, c_nationkey, c_acctbal FROM customer")
def p01(spark, d):
    return T.rename_ordered(t(spark, d, "customer"), {"c_mktsegment": "segment", "c_custkey": "unit", "absent": "x"}, ["segment", "unit"])


@query("p02_decode", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS priority FROM orders""")
def p02(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", C.decode(o.o_orderstatus, {"F": "final", "O": "open"}).alias("status"), C.decode(o.o_orderpriority, {"1-URGENT": "urgent", "5-LOW": "low"}, True).alias("priority"))


@query("p03_sentinel_null", "SELECT p_partkey, CASE WHEN p_size NOT IN (1, 50) THEN p_size END AS size, CASE WHEN p_retailprice - 1000 > 0 THEN p_retailprice - 1000 END AS excess FROM part")
def p03(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", C.sentinel_null(p.p_size, 1, 50).alias("size"), C.sentinel_null(p.p_retailprice - 1000, positive=True).alias("excess"))


@query("p04_sentinel_reason", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v NOT IN (-1, -2) THEN v END AS value, CASE v WHEN -1 THEN 'missing' WHEN -2 THEN 'na' ELSE 'ok' END AS reason
  FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN -1 WHEN l_linenumber = 2 THEN -2 ELSE CAST(l_quantity AS INTEGER) END AS v FROM lineitem)""")
def p04(spark, d):
    x = F.when(F.col("l_linenumber") == 1, -1).when(F.col("l_linenumber") == 2, -2).otherwise(F.col("l_quantity").cast("int"))
    value, reason = C.sentinel_reason(F.col("v"), {-1: "missing", -2: "na"})
    return t(spark, d, "lineitem").withColumn("v", x).select("l_orderkey", "l_linenumber", "l_partkey", value.alias("value"), reason.alias("reason"))


@query("p05_suppression", """SELECT p_partkey, CASE WHEN p_size > 3 THEN CAST(p_size AS DOUBLE) END AS value, p_size <= 3 AS is_suppressed FROM part""")
def p05(spark, d):
    raw = F.when(F.col("p_size") == 1, " * ").when(F.col("p_size") == 2, "N/A").when(F.col("p_size") == 3, "..").otherwise(F.col("p_size").cast("string"))
    value, flag = C.suppressed(raw)
    return t(spark, d, "part").select("p_partkey", value.alias("value"), flag.alias("is_suppressed"))


@query("p06_parse_number", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders""")
def p06(spark, d):
    text = F.concat(F.lit("~ "), F.regexp_replace(F.format_number("o_totalprice", 2), "[,]", " "))
    raw = F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.regexp_replace(text, r"\.", ","))
    return t(spark, d, "orders").select("o_orderkey", C.parse_number(raw).alias("price"))


@query("p07_range_filter", "SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal END AS balance FROM customer")
def p07(spark, d):
    return t(spark, d, "customer").select("c_custkey", C.in_range(F.col("c_acctbal"), 0, 5000).alias("balance"))


@query("p08_unit_conversion", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity * 0.3048, 1) AS metres FROM lineitem")
def p08(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.scaled(F.col("l_quantity"), 0.3048, 1).alias("metres"))


@query("p09_current_rows", """SELECT o_custkey, o_orderkey, valid_from FROM (SELECT o_custkey, o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS valid_from,
  lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NULL""")
def p09(spark, d):
    return T.current_rows(T.order_windows(t(spark, d, "orders"))).select("o_custkey", "o_orderkey", "valid_from")


@query("p10_class_subset", "SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'STANDARD') OR p_type = 'PROMO'")
def p10(spark, d):
    return t(spark, d, "part").where(F.col("p_type").contains("STANDARD") | (F.col("p_type") == "PROMO")).select("p_partkey", "p_type")


@query("p11_optional_filters", "SELECT o_orderkey, o_orderstatus FROM orders WHERE lower(o_orderstatus) = 'f' AND o_orderpriority = '1-URGENT'")
def p11(spark, d):
    return T.optional_filters(t(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "absent": 3, "o_custkey": None}).select("o_orderkey", "o_orderstatus")


@query("p12_first_usable", """SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 300000 THEN o_totalprice END, CASE WHEN o_totalprice > 100000 THEN -o_totalprice END) AS v,
  CASE WHEN o_totalprice > 300000 THEN 'a' WHEN o_totalprice > 100000 THEN 'b' END AS source FROM orders""")
def p12(spark, d):
    p = F.col("o_totalprice")
    v, tag = C.first_usable([("a", F.when(p > 300000, p)), ("b", F.when(p > 100000, -p))])
    return t(spark, d, "orders").select("o_orderkey", v.alias("v"), tag.alias("source"))


@query("p13_era_label", """SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1997 THEN 'old' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CASE WHEN year(o_orderdate) < 1999 THEN 'mid_a' ELSE 'new_a' END
  WHEN year(o_orderdate) < 2000 THEN 'mid_b' ELSE 'new_b' END AS era, year(o_orderdate) = 1999 AS retrofitted FROM orders""")
def p13(spark, d):
    y, top = F.year("o_orderdate"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    era = C.first_match([(y < 1997, "old"), (top & (y < 1999), "mid_a"), (top, "new_a"), (y < 2000, "mid_b")], "new_b")
    return t(spark, d, "orders").select("o_orderkey", era.alias("era"), (y == 1999).alias("retrofitted"))


@query("p14_spring_year", "SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END AS INTEGER) AS spring FROM orders")
def p14(spark, d):
    return t(spark, d, "orders").select("o_orderkey", C.spring_year(F.col("o_orderdate")).alias("spring"))


@query("p15_fixed_key", """SELECT c_custkey, k AS unit_key, coalesce(k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1, false) AS is_shared FROM (SELECT c_custkey, CASE WHEN c_nationkey <> 0 AND c_custkey % 40 <> 0
  THEN lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 40 AS VARCHAR), 5, '0') END AS k FROM customer)""")
def p15(spark, d):
    c = t(spark, d, "customer").withColumn("unit_key", C.fixed_key([(F.col("c_nationkey"), 2), (F.col("c_custkey") % 40, 5)]))
    return T.flag_shared(c, "unit_key", "is_shared").select("c_custkey", "unit_key", "is_shared")


@query("p16_split_key", "SELECT o_orderkey, CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS rank, substr(o_orderpriority, 3, 4) AS code FROM orders")
def p16(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).try_cast("int").alias("rank"), F.substring("o_orderpriority", 3, 4).alias("code"))


@query("p17_keyword_tags", r"""SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)\b(license|apache)') AS is_license, regexp_matches(coalesce(text, ''), '(?i)\b(idiot|clown)\b') AS is_rude FROM documents""")
def p17(spark, d):
    return t(spark, d, "documents").select("doc_id", C.has_words(F.col("text"), r"\b(license|apache)").alias("is_license"), C.has_words(F.col("text"), r"\b(idiot|clown)\b").alias("is_rude"))


@query("p18_place_name", "SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'FIRST' ELSE n_name END AS place FROM nation")
def p18(spark, d):
    raw = F.concat(F.lit(" "), F.lower("n_name"), F.lit(" (County)"))
    return t(spark, d, "nation").select("n_nationkey", C.norm_place(raw, {"NATION_1": "FIRST"}).alias("place"))


@query("p19_entity_name", "SELECT p_partkey, p_name || ' brand f' || CASE WHEN p_size % 2 = 0 THEN ' enhet nord' ELSE '' END AS name FROM part")
def p19(spark, d):
    kind = F.when(F.col("p_size") % 2 == 0, " Enhet Nord").otherwise(" anpassad grundskola, Enhet 12")
    raw = F.concat(F.initcap("p_name"), F.lit(" åk 4-9 "), F.regexp_replace("p_brand", "#", " LM ("), F.lit(") F-3"), kind)
    return t(spark, d, "part").select("p_partkey", C.norm_entity(raw).alias("name"))


@query("p20_range_set", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN -1 ELSE p_size % 7 END AS low, CAST(p_size % 7 + 3 AS INTEGER) AS high, CAST(CASE WHEN p_size % 2 = 0 THEN 5 ELSE 4 END AS INTEGER) AS n, p_size % 7 <= 5 AS is_tested FROM part""")
def p20(spark, d):
    k = (F.col("p_size") % 7).cast("string")
    code = F.concat(F.when(F.col("p_size") % 2 == 0, "PK, ").otherwise(""), k, F.lit("-"), (F.col("p_size") % 7 + 3).cast("string"))
    s = F.col("s")
    return t(spark, d, "part").withColumn("s", C.range_set(code)).select("p_partkey", F.array_min(s).alias("low"), F.array_max(s).alias("high"), F.size(s).alias("n"), F.arrays_overlap(s, F.array(*[F.lit(x) for x in (3, 4, 5)])).alias("is_tested"))


@query("p21_event_time", """SELECT o_orderkey, CAST(year(o_orderdate) - f AS INTEGER) AS event_time, coalesce(ever, false) AS ever FROM orders LEFT JOIN
  (SELECT o_custkey AS k, min(year(o_orderdate)) AS f, true AS ever FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000 GROUP BY 1) ON k = o_custkey""")
def p21(spark, d):
    o = t(spark, d, "orders")
    first = o.where("o_orderpriority = '1-URGENT' AND o_totalprice > 200000").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("first"), F.lit(True).alias("ever"))
    return o.join(first, "o_custkey", "left").select("o_orderkey", C.event_time(F.year("o_orderdate"), F.col("first")).alias("event_time"), F.coalesce("ever", F.lit(False)).alias("ever"))


@query("p22_fill_policy", """SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(u, false) AS any_urgent, a AS avg_price FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n, bool_or(o_orderpriority = '1-URGENT') AS u, round(avg(o_totalprice), 4) AS a FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey""")
def p22(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 400000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"))
    return T.left_fill(t(spark, d, "customer").select("c_custkey"), o.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], {"n_orders": 0, "any_urgent": False})


@query("p23_derived_share", """SELECT o_custkey, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) END AS final_share,
  CASE WHEN sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice ELSE 0 END) > 0 THEN round(1 - sum(CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice ELSE 0 END), 9) END AS moved FROM orders GROUP BY 1""")
def p23(spark, d):
    low = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice")).otherwise(0)
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count(F.lit(1)).alias("n"), F.sum(low).alias("b"), F.sum(F.when(F.col("o_orderstatus") == "F", low).otherwise(0)).alias("a"))
    return g.select("o_custkey", C.share(F.col("f"), F.col("n")).alias("final_share"), F.round(1 - C.share(F.col("a"), F.col("b")), 9).alias("moved"))


@query("p24_year_columns", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN year(l_shipdate) < 1998 THEN l_discount + l_tax WHEN year(l_shipdate) < 2000 THEN l_discount ELSE l_tax END AS rate FROM lineitem""")
def p24(spark, d):
    y = F.year("l_shipdate")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(y < 1998, F.col("l_discount") + F.col("l_tax")).when(y < 2000, F.col("l_discount")).otherwise(F.col("l_tax")).alias("rate"))


@query("p25_distance_bin", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 10 THEN '0-10m' WHEN l_quantity <= 20 THEN '10-20m' WHEN l_quantity <= 40 THEN '20-40m' ELSE 'beyond_40m' END AS dist_bin FROM lineitem""")
def p25(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.distance_bin(F.col("l_quantity"), [10, 20, 40]).alias("dist_bin"))


@query("p26_loudness", """SELECT p_partkey, round(100 * pow(greatest(p_size * 10.0::DOUBLE, 25.0) / 25.0, -0.6) * (1 - pow(2.0, -0.7)), 6) AS reduction_pct FROM part""")
def p26(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(C.loudness_reduction_pct(F.col("p_size") * 10.0), 6).alias("reduction_pct"))


@query("p27_delay_columns", """SELECT event_id, (epoch_us(ts) - epoch_us(prev)) / 60e6 AS delay_min, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, event_type = 'click' AS is_click
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)""")
def p27(spark, d):
    e = t(spark, d, "events").withColumn("prev", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("event_id", C.minutes_between(F.col("ts"), F.col("prev")).alias("delay_min"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), (F.col("event_type") == "click").alias("is_click"))


@query("p28_classification", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 5000 THEN 'machines' WHEN c_acctbal > 7500 THEN 'rich' ELSE 'other' END AS class FROM customer""")
def p28(spark, d):
    b = F.col("c_acctbal")
    return t(spark, d, "customer").select("c_custkey", C.first_match([(b < 0, "debt"), ((F.col("c_mktsegment") == "MACHINERY") & (b > 5000), "machines"), (b > 7500, "rich")], "other").alias("class"))


@query("p29_log_standardise", """WITH u AS (SELECT o_custkey, CASE WHEN sum(o_totalprice) > 0 THEN ln(sum(o_totalprice)) END AS v FROM orders GROUP BY 1), s AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM u)
  SELECT o_orderkey, round((v - m) / sd, 6) AS z FROM orders JOIN u USING (o_custkey), s""")
def p29(spark, d):
    o = t(spark, d, "orders")
    units = o.groupBy("o_custkey").agg(C.log_positive(F.sum("o_totalprice")).alias("v"))
    return o.join(T.standardise_entities(units, "v", "z"), "o_custkey").select("o_orderkey", F.round("z", 6).alias("z"))


@query("p30_prefixed_column", "SELECT c_custkey AS area_id, c_name, 'v1' AS vintage FROM customer")
def p30(spark, d):
    return T.prefixed_column(t(spark, d, "customer"), "c_cust", "area_id").select("area_id", "c_name", F.lit("v1").alias("vintage"))


@query("p31_code_pattern", r"SELECT p_partkey, CAST(substr(p_brand, 7) AS INTEGER) AS brand_no FROM part WHERE regexp_full_match(p_brand, 'Brand#[12]\d')")
def p31(spark, d):
    return t(spark, d, "part").where(F.col("p_brand").rlike(r"^Brand#[12]\d$")).select("p_partkey", F.substring("p_brand", 7, 9).try_cast("int").alias("brand_no"))


@query("p32_roster", "SELECT DISTINCT n_name FROM nation WHERE n_nationkey BETWEEN 1 AND 20")
def p32(spark, d):
    return T.roster(t(spark, d, "nation"), "n_nationkey", 1, 20, "n_name")


@query("p33_release_tag", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders WHERE year(o_orderdate) >= 2000")
def p33(spark, d):
    tag = F.lower(F.date_format("o_orderdate", "MMMyy"))
    y, m = C.release_tag(F.col("tag"))
    return t(spark, d, "orders").where(F.year("o_orderdate") >= 2000).select(tag.alias("tag")).distinct().select(y.alias("year"), m.alias("month"))


@query("x02_number_parser", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price FROM lineitem")
def x02(spark, d):
    raw = F.regexp_replace(F.format_number("l_extendedprice", 2), ",", " ")
    li = t(spark, d, "lineitem").withColumn("raw", F.regexp_replace(raw, r"\.", ","))
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION parse_number_se(x STRING) RETURNS DOUBLE RETURN try_cast(replace(regexp_replace(x, '[ \\s~]', ''), ',', '.') AS DOUBLE)")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.expr("parse_number_se(raw)").alias("price"))
