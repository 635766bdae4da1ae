"""Queries over annotation (B operators). A line item is an answer: its part is the task, its supplier mod 4 the reviewer (3 adjudicates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import aggregate as A
from panelworks.operators import annotate as B
from panelworks.operators import roads
from panelworks.plans import q_network as R
from panelworks.plans.q_spatial import BOTH, SIDE, lines, points
from panelworks.plans.registry import ORACLES, query
from panelworks.session import saved
from panelworks.session import table as t

ANS = """SELECT l_partkey AS task, l_suppkey % 4 AS reviewer, l_orderkey * 10 + l_linenumber AS tm, CASE WHEN l_linenumber <= 5 THEN 'aligned' ELSE 'skipped' END AS status, CASE WHEN l_linenumber <= 5 THEN l_quantity - 25 END AS lat_m, CASE WHEN l_tax > 0.07 THEN 1.0 END AS other, CASE WHEN l_returnflag <> 'N' THEN 'occluded' END AS reason FROM lineitem"""
CAT = "CASE WHEN status = 'aligned' THEN CASE WHEN other IS NOT NULL THEN 'both_sides' WHEN lat_m >= 2 THEN 'left' WHEN lat_m <= -2 THEN 'right' ELSE 'centre' END ELSE coalesce(reason, 'unsure') END"
LAST = f"(SELECT task, reviewer, arg_max(category, (tm, category, coalesce(lat_m, 1e9))) AS category, arg_max(coalesce(lat_m, 1e9), (tm, category, coalesce(lat_m, 1e9))) AS lat_m FROM (SELECT *, {CAT} AS category FROM ({ANS})) GROUP BY 1, 2)"


def answers(spark, d):
    li, n = t(spark, d, "lineitem"), F.col("l_linenumber")
    a = li.select(F.col("l_partkey").alias("task"), (F.col("l_suppkey") % 4).alias("reviewer"), (F.col("l_orderkey") * 10 + n).alias("at"), F.when(n <= 5, "aligned").otherwise("skipped").alias("status"),
                  F.when(n <= 5, F.col("l_quantity") - 25).alias("lat_m"), F.when(F.col("l_tax") > 0.07, 1.0).alias("other"), F.when(F.col("l_returnflag") != "N", "occluded").alias("reason"))
    return a.withColumn("category", B.category(F.col("status"), F.col("lat_m"), F.col("other"), F.col("reason")))


def latest(spark, d):
    return answers(spark, d).groupBy("task", "reviewer").agg(F.max_by(F.struct("category", "lat_m"), F.struct("at", "category", F.coalesce("lat_m", F.lit(1e9)))).alias("a")).select("task", "reviewer", "a.*")


@query("b01_stratified_sample")
def b01(spark, d):
    """Targets, validation and practice out of all parts."""
    k = F.col("p_partkey")
    p = t(spark, d, "part").select(k.alias("record"), F.when(k % 2 == 0, "road").otherwise("rail").alias("kind"), F.element_at(F.array(*[F.lit(m) for m in ("osm_offset", "geometric_offset", "parallel_road")]), (k % 3 + 1).cast("int")).alias("method"), (k % 7 != 0).alias("known"),
                                   (F.col("p_size") > 10).alias("long_enough"), (k % 2 == 0).alias("tagged"), (k % 11 == 0).alias("twin"), (k % 13 == 0).alias("paired"), "p_size")
    before = t(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("record"), F.when(F.col("l_linenumber") == 1, "target").otherwise("validation").alias("group"))
    return B.select_records(p, F.col("p_size") % 10 == 0, F.col("p_size") == 1, before, ["osm_offset", "geometric_offset", "parallel_road"], 5, 7, 11)


@query("b02_priority_tiers", "SELECT l_partkey, CAST(min(CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 1 WHEN l_returnflag = 'R' THEN 2 WHEN l_quantity > 40 THEN 3 ELSE 4 END) AS INTEGER) AS tier, bool_or(l_linenumber = 1) AS dated FROM lineitem GROUP BY 1")
def b02(spark, d):
    r, q = F.col("l_returnflag") == "R", F.col("l_quantity") > 40
    return t(spark, d, "lineitem").groupBy("l_partkey").agg(F.min(F.when(r & q, 1).when(r, 2).when(q, 3).otherwise(4)).alias("tier"), F.bool_or(F.col("l_linenumber") == 1).alias("dated"))


@query("b03_batches")
def b03(spark, d):
    """Parts as tasks at the places of the points, sites of one supplier's size."""
    p = points(spark, d).select(F.col("vec_id").alias("task"), F.floor(F.col("vec_id") / 4).alias("site"), (F.col("label") % 3).alias("class"), "x", "y")
    return B.site_order(p, 4, 25.0)


def walls_of(spark, d):
    """(chosen, chains, apart, lengths): pieces of walls out of the road segments."""
    pieces = R.road_lines(spark, d, 0.05)
    chains = saved(roads.chain_lines(pieces), "chains")
    apart = roads.co_located(pieces, within_m=2.0)
    lengths = pieces.select(F.col("line").alias("record"), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length_m"))
    chosen = lengths.where("record % 3 = 0").select("record", F.when(F.col("record") % 12 == 0, "practice").when(F.col("record") % 6 == 0, "validation").otherwise("target").alias("group"))
    return chosen, chains.select(F.col("line").alias("record"), "chain", "orient"), apart, lengths, pieces


@query("b04_task_units")
def b04(spark, d):
    chosen, chains, apart, lengths, _ = walls_of(spark, d)
    units = saved(B.task_units(chosen, chains, apart, lengths), "units")
    records = lengths.withColumns({"material": F.when(F.col("record") % 5 != 0, F.concat(F.lit("m"), F.col("record") % 3)), "height": F.col("record") % 4 + 1})
    return B.unit_metadata(units, records).withColumn("length_m", F.round("length_m", 3))


@query("b05_categories", f"SELECT {CAT} AS category, count(*) AS n FROM ({ANS}) GROUP BY 1")
def b05(spark, d):
    return answers(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("b06_consensus", f"""WITH l AS (SELECT task, reviewer, a.category AS category, a.lat_m AS lat_m, a.other AS other, a.category IN ('left', 'right', 'centre', 'both_sides') AS votes FROM
  (SELECT task, reviewer, arg_max({{'category': category, 'lat_m': lat_m, 'other': other}}, (tm, category, coalesce(lat_m, 1e9), coalesce(other, 1e9))) AS a FROM (SELECT *, {CAT} AS category FROM ({ANS})) GROUP BY 1, 2)),
  g AS (SELECT task, count(*) AS n_reviewers, list_sort(list(DISTINCT category) FILTER (WHERE votes)) AS s, max(category) FILTER (WHERE reviewer = 3 AND votes) AS adj FROM l GROUP BY 1),
  k AS (SELECT *, coalesce(len(s), 0) > 1 AND adj IS NOT NULL AS adjudicated, CASE WHEN len(s) > 1 THEN adj WHEN len(s) = 1 THEN s[1] END AS category FROM g),
  m AS (SELECT k.task, avg(l.lat_m) AS lat_m, avg(l.other) AS other FROM k JOIN l ON l.task = k.task AND l.category = k.category AND (NOT adjudicated OR reviewer = 3) GROUP BY 1)
  SELECT task, n_reviewers, coalesce(array_to_string(s, ','), '') AS sides, CASE WHEN coalesce(len(s), 0) = 0 THEN 'unsure' WHEN category IS NULL THEN 'conflict' WHEN category IN ('left', 'right') THEN 'side' ELSE category END AS decision, category, adjudicated,
  CASE WHEN category <> 'centre' THEN round(lat_m, 6) END AS lat_m, CASE WHEN category = 'both_sides' THEN round(other, 6) END AS lat_other_m FROM k LEFT JOIN m USING (task)""")
def b06(spark, d):
    return B.consensus(answers(spark, d).withColumn("reviewer", F.col("reviewer").cast("string")), "task", "3")


@query("b07_agreement_interval", f"""WITH g AS (SELECT reviewer, count(*) AS n, count(*) FILTER (WHERE category = 'left') AS k FROM {LAST} GROUP BY 1) SELECT reviewer, n, k, round(k / n, 6) AS share, round((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS low,
  round((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS high FROM g""")
def b07(spark, d):
    return B.agreement(latest(spark, d), ["reviewer"], F.col("category") == "left")


@query("b08_kappa", f"""WITH p AS (SELECT x.category AS a, y.category AS b FROM {LAST} x JOIN {LAST} y ON x.task = y.task AND x.reviewer = 0 AND y.reviewer = 1), n AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS po FROM p),
  e AS (SELECT sum(u.c * v.c) AS s FROM (SELECT a, count(*) AS c FROM p GROUP BY 1) u JOIN (SELECT b, count(*) AS c FROM p GROUP BY 1) v ON u.a = v.b) SELECT n, round(po, 6) AS observed, round((po - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM n, e""")
def b08(spark, d):
    last = latest(spark, d)
    x, y = last.where("reviewer = 0").select("task", F.col("category").alias("a")), last.where("reviewer = 1").select("task", F.col("category").alias("b"))
    return B.kappa(x.join(y, "task"), "a", "b")


@query("b09_practice_accuracy", f"SELECT reviewer, count(*) AS n, round(avg(CASE WHEN sign(lat_m) = CASE WHEN task % 2 = 0 THEN 1 ELSE -1 END THEN 1.0 ELSE 0 END), 9) AS right_side, round(quantile_cont(abs(lat_m - (task % 40 - 20)), 0.5), 6) AS median_error FROM ({ANS}) WHERE lat_m IS NOT NULL GROUP BY 1")
def b09(spark, d):
    a = answers(spark, d).where("lat_m is not null")
    ok = F.signum("lat_m") == F.when(F.col("task") % 2 == 0, 1.0).otherwise(-1.0)
    median = A.exact_cuts(a.withColumn("off", F.abs(F.col("lat_m") - (F.col("task") % 40 - 20))), "off", [0.5], ["reviewer"])
    share = a.groupBy("reviewer").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("double")), 9).alias("right_side"))
    return share.join(median, "reviewer").select("reviewer", "n", "right_side", F.round(F.col("cuts")[0], 6).alias("median_error"))


@query("b10_manual_sign", f"SELECT vec_id AS record, CASE WHEN vec_id % 9 = 0 THEN 0 ELSE s END AS sign FROM (SELECT vec_id, {SIDE} AS s FROM {BOTH}) WHERE vec_id % 9 = 0 OR s <> 0 AND vec_id % 4 <> 0")
def b10(spark, d):
    p = points(spark, d).withColumn("line_id", F.floor(F.col("vec_id") / 5) * 5).join(lines(spark, d), "line_id")
    decision = F.when(F.col("vec_id") % 9 == 0, "both_sides").when(F.col("vec_id") % 4 == 0, "conflict").otherwise("side")
    own = p.select(F.col("vec_id").alias("record"), F.lit(0).alias("seq"), "x1", "y1", "x2", "y2")
    return B.manual_signs(p.select(F.col("vec_id").alias("record"), decision.alias("decision"), "x", "y"), own)


@query("b11_import_guard", "SELECT l_suppkey AS batch, count(DISTINCT l_returnflag) AS n_reviewers, count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)) AS n_unknown, count(*) >= 500 AS enough FROM lineitem GROUP BY 1")
def b11(spark, d):
    known = t(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    j = t(spark, d, "lineitem").join(known, "l_partkey", "left")
    return j.groupBy(F.col("l_suppkey").alias("batch")).agg(F.count_distinct("l_returnflag").alias("n_reviewers"), F.count_if(F.col("known").isNull()).alias("n_unknown"), (F.count(F.lit(1)) >= 500).alias("enough"))


@query("b12_record_validation", f"""SELECT coalesce(r, 'good') AS result, count(*) AS n FROM (SELECT CASE WHEN task NOT IN (SELECT p_partkey FROM part WHERE p_size > 2) THEN 'unknown task' WHEN status = 'aligned' AND lat_m IS NULL THEN 'no position' WHEN status = 'aligned' AND abs(lat_m) > 40 THEN 'position out of range'
  WHEN status = 'skipped' AND reason IS NULL THEN 'no reason' END AS r FROM ({ANS})) GROUP BY 1""")
def b12(spark, d):
    tasks = t(spark, d, "part").where("p_size > 2").select(F.col("p_partkey").alias("task"))
    return B.validated(answers(spark, d), tasks, "task").groupBy(F.coalesce("reject_reason", F.lit("good")).alias("result")).agg(F.count(F.lit(1)).alias("n"))


@query("b13_task_document")
def b13(spark, d):
    """Each task's document with the number of its key rows."""
    chosen, chains, apart, lengths, pieces = walls_of(spark, d)
    units = saved(B.task_units(chosen, chains, apart, lengths), "units")
    own = units.where("strand = 0").join(pieces.withColumnRenamed("line", "record"), "record")
    drawn = saved(own.select("unit", F.col("record").cast("int").alias("seq"), "x1", "y1", "x2", "y2"), "drawn")
    centers = drawn.groupBy("unit").agg(F.avg((F.col("x1") + F.col("x2")) / 2).alias("x"), F.avg((F.col("y1") + F.col("y2")) / 2).alias("y"))
    keys = saved(B.task_keys(units, drawn, centers, pieces.withColumnRenamed("line", "record"), "one", 5, 0.2), "keys")
    records = lengths.withColumns({"material": F.when(F.col("record") % 5 != 0, F.concat(F.lit("m"), F.col("record") % 3)), "height": F.col("record") % 4 + 1})
    n = keys.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_keys"), F.bool_or("double_code").alias("double_code"))
    return B.task_document(keys, B.unit_metadata(units, records), drawn).join(n, "task_id")


@query("b07_validation_report", f"""WITH c AS ({ORACLES["b06_consensus"]}), u AS (SELECT task, bool_or(other IS NOT NULL) AS streetview, bool_or(reason IS NOT NULL) AS satellite FROM ({ANS}) GROUP BY 1),
  r AS (SELECT p_brand AS method, decision, CASE category WHEN 'left' THEN 1 WHEN 'right' THEN -1 END AS m, CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS s, c.task // 4 AS wall, streetview, satellite FROM c JOIN part ON p_partkey = c.task JOIN u ON u.task = c.task),
  a AS (SELECT *, unnest(list_filter(['all', CASE WHEN streetview THEN 'streetview' END, CASE WHEN satellite THEN 'satellite' END], lambda x: x IS NOT NULL)) AS aid, decision = 'side' AND m IS NOT NULL AS sided FROM r),
  g AS (SELECT method, aid, count(*) AS n, count(*) FILTER (WHERE sided) AS n_sided, count(DISTINCT wall) FILTER (WHERE sided) AS n_walls, count(*) FILTER (WHERE sided AND m = s) AS agree, nullif(count(*) FILTER (WHERE sided), 0) AS k FROM a GROUP BY 1, 2)
  SELECT method, aid, n, n_sided, n_walls, agree, round(agree / k, 3) AS share, round((agree / k + 1.96 * 1.96 / (2 * k)) / (1 + 1.96 * 1.96 / k) - 1.96 * sqrt(agree / k * (1 - agree / k) / k + 1.96 * 1.96 / (4.0 * k * k)) / (1 + 1.96 * 1.96 / k), 3) AS low,
  round((agree / k + 1.96 * 1.96 / (2 * k)) / (1 + 1.96 * 1.96 / k) + 1.96 * sqrt(agree / k * (1 - agree / k) / k + 1.96 * 1.96 / (4.0 * k * k)) / (1 + 1.96 * 1.96 / k), 3) AS high FROM g""")
def b07_report(spark, d):
    """Consensus sides against the automatic sides of each method, in all and by aid."""
    a = answers(spark, d).withColumn("reviewer", F.col("reviewer").cast("string"))
    used = a.groupBy("task").agg(F.bool_or(F.col("other").isNotNull()).alias("streetview"), F.bool_or(F.col("reason").isNotNull()).alias("satellite"))
    p = t(spark, d, "part").select(F.col("p_partkey").alias("task"), F.col("p_brand").alias("method"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1).alias("barrier_sign"))
    c = B.consensus(a, "task", "3").select("task", "decision", F.when(F.col("category") == "left", 1).when(F.col("category") == "right", -1).alias("manual_sign"))
    return B.validation_report(c.join(p, "task").join(used, "task").withColumn("task", F.floor(F.col("task") / 4)), ["streetview", "satellite"])


@query("b08_double_coding", f"""WITH p AS (SELECT x.category AS a, y.category AS b, abs(nullif(x.lat_m, 1e9) - nullif(y.lat_m, 1e9)) AS off FROM {LAST} x JOIN {LAST} y ON x.task = y.task AND x.reviewer < y.reviewer), n AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS po, quantile_cont(off, 0.5) FILTER (WHERE a = b AND a IN ('left', 'right')) AS mid FROM p),
  e AS (SELECT sum(u.c * v.c) AS s FROM (SELECT a, count(*)::DOUBLE AS c FROM p GROUP BY 1) u JOIN (SELECT b, count(*)::DOUBLE AS c FROM p GROUP BY 1) v ON u.a = v.b) SELECT n, round(po, 3) AS share_same, round((po - s / (n * n)) / (1 - s / (n * n)), 3) AS kappa, round(mid, 2) AS median_diff FROM n, e""")
def b08_report(spark, d):
    return B.double_coding(latest(spark, d).select("task", "reviewer", "category", "lat_m"))


FILES = "SELECT l_suppkey AS file, CASE WHEN l_suppkey % 7 = 0 THEN l_linenumber % 2 ELSE 0 END AS batch, CASE WHEN l_suppkey % 5 = 0 THEN l_returnflag ELSE 'A' END AS reviewer, l_partkey AS task FROM lineitem"


@query("b11_import_verdicts", f"""WITH f AS ({FILES}), g AS (SELECT file, count(*) AS n_records, count(DISTINCT batch) AS n_batches, count(DISTINCT reviewer) AS n_reviewers, count(DISTINCT task) FILTER (WHERE task NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 97 <> 5)) AS n_unknown FROM f GROUP BY 1)
  SELECT *, CASE WHEN n_batches > 1 THEN 'batches' WHEN n_reviewers > 1 THEN 'reviewers' WHEN n_unknown > 0 THEN 'unknown tasks' WHEN file % 4 = 0 THEN 'fewer than stored' ELSE 'accepted' END AS verdict FROM g""")
def b11_verdicts(spark, d):
    """Answer files against the known tasks and against what is stored: every fourth file has lost a row."""
    n = F.col("l_suppkey")
    f = t(spark, d, "lineitem").select(n.alias("file"), F.when(n % 7 == 0, F.col("l_linenumber") % 2).otherwise(0).alias("batch"), F.when(n % 5 == 0, F.col("l_returnflag")).otherwise("A").alias("reviewer"), F.col("l_partkey").alias("task"))
    tasks = t(spark, d, "part").where("p_partkey % 97 <> 5").select(F.col("p_partkey").alias("task"), F.explode(F.array(F.lit(0), F.lit(1))).alias("batch"))
    stored = f.groupBy("file").agg((F.count(F.lit(1)) + F.when(F.col("file") % 4 == 0, 1).otherwise(-1)).alias("n"))
    return B.import_verdicts(f, tasks, stored)
