"""Queries over scans, sinks and streams (S and V operators). Files are written out of the driver's tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelworks.operators import aggregate as A
from panelworks.operators import tables as T
from panelworks.plans.registry import query
from panelworks.session import table as t
from panelworks.session import work_dir
from panelworks.sources import readers as R
from panelworks.sources import registers as G
from panelworks.streaming import feeds

LI = "l_orderkey, l_linenumber, l_partkey"


def new(spark, name):
    return f"{work_dir(spark)}/panelworks/{name}-{uuid.uuid4().hex[:12]}"


@query("s01_stage_artifact", "SELECT c_custkey, c_mktsegment FROM customer")
def s01(spark, d):
    assert R.artifact(spark, d, "not_built", optional=True) is None
    return R.artifact(spark, d, "customer").select("c_custkey", "c_mktsegment")


@query("s02_yearly_union", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM (SELECT DISTINCT * FROM orders) GROUP BY 1")
def s02(spark, d):
    base, o = new(spark, "yearly"), t(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    for k in range(2):  # the same rows twice, and one part with a column less
        (o if k else o.where("y < 1998")).drop("y").write.parquet(f"{base}/orders_{k}")
    return R.yearly_union(spark, f"{base}/orders_*").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("s03_file_name_parts", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderstatus AS status, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1996, 1998) GROUP BY 1, 2")
def s03(spark, d):
    base = new(spark, "named")
    t(spark, d, "orders").select("o_orderkey", F.concat_ws("_", F.lit("T"), F.year("o_orderdate"), "o_orderstatus").alias("name")).write.partitionBy("name").csv(base, header=True)
    df = R.named_files(spark, base, "name=T_{year}_*/*.csv", r"name=T_(\d{4})_(\w)", ["year", "status"], "o_orderkey long", [1996, 1998])
    return df.groupBy("year", "status").agg(F.count(F.lit(1)).alias("n"))


@query("s04_csv_split_by_year", "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R' AND year(l_shipdate) IN (1997, 1999) GROUP BY 1")
def s04(spark, d):
    csv = new(spark, "csv")
    t(spark, d, "lineitem").select("l_partkey", F.when(F.col("l_linenumber") > 0, F.col("l_returnflag")).alias("flag"), "l_quantity", F.year("l_shipdate").alias("year")).write.csv(csv, header=True)
    out = R.split_by_year(spark, csv, new(spark, "split"), "l_partkey long, flag string, l_quantity double, year int", (F.col("flag") == "R") & F.col("year").isin(1997, 1999), "year")
    return out.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("s05_comment_block", "SELECT CAST(c_custkey AS VARCHAR) AS k, c_mktsegment AS segment, '2.1' AS version FROM customer")
def s05(spark, d):
    path = new(spark, "comment")
    c = t(spark, d, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("# version 2.1\nk;segment\n"), F.array_join(F.collect_list(F.concat_ws(";", "c_custkey", "c_mktsegment")), "\n")).alias("value"))
    c.write.partitionBy("c_nationkey").text(path)
    version = R.comment_value(spark, path, r"version (\S+)").distinct()
    return R.commented(spark, f"{path}/*/*.txt").crossJoin(F.broadcast(version)).select("k", "segment", F.col("value").alias("version"))


@query("s06_tsv", "SELECT CAST(p_partkey AS VARCHAR) AS part, p_brand AS brand FROM part")
def s06(spark, d):
    path = new(spark, "tsv")
    t(spark, d, "part").select(F.col("p_partkey").alias(" part "), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias(" ")).write.csv(path, sep="\t", header=True)
    return R.tsv(spark, path)


@query("s07_banner_csv", "SELECT c_nationkey AS site, name, count(*) AS n FROM customer, (SELECT unnest(['k', 'Money - balance', 'Money - half']) AS name) GROUP BY 1, 2")
def s07(spark, d):
    path = new(spark, "banner")
    c = t(spark, d, "customer").select("c_nationkey", F.concat_ws(";", "c_custkey", "c_acctbal", F.col("c_acctbal") / 2).alias("line"))
    head = F.concat(F.lit("A banner\n;Money;\nk;balance;half\n"))
    c.groupBy("c_nationkey").agg(F.concat(head, F.array_join(F.collect_list("line"), "\n")).alias("value")).write.partitionBy("c_nationkey").text(path)
    rows = R.banner_csv(spark, f"{path}/*/*.txt", "k")
    return rows.groupBy(F.regexp_extract("file", r"c_nationkey=(\d+)", 1).cast("int").alias("site"), "name").agg(F.count(F.lit(1)).alias("n"))


@query("s08_sheet_cells", "SELECT c_nationkey AS sheet, c_custkey AS row, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment FROM customer")
def s08(spark, d):
    c = t(spark, d, "customer")
    cell = lambda row, col, v: F.struct(row.cast("long").alias("row"), F.lit(col).alias("col"), v.cast("string").alias("value"))
    body = c.select("c_nationkey", F.explode(F.array(cell(F.col("c_custkey") + 10, 0, F.col("c_mktsegment")), cell(F.col("c_custkey") + 10, 2, F.col("c_custkey")))).alias("c"))
    head = c.select("c_nationkey").distinct().select("c_nationkey", F.explode(F.array(cell(F.lit(1), 0, F.lit("A title")), cell(F.lit(4), 0, F.lit(" Segment")), cell(F.lit(4), 2, F.lit("ID number")))).alias("c"))
    cells = head.unionByName(body).select(F.lit("f").alias("file"), F.col("c_nationkey").alias("sheet"), "c.*")
    out = R.sheet_rows(cells, {"segment": "segment", "id number": "id", "number": "id"}, "id number")
    return out.select("sheet", (F.col("row") - 10).alias("row"), "id", "segment")


@query("s09_nested_register", """SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN 'street ' || c_nationkey END AS street, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS easting, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS owner_number,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'gr' ELSE 'fsk,gr' END AS school_types, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 9 = 3 END AS ak4 FROM customer""")
def s09(spark, d):
    k, js = F.col("c_custkey"), F.to_json
    organizer = F.struct(F.lit("organizer").alias("type"), F.col("c_nationkey").cast("string").alias("organizationNumber"))
    other = F.struct(F.lit("other").alias("type"), F.lit("0").alias("organizationNumber"))
    included = F.when(k % 5 == 0, js(F.array(other))).when(k % 2 == 0, js(organizer)).otherwise(js(F.array(other, organizer)))
    address = lambda kind, street: F.struct(F.lit(kind).alias("type"), street.alias("streetAddress"), F.struct(F.regexp_replace(F.col("c_acctbal").cast("string"), r"\.", ",").alias("coordinateSweRefE")).alias("geoCoordinates"))
    box, visit = address("BOX", F.lit("box")), address("BESOKSADRESS", F.concat(F.lit("street "), F.col("c_nationkey")))
    attributes = F.struct(F.col("c_name").alias("displayName"), F.when(k % 4 == 0, F.array(box)).otherwise(F.array(box, visit, box)).alias("addresses"), F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("gr"), F.lit("gr"))).otherwise(F.array(F.lit("gr"), F.lit("fsk"))).alias("schoolTypes"),
                          F.when(k % 3 != 0, F.struct(F.struct(F.array((k % 9 + 1).cast("string")).alias("grades")).alias("gr"))).alias("schoolTypeProperties"))
    text = F.concat(F.lit('{"included":'), included, F.lit(',"data":'), js(F.struct(k.cast("string").alias("schoolUnitCode"), attributes.alias("attributes"))), F.lit("}"))
    return G.register_rows(t(spark, d, "customer").select(text.alias("value"))).select("code", "name", "street", "easting", "owner_number", "school_types", "ak4")


@query("s10_cube_rows", "SELECT l_suppkey, l_returnflag AS flag_code, l_linestatus AS status_code, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3")
def s10(spark, d):
    flags, states = ["A", "N", "R"], ["F", "O"]
    cell = [F.sum(F.when((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b), F.col("l_quantity"))) for a in flags for b in states]
    cubes = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array(*cell).alias("value")).withColumn("status", F.create_map(F.lit("99"), F.lit("x")))
    return R.cube_rows(cubes, [("flag", flags), ("status", states)]).where("value is not null").drop("status")


@query("s11_map_features", """WITH w AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber > 1) AS m FROM lineitem GROUP BY 1) SELECT l_orderkey AS osm_id, CASE WHEN l_orderkey % 2 = 0 AND m >= 2 THEN 'noise_barrier' ELSE 'untyped_wall' END AS wall_type, CASE WHEN l_orderkey % 2 = 0 AND m >= 2 THEN 'wood' END AS material, CAST(CASE WHEN l_orderkey % 2 = 0 AND m >= 2 THEN m ELSE n END AS INTEGER) AS n_nodes FROM w WHERE n >= 2""")
def s11(spark, d):
    node = F.struct(F.col("l_quantity").alias("lon"), F.col("l_tax").alias("lat"))
    li = t(spark, d, "lineitem")
    way = lambda rows, tags: rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(node).alias("geometry")).select(F.struct(F.lit("way").alias("type"), "id", tags.alias("tags"), "geometry").alias("e"))
    answer = lambda rows, kind: rows.select(F.lit(kind).alias("wall_type"), F.to_json(F.struct(F.array("e").alias("elements"))).alias("value"))
    untyped = answer(way(li, F.create_map(F.lit("barrier"), F.lit("wall"))), "untyped_wall")
    typed = answer(way(li.where("l_orderkey % 2 = 0 and l_linenumber > 1"), F.create_map(F.lit("material"), F.lit("wood"))), "noise_barrier")
    return G.map_ways(untyped.unionByName(typed), ["noise_barrier", "untyped_wall"]).select("osm_id", "wall_type", "material", F.size("coords").alias("n_nodes"))


@query("s12_feature_pages", "SELECT c_custkey % 300 AS code, min(c_custkey) AS k FROM customer GROUP BY 1")
def s12(spark, d):
    pages = t(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 300).alias("page")).agg(F.collect_list(F.struct((F.col("c_custkey") % 300).alias("code"), F.col("c_custkey").alias("k"))).alias("features"))
    return R.features(pages, "features", "code")


@query("s13_record_lists", """SELECT conv_id, string_agg(role, ' | ' ORDER BY turn) AS FromLocation, CASE WHEN count(*) > 2 THEN '["x"]' END AS Deviation FROM conversations GROUP BY 1""")
def s13(spark, d):
    stop = F.struct(F.col("role").alias("LocationName"), F.col("turn").cast("int").alias("Order"))
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(stop).alias("stops"), F.count(F.lit(1)).alias("n"))
    route = F.when(F.col("n") == 1, F.to_json(F.col("stops")[0])).otherwise(F.to_json("stops"))
    item = F.concat(F.lit('{"conv_id":'), F.col("conv_id"), F.lit(',"FromLocation":'), route, F.lit(',"Deviation":'), F.when(F.col("n") > 2, '["x"]').otherwise("[]"), F.lit("}"))
    answers = c.select(F.concat(F.lit('{"RESPONSE":{"RESULT":[{"TrainAnnouncement":['), item, F.lit("]}]}}")).alias("value"))
    return G.record_lists(answers, "TrainAnnouncement", {"conv_id": "long"}, ["FromLocation"], ["Deviation"])


@query("s14_torn_lines", "SELECT count(*) FILTER (WHERE c_custkey % 10 <> 0) AS good, count(*) FILTER (WHERE c_custkey % 10 = 0) AS torn FROM customer")
def s14(spark, d):
    path = new(spark, "torn")
    js = F.to_json(F.struct("c_custkey", "c_mktsegment"))
    t(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 == 0, F.substring(js, 1, 9)).otherwise(js).alias("value")).write.text(path)
    lines = R.torn_lines(spark, path, "c_custkey long, c_mktsegment string").select("c_custkey", "_bad")
    return lines.agg(F.count_if(F.col("_bad").isNull() & F.col("c_custkey").isNotNull()).alias("good"), F.count_if(F.col("_bad").isNotNull()).alias("torn"))


@query("s15_validity_union", "SELECT o_custkey AS unit, count(*) AS n, count(CASE WHEN o_orderkey % 5 <> 0 THEN 1 END) AS known, sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END) AS total FROM orders GROUP BY 1")
def s15(spark, d):
    """Order windows in four overlapping layers as one. A placeholder stands for unknown values, so it is none that an order key takes."""
    unknown = -999998
    w = T.order_windows(t(spark, d, "orders")).select(F.col("o_custkey").alias("OBJECT"), F.col("o_orderkey").alias("ID"), "valid_from", "valid_to", F.when(F.col("o_orderkey") % 5 == 0, unknown).otherwise(F.col("o_orderkey")).alias("ADT"))
    orders = [w.where(f"ID % {m} = {r}").withColumn("geometry", F.lit(f"line {m}")) for m, r in ((3, 0), (3, 1), (3, 2), (2, 0))]
    out = G.dated_union(orders, {"OBJECT": "unit", "ID": "id", "valid_from": "valid_from", "valid_to": "valid_to", "ADT": "adt"}, "geometry", unknown, ["adt"])
    return out.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count("adt").alias("known"), F.sum("adt").alias("total"))


@query("s16_sink_report", "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_units, round(max(o_totalprice), 2) AS top FROM orders")
def s16(spark, d):
    return R.sink_with_report(t(spark, d, "orders"), new(spark, "sink"), {"n_rows": F.count(F.lit(1)), "n_units": F.count_distinct("o_custkey"), "top": F.round(F.max("o_totalprice"), 2)})


@query("s17_csv_export", "SELECT lpad(CAST(c_custkey AS VARCHAR), 13, '0') AS cell_id, CAST(c_custkey // 10000000 AS INTEGER) AS sweref_e, CAST(c_custkey % 10000000 AS INTEGER) AS sweref_n, CAST(c_acctbal > 0 AS INTEGER) AS positive, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS machines, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_nationkey AS INTEGER) END AS year FROM customer WHERE c_acctbal > 0 OR c_mktsegment = 'MACHINERY'")
def s17(spark, d):
    c = t(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 13, "0").alias("cell_id"), (F.col("c_acctbal") > 0).alias("positive"), (F.col("c_mktsegment") == "MACHINERY").alias("machines"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey").cast("double")).alias("year"))
    return G.flag_export(c, new(spark, "export"), "cell_id", ["positive", "machines"], ["year"])


@query("s18_kind_stack", "SELECT s_suppkey, s_nationkey FROM supplier")
def s18(spark, d):
    path = new(spark, "stack")
    c, s = t(spark, d, "customer").withColumn("kind", F.lit("customer")), t(spark, d, "supplier").withColumn("kind", F.lit("supplier"))
    c.unionByName(s, allowMissingColumns=True).write.partitionBy("kind").parquet(path)
    one = spark.read.parquet(path).where("kind = 'supplier'")
    return one.select("s_suppkey", "s_nationkey")


@query("v01_answer_log", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def v01(spark, d):
    base, out = new(spark, "log"), new(spark, "latest")
    e = t(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    e.repartition(3).write.parquet(base)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(base)
    feeds.logged(stream, ["user_id", "event_type"], "ts", out)
    log = spark.read.schema(f"{e.schema.simpleString()[7:-1]}, batch long".replace(":", " ")).parquet(out)
    return feeds.current(log, ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("v02_delay_feed", """WITH e AS (SELECT ts, value FROM events), w AS (SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean_delay FROM e GROUP BY 1) SELECT start, n, mean_delay FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR""")
def v02(spark, d):
    base, out = new(spark, "feed"), new(spark, "windows")
    e = t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    e.unionByName(e.where("event_id % 7 = 0")).write.parquet(base)
    stream = spark.readStream.schema(e.schema).parquet(base)
    feeds.drained(feeds.tumbling_delay(stream, "ts", "value"), out)
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean_delay", 6).alias("mean_delay"))


@query("x03_group_apply", """WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders)
  SELECT o_custkey, o_orderkey, round(avg(y) OVER w + coalesce(covar_pop(k, y) OVER w / nullif(var_pop(k) OVER w, 0), 0) * (k - avg(k) OVER w), 4) AS trend FROM x WINDOW w AS (PARTITION BY o_custkey)""")
def x03(spark, d):
    """Each customer's straight trend over its orders, by a Python function for each group."""
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("double").alias("y"))
    return T.group_apply(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], T.trend("y"), "o_custkey long, o_orderkey long, trend double").withColumn("trend", F.round("trend", 4))


@query("x04_table_function", "SELECT p_partkey, CAST(x * 2 AS BIGINT) AS easting, CAST(y * 2 AS BIGINT) AS northing FROM (SELECT p_partkey, unnest(range(p_size % 7 // 2, (p_size % 7 + 5) // 2 + 1)) AS x, p_size FROM part), (SELECT unnest(range(0, 12)) AS y) WHERE y BETWEEN p_size % 5 // 2 AND (p_size % 5 + 3) // 2")
def x04(spark, d):
    """The 2 m cells that a box touches, by a table function joined laterally."""
    a, b = F.col("p_size") % 7, F.col("p_size") % 5
    boxes = t(spark, d, "part").select("p_partkey", a.cast("double").alias("x1"), (a + 5).cast("double").alias("x2"), b.cast("double").alias("y1"), (b + 3).cast("double").alias("y2"))
    return T.lateral(boxes, T.tiles, ["x1", "y1", "x2", "y2"], {"resolution": 2}).select("p_partkey", "easting", "northing")
