"""Queries over geometry (G operators). Points are embeddings' first two components, in metres; lines join consecutive ids."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from panelworks.functions import columns as C
from panelworks.operators import geometry as G
from panelworks.operators import protection as P
from panelworks.operators import roads as R
from panelworks.operators import spatial as S
from panelworks.plans.registry import query
from panelworks.session import saved
from panelworks.session import table as t

PT = "SELECT vec_id, 1000.0 * CAST(embedding[1] AS DOUBLE) AS x, 1000.0 * CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings"
SG = f"SELECT a.vec_id AS line_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ({PT}) a JOIN ({PT}) b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 5 = 0"
FR = "CASE WHEN pow(x2 - x1, 2) + pow(y2 - y1, 2) > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) ELSE 0.0::DOUBLE END"
DIST = f"sqrt(pow(x - x1 - ({FR}) * (x2 - x1), 2) + pow(y - y1 - ({FR}) * (y2 - y1), 2))"
LEN = "sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))"
SIDE = f"CASE WHEN abs(((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / {LEN}) <= 1e-6 THEN 0 ELSE CAST(sign((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) AS INTEGER) END"
BOTH = f"({PT}) p JOIN ({SG}) s ON s.line_id = p.vec_id // 5 * 5"


def points(spark, d):
    return t(spark, d, "embeddings").select("vec_id", (1000.0 * F.col("embedding")[0].cast("double")).alias("x"), (1000.0 * F.col("embedding")[1].cast("double")).alias("y"), "label")


def lines(spark, d):
    p = points(spark, d)
    nxt = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return p.join(nxt, "vec_id").where("vec_id % 5 = 0").select(F.col("vec_id").alias("line_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def own_line(spark, d):
    return points(spark, d).withColumn("line_id", F.floor(F.col("vec_id") / 5) * 5).join(lines(spark, d), "line_id")


@query("g01_point_on_line", f"SELECT vec_id, round({FR}, 6) AS fraction, round({FR} * {LEN}, 4) AS along_m, round({DIST}, 4) AS dist FROM {BOTH}")
def g01(spark, d):
    f, dist = S.projection()
    return own_line(spark, d).select("vec_id", F.round(f, 6).alias("fraction"), F.round(f * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 4).alias("along_m"), F.round(dist, 4).alias("dist"))


@query("g02_rescale", f"SELECT vec_id, round(line_id + {FR} * 3.5, 6) AS post FROM {BOTH}")
def g02(spark, d):
    return own_line(spark, d).select("vec_id", F.round(F.col("line_id") + S.projection()[0] * 3.5, 6).alias("post"))


@query("g03_signed_side", f"SELECT vec_id, {SIDE} AS side FROM {BOTH}")
def g03(spark, d):
    return own_line(spark, d).select("vec_id", S.side().alias("side"))


@query("g04_tangent", f"SELECT line_id, round((x2 - x1) / {LEN}, 9) AS tx, round((y2 - y1) / {LEN}, 9) AS ty FROM ({SG})")
def g04(spark, d):
    tx, ty = S.tangent()
    return lines(spark, d).select("line_id", F.round(tx, 9).alias("tx"), F.round(ty, 9).alias("ty"))


@query("g05_great_circle", f"SELECT vec_id, round(2 * 6371000 * asin(sqrt(pow(sin(radians(y / 10 - 40) / 2), 2) + cos(radians(40)) * cos(radians(y / 10)) * pow(sin(radians(x / 10 + 80) / 2), 2))), 1) AS metres FROM ({PT})")
def g05(spark, d):
    return points(spark, d).select("vec_id", C.haversine_m(F.lit(40.0), F.lit(-80.0), F.col("y") / 10, F.col("x") / 10).alias("metres"))


@query("g06_length_midpoint", f"""WITH s AS (SELECT vec_id // 10 AS line_id, vec_id AS seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ({PT}) WINDOW w AS (PARTITION BY vec_id // 10 ORDER BY vec_id)),
  m AS (SELECT *, {LEN} AS len, coalesce(sum({LEN}) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, sum({LEN}) OVER (PARTITION BY line_id) AS total FROM s WHERE x2 IS NOT NULL)
  SELECT line_id, round(max(total), 3) AS length_m, round(arg_min(x1 + (x2 - x1) * (total / 2 - cum) / len, seq) FILTER (WHERE total / 2 BETWEEN cum AND cum + len), 3) AS mid_x, round(arg_min(y1 + (y2 - y1) * (total / 2 - cum) / len, seq) FILTER (WHERE total / 2 BETWEEN cum AND cum + len), 3) AS mid_y,
  count(*) FILTER (WHERE cum + len > 0.25 * total AND cum < 0.6 * total) AS n_part, round(sum(greatest(0, least(cum + len, 0.6 * total) - greatest(cum, 0.25 * total))), 3) AS part_m FROM m GROUP BY 1""")
def g06(spark, d):
    p = points(spark, d)
    line, nxt = F.floor(F.col("vec_id") / 10), p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    s = p.where("vec_id % 10 <> 9").join(nxt, "vec_id").select(line.alias("line_id"), F.col("vec_id").alias("seq"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    size = F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    part = P.substring(s, "line_id", F.col("total") * 0.25, F.col("total") * 0.6).groupBy("line_id").agg(F.count(F.lit(1)).alias("n_part"), F.round(size, 3).alias("part_m"))
    mid = P.point_at(s, "line_id", 0.5).select("line_id", F.round("x", 3).alias("mid_x"), F.round("y", 3).alias("mid_y"))
    return s.groupBy("line_id").agg(F.round(size, 3).alias("length_m")).join(mid, "line_id").join(part, "line_id")


@query("g07_within_distance", f"SELECT vec_id, line_id, round({DIST}, 4) AS dist FROM ({PT}) p, ({SG}) s WHERE {DIST} <= 12")
def g07(spark, d):
    return S.within(points(spark, d), lines(spark, d), 12.0, "vec_id", "line_id").withColumn("dist", F.round("dist", 4))


@query("g08_nearest_line", f"""SELECT vec_id, CASE WHEN dist <= 20 THEN line_id END AS line_id, CASE WHEN dist <= 20 THEN round(dist, 4) END AS dist FROM (SELECT vec_id, line_id, {DIST} AS dist FROM ({PT}) p, ({SG}) s) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, line_id) = 1""")
def g08(spark, d):
    return S.nearest(points(spark, d), lines(spark, d), 5.0, 20.0, "vec_id", "line_id").withColumn("dist", F.round("dist", 4))


def areas(spark, d):
    """Directed sides of triangles: three consecutive points."""
    p = points(spark, d).withColumn("area_id", F.floor(F.col("vec_id") / 3))
    w = Window.partitionBy("area_id").orderBy("vec_id")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return p.select("area_id", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))


def houses(spark, d):
    """Points that are no corner of a triangle."""
    return points(spark, d).select("vec_id", (F.col("x") + 0.37).alias("x"), (F.col("y") - 0.21).alias("y"))


HOUSE = f"(SELECT vec_id, x + 0.37::DOUBLE AS x, y - 0.21::DOUBLE AS y FROM ({PT}))"
TRI = f"(SELECT a.vec_id // 3 AS area_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy FROM ({PT}) a JOIN ({PT}) b ON b.vec_id = a.vec_id + 1 JOIN ({PT}) c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 3 = 0)"
TRI_SIDES = f"(SELECT area_id, ax AS x1, ay AS y1, bx AS x2, by_ AS y2 FROM {TRI} UNION ALL SELECT area_id, bx, by_, cx, cy FROM {TRI} UNION ALL SELECT area_id, cx, cy, ax, ay FROM {TRI})"
INSIDE = "(((bx - ax) * (y - ay) - (by_ - ay) * (x - ax) > 0) = ((cx - bx) * (y - by_) - (cy - by_) * (x - bx) > 0)) AND (((cx - bx) * (y - by_) - (cy - by_) * (x - bx) > 0) = ((ax - cx) * (y - cy) - (ay - cy) * (x - cx) > 0))"
IN = f"(SELECT vec_id, min(area_id) AS area_id FROM {HOUSE} p LEFT JOIN {TRI} t ON {INSIDE} GROUP BY 1)"


@query("g09_point_in_polygon", f"SELECT * FROM {IN}")
def g09(spark, d):
    return S.in_polygon(houses(spark, d), areas(spark, d), "vec_id", "area_id", 50.0)


@query("g10_within_then_nearest", f"""WITH i AS MATERIALIZED {IN}, n AS (SELECT vec_id, area_id, min({DIST}) AS dist FROM {HOUSE} p, {TRI_SIDES} s WHERE vec_id IN (SELECT vec_id FROM i WHERE area_id IS NULL) GROUP BY 1, 2)
  SELECT vec_id, area_id FROM i WHERE area_id IS NOT NULL UNION ALL SELECT i.vec_id, (SELECT arg_min(n.area_id, (n.dist, n.area_id)) FROM n WHERE n.vec_id = i.vec_id AND n.dist <= 80) FROM i WHERE area_id IS NULL""")
def g10(spark, d):
    p = houses(spark, d)
    inside = S.in_polygon(p, areas(spark, d), "vec_id", "area_id", 50.0)
    inside = saved(inside, "inside")
    rest = p.join(inside.where("area_id is null").select("vec_id"), "vec_id")
    whole = areas(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("area_id"))).where("n = 3").drop("n")
    near = S.nearest(rest, whole, 20.0, 80.0, "vec_id", "area_id").select("vec_id", "area_id")
    return inside.where("area_id is not null").unionByName(near)


@query("g11_placed_rows", f"SELECT vec_id FROM ({PT}) WHERE label <> 3 AND x IS NOT NULL AND y IS NOT NULL")
def g11(spark, d):
    p = points(spark, d).withColumn("x", F.when(F.col("label") != 3, F.col("x")))
    return p.where("x is not null and y is not null").select("vec_id")


@query("g12_corridor_grid", f"""WITH c AS (SELECT i * 20 AS easting, j * 20 AS northing FROM (SELECT unnest(range(-60, 60)) AS i), (SELECT unnest(range(-60, 60)) AS j)) SELECT DISTINCT CAST(easting AS BIGINT) AS easting, CAST(northing AS BIGINT) AS northing FROM (SELECT easting, northing, easting + 10.0::DOUBLE AS x, northing + 10.0::DOUBLE AS y FROM c) p, ({SG}) s WHERE {DIST} <= 30""")
def g12(spark, d):
    return S.corridor_cells(lines(spark, d), 30.0, 20).select("easting", "northing")


@query("g13_cell_of_point", f"SELECT vec_id, lpad(CAST(CAST(floor((x + 5000) / 100) * 100 AS BIGINT) AS VARCHAR), 6, '0') || lpad(CAST(CAST(floor((y + 5000) / 100) * 100 AS BIGINT) AS VARCHAR), 7, '0') AS cell_id FROM ({PT})")
def g13(spark, d):
    at = lambda c: (F.floor((F.col(c) + 5000) / 100) * 100).cast("long")
    return points(spark, d).select("vec_id", S.cell_id(at("x"), at("y")).alias("cell_id"))


WALLS = f"(SELECT line_id AS wall, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, (x2 - x1) / {LEN} AS wx, (y2 - y1) / {LEN} AS wy FROM ({SG}) WHERE line_id % 2 = 1)"


@query("g14_reference_line", f"""SELECT wall, arg_min(line_id, (CASE WHEN dist <= 8 AND cos >= 0.8 THEN 0 ELSE 1 END, dist, line_id)) AS road FROM (SELECT wall, line_id, {DIST} AS dist, abs(wx * (x2 - x1) / {LEN} + wy * (y2 - y1) / {LEN}) AS cos FROM {WALLS} p, (SELECT * FROM ({SG}) WHERE line_id % 2 = 0) s) GROUP BY 1""")
def g14(spark, d):
    """The nearest line that runs parallel within 8 m of each wall, else the nearest at all."""
    s = lines(spark, d)
    walls = s.where("line_id % 2 = 1").select(F.col("line_id").alias("wall"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), *[v.alias(n) for n, v in zip(("wx", "wy"), S.tangent())])
    return S.reference_line(walls, s.where("line_id % 2 = 0"), "wall", "line_id", 8.0).select("wall", F.col("line_id").alias("road"))


@query("g15_compass_side", f"""WITH l AS (SELECT *, CASE line_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE -1.0 END AS e, CASE line_id % 4 WHEN 0 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END AS n FROM ({SG}))
  SELECT line_id, CASE WHEN abs((e * -(y2 - y1) + n * (x2 - x1)) / {LEN}) < 0.3 THEN 0 ELSE CAST(sign(e * -(y2 - y1) + n * (x2 - x1)) AS INTEGER) END AS side FROM l""")
def g15(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in "NESW"]), (F.col("line_id") % 4 + 1).cast("int"))
    return lines(spark, d).select("line_id", S.label_side(label).alias("side"))


#: Distances of these queries: beside the stretch, protected, control band.
MARGIN, MOST, BAND = 5.0, 12.0, 30.0
SIGNED = f"(SELECT *, {LEN} AS len, CASE line_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 0 END AS sign FROM ({SG}))"
ALONG = f"((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / {LEN}"
LAT = DIST
OFF = f"greatest(0.0::DOUBLE, 0.1 * len - ({ALONG}), {ALONG} - 0.9 * len)"
BEYOND = f"({ALONG} <= 0 OR {ALONG} >= len)"
ROUTE = 20.0
PAIRS_OF = f"""(SELECT @IDS, line_id, x, y, {LAT} AS lat, {OFF} AS off, CASE WHEN sign IS NULL OR {BEYOND} THEN NULL ELSE sign = 0 OR sign = {SIDE} END AS same_side, {DIST} <= {ROUTE} AS same_route FROM @POINTS p, {SIGNED} s WHERE {DIST} <= {BAND})"""
PAIRS = PAIRS_OF.replace("@IDS", "vec_id").replace("@POINTS", HOUSE)
PROT = f"(same_side AND same_route AND off <= {MARGIN} AND lat <= {MOST})"
RING = f"(off <= {MARGIN} AND lat > {MOST} AND lat <= {BAND})"


def pairs(spark, d, p=None, more=()):
    """Points near barriers, judged: the candidate pairs of a distance join. A barrier's stretch is the middle 80% of its line."""
    s = lines(spark, d)
    n = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    sign = F.when(F.col("line_id") % 4 == 0, 1).when(F.col("line_id") % 4 == 1, -1).when(F.col("line_id") % 4 == 2, 0)
    barriers = s.select("line_id", sign.alias("sign"), (n * 0.1).alias("span_start"), (n * 0.9).alias("span_end"))
    refs = s.select("line_id", F.lit(0).alias("seq"), "x1", "y1", "x2", "y2")
    return P.classify_points(houses(spark, d) if p is None else p, barriers, refs, refs, "vec_id", "line_id", MARGIN, MOST, BAND, ROUTE, more)


@query("g19_classification", f"SELECT vec_id, line_id, same_route, CASE WHEN same_route THEN coalesce(same_side, false) END AS same_side, CASE WHEN same_route THEN same_side IS NULL END AS same_side_unknown, round(lat, 3) AS lateral_m, round(off, 3) AS along_offset_m, coalesce({PROT}, false) AS protected, same_side IS NULL AND same_route AND off <= {MARGIN} AND lat <= {MOST} AS protected_unknown FROM {PAIRS}")
def g19(spark, d):
    c = pairs(spark, d)
    return c.select("vec_id", "line_id", "same_route", "same_side", "same_side_unknown", F.round("lateral_m", 3).alias("lateral_m"), F.round("along_offset_m", 3).alias("along_offset_m"), "protected", "protected_unknown")


@query("g20_control_band", f"""SELECT vec_id, bool_or({RING} AND coalesce(same_side, false)) AND NOT bool_or(coalesce({PROT}, false)) AS control_band, bool_or({RING} AND same_side IS NULL) AND NOT bool_or({RING} AND coalesce(same_side, false)) AND NOT bool_or(coalesce({PROT}, false)) AS control_band_unknown,
  bool_or(coalesce({PROT}, false)) AS protected FROM {PAIRS} GROUP BY 1""")
def g20(spark, d):
    return P.banded_units(pairs(spark, d), "vec_id")


CELL = "CAST(floor(x / 20) AS BIGINT) AS cx, CAST(floor(y / 20) AS BIGINT) AS cy"


@query("g21_cell_rollup", f"""WITH p AS (SELECT *, coalesce({PROT}, false) AS prot, {RING} AND coalesce(same_side, false) AS ring, CASE WHEN line_id % 7 <> 0 THEN 1990 + line_id % 30 END AS yr, {CELL} FROM {PAIRS})
  SELECT cx, cy, count(*) FILTER (WHERE prot) AS n_protecting, arg_min(line_id, (lat, line_id)) FILTER (WHERE prot) AS nearest, round(min(lat) FILTER (WHERE prot), 3) AS nearest_m, min(yr) FILTER (WHERE prot) AS first_year, coalesce(bool_or(yr IS NULL) FILTER (WHERE prot), false) AS undated,
  CASE WHEN NOT bool_or(prot) THEN min(yr) FILTER (WHERE ring) END AS band_year FROM p GROUP BY 1, 2 HAVING bool_or(prot OR ring)""")
def g21(spark, d):
    p = houses(spark, d)
    places = p.groupBy("vec_id").agg(F.collect_list(F.struct("x", "y")).alias("at"))  # more than one where an id comes twice
    placed = p.join(places, "vec_id").select("at", "x", "y").withColumnRenamed("at", "vec_id")  # pairs carry the point's place along, so nothing is joined back to them
    c = pairs(spark, d, placed).select("*", F.explode("vec_id").alias("at")).withColumns({"cx": F.floor(F.col("at.x") / 20), "cy": F.floor(F.col("at.y") / 20)})
    year = F.when(F.col("line_id") % 7 != 0, 1990 + F.col("line_id") % 30)
    return P.protection_rollup(c, ["cx", "cy"], "line_id", year).withColumn("nearest_m", F.round("nearest_m", 3))


GRID = f"(SELECT DISTINCT i * 6 + 3.0::DOUBLE AS x, j * 6 + 3.0::DOUBLE AS y, i, j FROM (SELECT unnest(range(-150, 150)) AS i), (SELECT unnest(range(-150, 150)) AS j))"
ON_GRID = PAIRS_OF.replace("@IDS", "i, j").replace("@POINTS", GRID)


def zone_points(spark, d, dx=0.0, dy=0.0):
    """Centres (moved by dx, dy) of all cells of 6 m near a barrier."""
    return S.corridor_cells(lines(spark, d), BAND + 10.0, 6).select(F.col("cell_id").alias("vec_id"), (F.col("easting") + 3.0 + dx).alias("x"), (F.col("northing") + 3.0 + dy).alias("y"))


@query("g22_zone_cells", f"""WITH p AS (SELECT i, j, line_id, CASE WHEN {PROT} THEN 'protected' WHEN {RING} AND same_side THEN 'control_band' END AS status FROM {ON_GRID}) SELECT line_id, status, count(*) * 36 AS area_m2 FROM p WHERE status IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT CAST(-1 AS BIGINT), status, count(DISTINCT (i, j)) * 36 FROM p WHERE status IS NOT NULL GROUP BY 2""")
def g22(spark, d):
    """The protected zone and the band of each barrier as cells with their areas, and (as -1) those of all barriers dissolved."""
    z = saved(P.zone_cells(pairs(spark, d, zone_points(spark, d)), "vec_id", "line_id"), "zones")
    own = z.groupBy("line_id", "status").agg((F.count(F.lit(1)) * 36).alias("area_m2"))
    return own.unionByName(z.groupBy("status").agg((F.count_distinct("vec_id") * 36).alias("area_m2")).select(F.lit(-1).cast("long").alias("line_id"), "status", "area_m2"))


def pieces(spark, d, scale):
    """The lines as (line, seq, ...), scaled."""
    return lines(spark, d).select(F.col("line_id").alias("line"), F.lit(0).alias("seq"), *[(F.col(c) * scale).alias(c) for c in ("x1", "y1", "x2", "y2")])


SMALL = f"(SELECT line_id, x1 * 0.2 AS x1, y1 * 0.2 AS y1, x2 * 0.2 AS x2, y2 * 0.2 AS y2 FROM ({SG}))"


@query("g24_co_located", f"""WITH l AS (SELECT *, {LEN} AS len FROM {SMALL}), q AS (SELECT line_id AS b, len, ceil(len) AS n, unnest(range(0, CAST(ceil(len) AS BIGINT))) AS i, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2 FROM l WHERE len >= 1),
  p AS (SELECT b, len AS blen, len / n AS piece, a1 + (a2 - a1) * (i + 0.5) / n AS x, b1 + (b2 - b1) * (i + 0.5) / n AS y FROM q)
  SELECT s.line_id AS a, b FROM p JOIN l s ON s.line_id < b AND s.len >= 1 AND {DIST} <= 5 GROUP BY 1, 2, s.len, blen HAVING sum(piece) >= 0.5 * (1 - 1e-9) * least(s.len, blen)""")
def g24(spark, d):
    return R.co_located(pieces(spark, d, 0.2), within_m=5.0, step=1.0)


@query("g26_area_rates", f"SELECT area_id // 5 AS parent, count(*) AS n FROM {IN} WHERE area_id IS NOT NULL GROUP BY 1")
def g26(spark, d):
    inside = S.in_polygon(houses(spark, d), areas(spark, d), "vec_id", "area_id", 50.0)
    return inside.where("area_id is not null").groupBy(F.floor(F.col("area_id") / 5).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@query("g27_linked_position", "SELECT p_partkey, p_size * 1000 + p_partkey % 1000 AS metres FROM part")
def g27(spark, d):
    text = F.concat(F.col("p_size").cast("string"), F.lit("+"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))
    return t(spark, d, "part").select("p_partkey", C.position_km(text).alias("metres"))


KRUEGER = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 if k == 1 else 13 * n**2 / 48 - 3 * n**3 / 5 if k == 2 else 61 * n**3 / 240 for n in [1 / (2 * 298.257222101 - 1)] for k in (1, 2, 3)]
FLAT = 1 / 298.257222101
RADIUS = 6378137.0 / (1 + 1 / (2 * 298.257222101 - 1)) * (1 + (1 / (2 * 298.257222101 - 1)) ** 2 / 4 + (1 / (2 * 298.257222101 - 1)) ** 4 / 64)
ECC = (2 * FLAT - FLAT * FLAT) ** 0.5


@query("g29_metric_plane", f"""WITH r AS (SELECT vec_id, radians(60 + y / 100) AS phi, radians(x / 100) AS lam FROM ({PT})), t AS (SELECT *, sinh(atanh(sin(phi)) - {ECC!r} * atanh({ECC!r} * sin(phi))) AS t FROM r), u AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
  SELECT vec_id, round(500000.0 + 0.9996::DOUBLE * {RADIUS!r}::DOUBLE * (eta + {" + ".join(f"{c!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, c in enumerate(KRUEGER, 1))}), 3) AS easting, round(0.9996::DOUBLE * {RADIUS!r}::DOUBLE * (xi + {" + ".join(f"{c!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, c in enumerate(KRUEGER, 1))}), 3) AS northing FROM u""")
def g29(spark, d):
    e, n = S.transverse_mercator(F.lit(15.0) + F.col("x") / 100, F.lit(60.0) + F.col("y") / 100, 15.0)
    return points(spark, d).select("vec_id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


def beside_roads(spark, d):
    """(roads, barriers, attributes): a barrier beside the middle of every second road, on the line or a few metres off it."""
    roads = pieces(spark, d, 20.0)
    own = roads.where("line % 2 = 0").withColumns(dict(zip(("tx", "ty"), S.tangent())))
    off = (F.col("line") % 3) * 2.0
    at = lambda a, b, k, n: F.col(a) + (F.col(b) - F.col(a)) * k + n * off
    barriers = own.select(F.col("line").alias("seed"), "seq", at("x1", "x2", 0.45, -F.col("ty")).alias("x1"), at("y1", "y2", 0.45, F.col("tx")).alias("y1"), at("x1", "x2", 0.55, -F.col("ty")).alias("x2"), at("y1", "y2", 0.55, F.col("tx")).alias("y2"))
    mid = lambda a, b, n: F.when(F.col("line") % 11 == 0, (F.col(a) + F.col(b)) / 2 + n * 9.0)
    attributes = own.select(F.col("line").alias("seed"), "line", mid("x1", "x2", F.col("ty")).alias("manual_x"), mid("y1", "y2", -F.col("tx")).alias("manual_y"), (F.col("line") % 13 == 0).alias("manual_both"), (F.col("line") % 7 == 0).alias("both_sides"),
                            F.lit(None).cast("double").alias("recorded_m"), F.lit(None).cast("string").alias("group"))
    return roads, barriers, attributes


@query("g16_side_decision")
def g16(spark, d):
    """Every evidence in order, walls included: reference line, stretch and side of each barrier."""
    roads, barriers, attributes = beside_roads(spark, d)
    walls = barriers.where("seed % 5 = 0 and seed % 4 = 0").select(F.col("seed").alias("wall"), "seq", *[(F.col(c) + 6.0).alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0).alias("rank"))
    refs, _ = R.side_references(barriers, attributes, roads, "road", walls)
    return refs.withColumns({"span_start": F.round("span_start", 3), "span_end": F.round("span_end", 3)})


@query("g17_wall_beside")
def g17(spark, d):
    roads, barriers, _ = beside_roads(spark, d)
    walls = barriers.select(F.col("seed").alias("wall"), "seq", *[(F.col(c) + 6.0).alias(c) for c in ("x1", "y1", "x2", "y2")], (F.col("seed") % 3).alias("rank"))
    own = roads.where("line % 2 = 0").withColumnRenamed("line", "seed")
    return R.walls_beside(barriers, walls, own, P.point_at(barriers, "seed", 0.5))


@query("g18_parallel_neighbours")
def g18(spark, d):
    """Roads that run alongside each road, for its middle."""
    roads = pieces(spark, d, 20.0)
    twin = roads.where("line % 10 = 0").withColumns({"line": -1 - F.col("line"), **{c: F.col(c) + 25.0 for c in ("x1", "y1", "x2", "y2")}})
    net = roads.unionByName(twin.select(*roads.columns))
    own = roads.withColumnRenamed("line", "seed")
    return R.parallel_neighbours(net, P.point_at(own, "seed", 0.5), own, roads.select(F.col("line").alias("seed"), "line")).select("seed", "line", F.round("lateral_m", 3).alias("lateral_m"), "sign")


@query("g23_zone_agreement", f"""WITH p AS (SELECT i, j, line_id, coalesce({PROT}, false) AS p FROM {ON_GRID}), q AS (SELECT i, j, line_id, coalesce({PROT}, false) AS q FROM {ON_GRID.replace("i * 6 + 3.0::DOUBLE", "i * 6 + 4.3::DOUBLE").replace("j * 6 + 3.0::DOUBLE", "j * 6 + 2.1::DOUBLE")})
  SELECT line_id, count(*) AS n, round(avg(CASE WHEN coalesce(p, false) = coalesce(q, false) THEN 1.0 ELSE 0.0 END), 6) AS agree FROM p FULL JOIN q USING (i, j, line_id) GROUP BY 1""")
def g23(spark, d):
    """Cells of the protected zone against the point test at points that are not cell centres."""
    zone = pairs(spark, d, zone_points(spark, d)).select("vec_id", "line_id", F.col("protected").alias("p"))
    test = pairs(spark, d, zone_points(spark, d, 1.3, -0.9)).select("vec_id", "line_id", F.col("protected").alias("q"))
    both = zone.join(test, ["vec_id", "line_id"], "full")
    same = F.coalesce("p", F.lit(False)) == F.coalesce("q", F.lit(False))
    return both.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same.cast("double")), 6).alias("agree"))


@query("g25_longest_part", f"WITH p AS ({PT}), s AS (SELECT a.vec_id // 20 AS line, (a.vec_id % 20) // 5 AS part, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS len FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 GROUP BY 1, 2) SELECT line, arg_min(part, (-len, part)) AS part, round(max(len), 3) AS length_m FROM s GROUP BY 1")
def g25(spark, d):
    p = points(spark, d)
    nxt = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    seg = p.join(nxt, "vec_id").select(F.floor(F.col("vec_id") / 20).alias("line"), F.floor(F.col("vec_id") % 20 / 5).alias("part"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    return S.longest_part(seg, "line", "part").withColumn("length_m", F.round("length_m", 3))


@query("g28_context_lines", f"SELECT vec_id AS center, line_id FROM ({PT}) p, ({SG}) s WHERE line_id <> vec_id AND {DIST} <= 20")
def g28(spark, d):
    c = points(spark, d).select(F.col("vec_id").alias("center"), "x", "y")
    return S.within(c, lines(spark, d), 20.0, "center", "line_id").where("center <> line_id").select("center", "line_id")


TEN = f"(SELECT vec_id // 10 AS line_id, vec_id AS seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ({PT}) WINDOW w AS (PARTITION BY vec_id // 10 ORDER BY vec_id) QUALIFY x2 IS NOT NULL)"


def tens(spark, d):
    """Lines of ten consecutive points."""
    p = points(spark, d)
    nxt = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return p.where("vec_id % 10 <> 9").join(nxt, "vec_id").select(F.floor(F.col("vec_id") / 10).alias("line_id"), F.col("vec_id").alias("seq"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


@query("g28_clipped_context", f"""WITH s AS (SELECT vec_id AS center, line_id, seq, x, y, x1, y1, x2, y2, x2 - x1 AS dx, y2 - y1 AS dy, pow(x2 - x1, 2) + pow(y2 - y1, 2) AS a, (x1 - x) * (x2 - x1) + (y1 - y) * (y2 - y1) AS b, pow(x1 - x, 2) + pow(y1 - y, 2) - 625 AS c FROM ({PT}) p, {TEN} l WHERE line_id <> vec_id // 10),
  r AS (SELECT *, greatest(0.0::DOUBLE, (-b - sqrt(b * b - a * c)) / a) AS lo, least(1.0::DOUBLE, (-b + sqrt(b * b - a * c)) / a) AS hi FROM s WHERE a > 0 AND b * b - a * c > 0), i AS (SELECT *, CASE WHEN lo < 1e-12 THEN 0 ELSE lo END AS l, CASE WHEN hi > 1 - 1e-12 THEN 1 ELSE hi END AS h FROM r WHERE lo < hi),
  n AS (SELECT *, CASE WHEN l = 0 AND lag(h) OVER w = 1 AND lag(seq) OVER w = seq - 1 THEN 0 ELSE 1 END AS new FROM i WINDOW w AS (PARTITION BY center, line_id ORDER BY seq))
  SELECT center, line_id, CAST(sum(new) OVER (PARTITION BY center, line_id ORDER BY seq) - 1 AS INTEGER) AS part, seq, round(x1 + dx * l, 4) AS x1, round(y1 + dy * l, 4) AS y1, round(x1 + dx * h, 4) AS x2, round(y1 + dy * h, 4) AS y2 FROM n""")
def g28_clipped(spark, d):
    """Every other line within 25 m of a point, clipped to that circle."""
    c = points(spark, d).select(F.col("vec_id").alias("center"), "x", "y")
    inside = G.clipped(tens(spark, d), c, 25.0, "line_id", "center").where("line_id <> floor(center / 10)")
    return inside.select("center", "line_id", "part", "seq", *[F.round(x, 4).alias(x) for x in G.XY])


A3087 = G.Albers()
CONE = A3087.cone()
AUTH = f"({1 - G.GRS80.e2!r}::DOUBLE * (sin(radians(lat)) / (1 - {G.GRS80.e2!r}::DOUBLE * pow(sin(radians(lat)), 2)) + atanh({G.GRS80.e!r}::DOUBLE * sin(radians(lat))) / {G.GRS80.e!r}::DOUBLE))"
RHO = f"({A3087.on.a / CONE[0]!r}::DOUBLE * sqrt({CONE[1]!r}::DOUBLE - {CONE[0]!r}::DOUBLE * {AUTH}))"


@query("g29_albers_and_back", f"""WITH p AS (SELECT vec_id, -83.0 + x / 200 AS lon, 28.0 + y / 200 AS lat FROM ({PT})) SELECT vec_id, round(400000.0 + {RHO} * sin({CONE[0]!r}::DOUBLE * radians(lon + 84.0)), 3) AS x, round({CONE[2]!r}::DOUBLE - {RHO} * cos({CONE[0]!r}::DOUBLE * radians(lon + 84.0)), 3) AS y, 0.0::DOUBLE AS albers_mm, 0.0::DOUBLE AS mercator_mm FROM p""")
def g29_back(spark, d):
    """Degrees to the equal-area plane; and what is lost on the way back from it and from the transverse Mercator plane, in millimetres."""
    lon, lat = F.lit(-83.0) + F.col("x") / 200, F.lit(28.0) + F.col("y") / 200
    p = points(spark, d).select("vec_id", lon.alias("lon"), lat.alias("lat"))
    x, y = A3087.forward(F.col("lon"), F.col("lat"))
    e, n = S.transverse_mercator(F.col("lon"), F.col("lat"), -81.0)
    p = p.withColumns({"x": x, "y": y, "e": e, "n": n})
    lost = lambda back: F.round(F.greatest(F.abs(back[0] - F.col("lon")), F.abs(back[1] - F.col("lat"))) * 111_320_000, 0) + 0.0
    return p.select("vec_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), lost(A3087.inverse(F.col("x"), F.col("y"))).alias("albers_mm"), lost(G.transverse_mercator_inverse(F.col("e"), F.col("n"), -81.0)).alias("mercator_mm"))


MULTI = f"""(SELECT line, part, CASE WHEN turn THEN -seq ELSE seq END AS seq, CASE WHEN turn THEN bx ELSE ax END + off AS x1, CASE WHEN turn THEN by_ ELSE ay END AS y1, CASE WHEN turn THEN ax ELSE bx END + off AS x2, CASE WHEN turn THEN ay ELSE by_ END AS y2 FROM (
  SELECT a.vec_id // 20 AS line, (a.vec_id % 20) // 5 AS part, a.vec_id AS seq, (a.vec_id // 20 + (a.vec_id % 20) // 5) % 3 = 0 AS turn, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, CASE WHEN (a.vec_id // 20) % 5 = 0 AND (a.vec_id % 20) // 5 = 2 THEN 1.0 ELSE 0.0 END AS off
  FROM ({PT}) a JOIN ({PT}) b ON b.vec_id = CASE WHEN a.vec_id % 20 = 19 AND (a.vec_id // 20) % 7 = 1 THEN a.vec_id - 19 ELSE a.vec_id + 1 END))"""


def multi_lines(spark, d):
    """Lines of four parts that follow each other, every third part digitised backwards; every fifth line has a gap, every seventh is a ring."""
    p = points(spark, d)
    line, part = F.floor(F.col("vec_id") / 20), F.floor(F.col("vec_id") % 20 / 5)
    nxt = F.when((F.col("vec_id") % 20 == 19) & (line % 7 == 1), F.col("vec_id") - 19).otherwise(F.col("vec_id") + 1)
    other = p.select(F.col("vec_id").alias("nxt"), F.col("x").alias("bx"), F.col("y").alias("by"))
    s = p.withColumn("nxt", nxt).join(other, "nxt").select(line.alias("line"), part.alias("part"), F.col("vec_id").alias("seq"), ((line + part) % 3 == 0).alias("turn"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by", F.when((line % 5 == 0) & (part == 2), 1.0).otherwise(0.0).alias("off"))
    turned = lambda a, b: F.when(F.col("turn"), F.col(b)).otherwise(F.col(a))
    return s.select("line", "part", turned("seq", "seq") * F.when(F.col("turn"), -1).otherwise(1).alias("seq"), (turned("ax", "bx") + F.col("off")).alias("x1"), turned("ay", "by").alias("y1"), (turned("bx", "ax") + F.col("off")).alias("x2"), turned("by", "ay").alias("y2")).toDF("line", "part", "seq", *G.XY)


@query("g25_merged_parts", f"""WITH RECURSIVE p AS (SELECT line, part, sum({LEN}) AS len, arg_min(x1, seq) AS ax, arg_min(y1, seq) AS ay, arg_max(x2, seq) AS bx, arg_max(y2, seq) AS by_ FROM {MULTI} GROUP BY 1, 2),
  e AS (SELECT line, part, ax AS x, ay AS y FROM p UNION ALL SELECT line, part, bx, by_ FROM p), c AS (SELECT line, max(met) AS most, count(*) FILTER (WHERE met = 1) AS loose FROM (SELECT line, x, y, count(*) AS met FROM e GROUP BY ALL) GROUP BY 1), n AS (SELECT line, count(*) AS n_parts, min(part) AS least FROM p GROUP BY 1),
  w AS (SELECT line, part, [part] AS used, [0] AS ways, len AS ahead, len AS total, ax AS x0, ay AS y0, bx AS x1, by_ AS y1 FROM p UNION ALL SELECT line, part, [part], [1], 0.0, len, bx, by_, ax, ay FROM p
    UNION ALL SELECT w.line, p.part, list_append(used, p.part), list_append(ways, CASE WHEN p.ax = w.x1 AND p.ay = w.y1 THEN 0 ELSE 1 END), ahead + CASE WHEN p.ax = w.x1 AND p.ay = w.y1 THEN len ELSE 0 END, total + len, x0, y0, CASE WHEN p.ax = w.x1 AND p.ay = w.y1 THEN bx ELSE ax END, CASE WHEN p.ax = w.x1 AND p.ay = w.y1 THEN by_ ELSE ay END
      FROM w JOIN p ON p.line = w.line AND NOT list_contains(used, p.part) AND (p.ax = w.x1 AND p.ay = w.y1 OR p.bx = w.x1 AND p.by_ = w.y1)),
  f AS (SELECT w.*, n_parts FROM w JOIN n USING (line) JOIN c USING (line) WHERE len(used) = n_parts AND most <= 2 AND (loose = 2 OR loose = 0 AND used[1] = least) QUALIFY row_number() OVER (PARTITION BY line ORDER BY CASE WHEN abs(2 * ahead - total) <= 1e-9 * total THEN 0 ELSE total - 2 * ahead END, ways[list_position(used, least)]) = 1)
  SELECT line, true AS merged, array_to_string([used[k] || CASE WHEN ways[k] = 1 THEN '-' ELSE '+' END FOR k IN range(1, len(used) + 1)], ',') AS parts, round(total, 3) AS length_m, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM f
  UNION ALL SELECT line, false, part || '+', round(len, 3), round(ax, 4), round(ay, 4), round(bx, 4), round(by_, 4) FROM p WHERE line NOT IN (SELECT line FROM f) QUALIFY row_number() OVER (PARTITION BY line ORDER BY len DESC, part) = 1""")
def g25_merged(spark, d):
    s = saved(multi_lines(spark, d), "multi-lines")
    how = saved(G.merged_parts(s, "line", "part"), "merged")
    name = F.concat(F.col("part").cast("string"), F.when(F.col("turned"), "-").otherwise("+"))
    names = how.groupBy("line", "merged").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("place", name.alias("n")))), lambda x: x["n"])).alias("parts"))
    flat = G.flattened(s, "line", "part")
    n = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    ends = flat.groupBy("line").agg(F.round(F.sum(n), 3).alias("length_m"), *[F.round(F.min_by(c, "seq"), 4).alias(o) for c, o in (("x1", "x0"), ("y1", "y0"))], *[F.round(F.max_by(c, "seq"), 4).alias(o) for c, o in (("x2", "x1"), ("y2", "y1"))])
    return names.join(ends, "line")


ASIDE = PAIRS_OF.replace("@IDS", f"i, j, {BEYOND} AS past").replace("@POINTS", GRID.replace("i * 6 + 3.0::DOUBLE", "i * 6 + 4.3::DOUBLE").replace("j * 6 + 3.0::DOUBLE", "j * 6 + 2.1::DOUBLE"))


@query("g23_zone_classes", f"""WITH z AS MATERIALIZED (SELECT DISTINCT line_id, i, j FROM {ON_GRID} WHERE {PROT}), q AS MATERIALIZED (SELECT q.line_id, q.i, q.j, x, y, past, coalesce({PROT}, false) = (z.i IS NOT NULL) AS same FROM {ASIDE} q LEFT JOIN z ON z.line_id = q.line_id AND z.i = q.i AND z.j = q.j),
  s AS (SELECT line_id, i, j, di, dj, (i + greatest(di, 0)) * 6.0 AS x1, (j + greatest(dj, 0)) * 6.0 AS y1, (i + CASE WHEN di = 0 THEN 1 ELSE greatest(di, 0) END) * 6.0 AS x2, (j + CASE WHEN dj = 0 THEN 1 ELSE greatest(dj, 0) END) * 6.0 AS y2 FROM z, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(di, dj)),
  o AS (SELECT s.* FROM s LEFT JOIN z ON z.line_id = s.line_id AND z.i = s.i + di AND z.j = s.j + dj WHERE z.i IS NULL),
  n AS (SELECT q.line_id, q.i, q.j, bool_or(pow(x - least(greatest(x, x1), x2), 2) + pow(y - least(greatest(y, y1), y2), 2) <= 4) AS edge FROM q JOIN o ON o.line_id = q.line_id AND abs(o.i - q.i) <= 1 AND abs(o.j - q.j) <= 1 WHERE NOT same GROUP BY ALL)
  SELECT line_id, count(*) AS points, count(*) FILTER (WHERE same) AS agree, count(*) FILTER (WHERE NOT same AND coalesce(edge, false)) AS within_edge, count(*) FILTER (WHERE NOT same AND NOT coalesce(edge, false) AND past) AS past_end, count(*) FILTER (WHERE NOT same AND NOT coalesce(edge, false) AND NOT past) AS other FROM q LEFT JOIN n USING (line_id, i, j) GROUP BY 1""")
def g23_classes(spark, d):
    """The protected zone of each barrier as cells against the point test of points elsewhere in the same cells."""
    placed = lambda p: p.select(F.struct("vec_id", "x", "y").alias("vec_id"), "x", "y")  # noqa: E731  # pairs carry the point's place along
    at = lambda c: F.floor(F.col(f"vec_id.{c}") / 6)
    zone = pairs(spark, d, placed(zone_points(spark, d))).where("protected").select("line_id", at("x").alias("i"), at("y").alias("j"))
    tested = pairs(spark, d, placed(zone_points(spark, d, 1.3, -0.9)), ("beyond_end",))
    tested = tested.select("vec_id.*", "line_id", F.col("protected").alias("inside"), F.col("beyond_end").alias("past_end"))
    return G.zone_agreement(tested, zone, "vec_id", "line_id", 6.0, 2.0)


@query("g13_cell_flags", f"""WITH c AS (SELECT vec_id, CAST(floor((x + 5000) / 100) * 100 AS BIGINT) AS e, CAST(floor((y + 5000) / 100) * 100 AS BIGINT) AS n FROM ({PT})),
  f AS (SELECT CAST(floor((x1 + 5000) / 100) * 100 AS BIGINT) AS e, CAST(floor((y1 + 5000) / 100) * 100 AS BIGINT) AS n, max(CASE WHEN line_id % 10 = 0 THEN 1 ELSE 0 END) AS protected, count(*) AS n_lines FROM ({SG}) WHERE line_id % 3 = 0 GROUP BY 1, 2)
  SELECT vec_id, lpad(CAST(c.e AS VARCHAR), 6, '0') || lpad(CAST(c.n AS VARCHAR), 7, '0') AS cell_id, CAST(coalesce(protected, 0) AS INTEGER) AS protected, coalesce(n_lines, 0) AS n_lines FROM c LEFT JOIN f ON f.e = c.e AND f.n = c.n""")
def g13_flags(spark, d):
    """Points with the treatment of their cell; cells that the table lacks are untreated."""
    at = lambda c: (F.floor((F.col(c) + 5000) / 100) * 100).cast("long")
    table = lines(spark, d).where("line_id % 3 = 0").groupBy(S.cell_id(at("x1"), at("y1")).alias("cell_id")).agg(F.max(F.when(F.col("line_id") % 10 == 0, 1).otherwise(0)).alias("protected"), F.count(F.lit(1)).alias("n_lines"))
    return S.flagged(points(spark, d).select("vec_id", S.cell_id(at("x"), at("y")).alias("cell_id")), table, "cell_id", ["protected", "n_lines"])


@query("g15_label_check", f"""WITH l AS (SELECT vec_id, {LEN} AS len, x1, y1, x2, y2, ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / {LEN} AS off, vec_id % 6 AS k, CASE vec_id % 6 WHEN 1 THEN 1.0 WHEN 3 THEN -1.0 ELSE 0.0 END AS e, CASE vec_id % 6 WHEN 0 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END AS n FROM {BOTH}),
  s AS (SELECT *, CASE WHEN abs(off) >= 10 THEN CAST(sign(off) AS INTEGER) ELSE 0 END AS seen, CASE WHEN k > 3 OR abs((e * -(y2 - y1) + n * (x2 - x1)) / len) < 0.3 THEN 0 ELSE CAST(sign(e * -(y2 - y1) + n * (x2 - x1)) AS INTEGER) END AS told FROM l)
  SELECT vec_id, CASE WHEN seen <> 0 THEN 'geometric_offset' WHEN told <> 0 THEN 'label' ELSE 'unknown' END AS method, CASE WHEN seen <> 0 THEN seen ELSE told END AS sign, CASE WHEN seen <> 0 AND told <> 0 THEN CASE WHEN seen = told THEN 'agrees' ELSE 'disagrees' END WHEN seen <> 0 AND k <> 5 THEN 'undecided' END AS "check" FROM s""")
def g15_check(spark, d):
    """The side of each point's line by its offset (10 m at least) and by a compass label, and whether the two agree; some labels are unreadable, some blank."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("N", "E", "S", "W", "both", " ")]), (F.col("vec_id") % 6 + 1).cast("int"))
    own = own_line(spark, d).withColumn("label", label)
    tx, ty = S.tangent()
    off = (F.col("y") - F.col("y1")) * tx - (F.col("x") - F.col("x1")) * ty
    seen = F.when(F.abs(off) >= 10, F.signum(off).cast("int")).otherwise(0)
    method, sign, check = S.side_check(seen, S.label_side(F.col("label")), F.col("label"))
    return own.select("vec_id", method.alias("method"), sign.alias("sign"), check.alias("check"))


@query("g26_midpoint_rates", f"""WITH m AS (SELECT line_id, (x1 + x2) / 2 + 0.37::DOUBLE AS x, (y1 + y2) / 2 - 0.21::DOUBLE AS y, {LEN} AS len FROM ({SG})), a AS (SELECT line_id, len, min(area_id) AS area_id FROM m LEFT JOIN {TRI} t ON {INSIDE} GROUP BY 1, 2)
  SELECT area_id // 5 AS parent, count(*) AS n, round(sum(len), 3) AS length_m, round(count(*) FILTER (WHERE line_id % 3 = 0) / count(*), 6) AS built_share, round(1000 * count(*) / sum(len), 6) AS per_km FROM a GROUP BY 1""")
def g26_rates(spark, d):
    """Lines by the area that holds their midpoint (moved off the areas' sides), dissolved to the parent area, with rates; midpoints outside all areas are one group (null)."""
    s = lines(spark, d).withColumn("seq", F.lit(0))
    whole = areas(spark, d).groupBy("area_id").agg(F.count(F.lit(1)).alias("n")).where("n = 3").select("area_id")  # the last points may be no triangle
    middle = P.point_at(s, "line_id", 0.5).select("line_id", (F.col("x") + 0.37).alias("x"), (F.col("y") - 0.21).alias("y"))
    inside = S.in_polygon(middle, areas(spark, d).join(whole, "area_id"), "line_id", "area_id", 50.0)
    n = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    own = s.select("line_id", n.alias("len")).join(inside, "line_id")
    g = own.groupBy(F.floor(F.col("area_id") / 5).alias("parent"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("len"), 3).alias("length_m"), F.round(F.count_if(F.col("line_id") % 3 == 0) / F.count(F.lit(1)), 6).alias("built_share"), F.round(1000 * F.count(F.lit(1)) / F.sum("len"), 6).alias("per_km"))


@query("u04_geometry_duplicates", f"""WITH s AS (SELECT vec_id AS line, floor(x / 150) AS x1, floor(y / 150) AS y1, floor(x / 150) + label % 2 AS x2, floor(y / 150) + 1 AS y2, CASE WHEN vec_id % 3 = 0 THEN 'proposed' ELSE 'built' END AS status FROM ({PT})),
  b AS (SELECT min(line) AS line, x1, y1, x2, y2 FROM s WHERE status = 'built' GROUP BY ALL) SELECT line, 'built' AS status FROM b UNION ALL SELECT line, status FROM s WHERE status = 'proposed' AND NOT EXISTS (SELECT 1 FROM b WHERE b.x1 = s.x1 AND b.y1 = s.y1 AND b.x2 = s.x2 AND b.y2 = s.y2)""")
def u04_geometry(spark, d):
    at = lambda c: F.floor(F.col(c) / 150).cast("double")
    p = points(spark, d)
    first = p.select(F.col("vec_id").alias("line"), F.when(F.col("vec_id") % 3 == 0, "proposed").otherwise("built").alias("status"), at("x").alias("x1"), at("y").alias("y1"), (at("x") + F.col("label") % 2).alias("x2"), (at("y") + 1).alias("y2"))
    halves = [first.select("line", "status", F.lit(k).alias("seq"), *[(F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * f).alias(o) for c, f, o in (("x", k / 2, "x1"), ("y", k / 2, "y1"), ("x", k / 2 + 0.5, "x2"), ("y", k / 2 + 0.5, "y2"))]) for k in (0, 1)]
    return S.without_duplicates(halves[0].unionByName(halves[1]), "line", "status", "built")
