"""Register, map and feed JSON to flat rows, unions of dated layers, and the typed CSV export. JSON comes as a text column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ADDRESS = "struct<type:string,streetAddress:string,postalCode:string,locality:string,geoCoordinates:struct<coordinateSweRefE:string,coordinateSweRefN:string,latitude:string,longitude:string>>"
_ORGANIZER = "struct<type:string,organizationNumber:string,attributes:struct<displayName:string,organizerType:string>>"
_UNIT = f"""meta struct<modified:string>, included string, data struct<schoolUnitCode:string,attributes:struct<displayName:string,status:string,schoolUnitType:string,startdate:string,endDate:string,
  specialSupportSchool:boolean,municipalityCode:string,schoolTypes:array<string>,schoolTypeProperties:struct<gr:struct<grades:array<string>>>,addresses:array<{_ADDRESS}>>>"""
#: Grades of the compulsory school.
GRADES = range(1, 10)


def register_rows(raw: DataFrame, value: str = "value") -> DataFrame:
    """One flat row for each unit's JSON: the first visiting address, the organizer (an object, or the first of that type in an
    array), grades as ``ak1`` to ``ak9`` (null without a compulsory school), and the sorted school types. Texts without data give no row."""
    r = raw.select(F.from_json(value, _UNIT).alias("r")).where("r.data is not null")
    a = "r.data.attributes"
    visit = F.get(F.filter(f"{a}.addresses", lambda x: x["type"] == "BESOKSADRESS"), F.lit(0))
    listed = F.get(F.filter(F.from_json("r.included", f"array<{_ORGANIZER}>"), lambda x: x["type"] == "organizer"), F.lit(0))
    one = F.from_json("r.included", _ORGANIZER)
    organizer = F.when(F.ltrim("r.included").startswith("["), listed).when(one["type"] == "organizer", one)
    taught = F.col(f"{a}.schoolTypeProperties.gr")
    grades = [F.when(taught.isNotNull(), F.coalesce(F.array_contains(taught["grades"], str(g)), F.lit(False))).alias(f"ak{g}") for g in GRADES]
    r = r.withColumns({"_v": visit, "_o": organizer})
    plain = {"code": "r.data.schoolUnitCode", "name": f"{a}.displayName", "status": f"{a}.status", "unit_type": f"{a}.schoolUnitType", "start_date": f"{a}.startdate", "end_date": f"{a}.endDate", "modified": "r.meta.modified",
             "support": f"{a}.specialSupportSchool", "street": "_v.streetAddress", "postal_code": "_v.postalCode", "place": "_v.locality", "municipality": f"{a}.municipalityCode",
             "owner_number": "_o.organizationNumber", "owner_name": "_o.attributes.displayName", "owner_type": "_o.attributes.organizerType"}
    number = lambda c: F.regexp_replace(F.col(c), ",", ".").try_cast("double")
    g = "_v.geoCoordinates"
    spots = {"easting": f"{g}.coordinateSweRefE", "northing": f"{g}.coordinateSweRefN", "lat": f"{g}.latitude", "lon": f"{g}.longitude"}
    return r.select(*[F.col(c).alias(n) for n, c in plain.items()], *[number(c).alias(n) for n, c in spots.items()], F.array_join(F.array_sort(F.array_distinct(F.coalesce(f"{a}.schoolTypes", F.array()))), ",").alias("school_types"), *grades)


def map_ways(answers: DataFrame, priority: list[str], value: str = "value", kind: str = "wall_type") -> DataFrame:
    """(osm_id, wall_type, material, coords) of map answers (wall_type, JSON): ways of two nodes or more; of an id that several
    query types return the one first in ``priority``."""
    node = "array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
    e = answers.select(kind, F.explode(F.from_json(value, f"elements {node}")["elements"]).alias("e")).where((F.col("e.type") == "way") & (F.size("e.geometry") >= 2))
    order = F.array_position(F.array(*[F.lit(x) for x in priority]), F.col(kind))
    row = F.struct(F.col(kind), F.try_element_at("e.tags", F.lit("material")).alias("material"), F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("coords"))
    return e.groupBy(F.col("e.id").alias("osm_id")).agg(F.min_by(row, F.struct(order, F.size("e.geometry"))).alias("r")).select("osm_id", "r.*")


def as_list(js: Column, item: str) -> Column:
    """A JSON value as an array of ``item``: nothing is empty, a single object is one."""
    return F.when(js.isNull(), F.array().cast(f"array<{item}>")).when(F.ltrim(js).startswith("["), F.from_json(js, f"array<{item}>")).otherwise(F.array(F.from_json(js, item)))


def route(js: Column) -> Column:
    """Place names of a route in their order, joined by ' | '; null without any. Stops without an order come last."""
    stops = F.array_sort(F.transform(as_list(js, "struct<LocationName:string,Order:int>"), lambda x: F.struct(F.coalesce(x["Order"], F.lit(9999)).alias("o"), x["LocationName"].alias("n"))))
    names = F.filter(F.transform(stops, lambda x: x["n"]), lambda n: n.isNotNull() & (n != ""))
    return F.when(F.size(names) > 0, F.array_join(names, " | "))


def record_lists(answers: DataFrame, name: str, fields: dict[str, str], routes: list[str], lists: list[str], value: str = "value") -> DataFrame:
    """The records of ``RESPONSE.RESULT[].<name>[]``: ``fields`` (name to type), ``routes`` flattened, other nested ``lists`` kept as
    JSON text of an array (null when empty). An ERROR inside an answer fails the query with its text."""
    kept = ",".join([f"`{k}`:{v}" for k, v in fields.items()] + [f"`{c}`:string" for c in (*routes, *lists)])
    schema = f"RESPONSE struct<RESULT:array<struct<ERROR:string,`{name}`:array<struct<{kept}>>>>>"
    r = answers.select(F.explode(F.from_json(value, schema)["RESPONSE"]["RESULT"]).alias("r"))
    r = r.where(F.when(F.col("r.ERROR").isNotNull(), F.raise_error(F.concat(F.lit("the service answered: "), F.col("r.ERROR"))).cast("boolean")).otherwise(True))
    r = r.select(F.explode(f"r.`{name}`").alias("x"))
    text = lambda c: F.when(F.ltrim(c).startswith("["), F.when(~F.regexp_replace(c, r"\s", "").eqNullSafe("[]"), c)).when(c.isNotNull(), F.concat(F.lit("["), c, F.lit("]")))
    return r.select(*[F.col(f"x.`{k}`").alias(k) for k in fields], *[route(F.col(f"x.`{c}`")).alias(c) for c in routes], *[text(F.col(f"x.`{c}`")).alias(c) for c in lists])


def dated_union(layers: list[DataFrame], names: dict[str, str], geometry: str, placeholder: int, nulled: list[str]) -> DataFrame:
    """All orders of a dated layer in one: columns renamed, rows whose columns but the geometry repeat once, placeholders null. Every validity window stays."""
    renamed = [x.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()], geometry) for x in layers]
    every = reduce(lambda a, b: a.unionByName(b), renamed)
    once = every.groupBy(*names.values()).agg(F.min(geometry).alias(geometry)) if not isinstance(every.schema[geometry].dataType, (T.MapType,)) else every.dropDuplicates(list(names.values()))
    return once.withColumns({c: F.when(F.col(c) != placeholder, F.col(c)) for c in nulled})


def flag_export(df: DataFrame, path: str, key: str, flags: list[str], years: list[str], digits: int = 13, east: int = 6) -> DataFrame:
    """Writes the shared CSV and reads it back: rows with any flag, flags as 0/1, years as blank or whole numbers, the cell's corner
    out of its code, in order of the code. A code that isn't ``digits`` digits, or comes twice, fails the job."""
    bad = F.raise_error(F.concat(F.lit(f"{key} is no code of {digits} digits: "), F.coalesce(F.col(key), F.lit("null")))).cast("boolean")
    rows = df.where(F.when(F.col(key).rlike(f"^[0-9]{{{digits}}}$"), True).otherwise(bad))
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.concat(F.lit(f"{key} comes twice: "), F.col(key))).cast("boolean")
    rows = rows.join(n, key).where(F.when(F.col("_n") == 1, True).otherwise(twice))
    rows = rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in flags]))
    out = rows.select(key, F.substring(key, 1, east).cast("int").alias("sweref_e"), F.substring(key, east + 1, digits - east).cast("int").alias("sweref_n"),
                      *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in flags], *[F.col(c).cast("int").alias(c) for c in years])
    out.orderBy(key).write.csv(path, header=True, nullValue="", quoteAll=False)
    return df.sparkSession.read.csv(path, header=True, schema=out.schema, nullValue="")
