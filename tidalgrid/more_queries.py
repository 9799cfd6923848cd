"""Further queries over the synthetic tables, one or more for each operator, beside the same in SQL.

Each query stands right before its SQL. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalgrid.functions import geo, meta
from tidalgrid.operators import fields, layers, select, water
from tidalgrid.plans.axes import Axes
from tidalgrid.sources import synthetic

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}
T0, DAY = 1704067200, 86400


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        FOUND[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(name: str):
    return F.unix_seconds(F.col(name).cast("timestamp"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")


# --- sources and metadata


@query("""WITH d AS (SELECT o_orderkey AS id, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS day, (o_orderkey * 37) % 24 * 100 + (o_orderkey * 11) % 60 AS clock, o_orderdate FROM orders)
SELECT id, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + clock // 100 * 3600 + clock % 100 * 60 AS t,
  concat(strftime(o_orderdate, '%Y-%m-%d'), 'T', lpad(CAST(clock // 100 AS VARCHAR), 2, '0'), ':', lpad(CAST(clock % 100 AS VARCHAR), 2, '0'), 'Z') AS stamp FROM d""")
def valid_times(spark, sf_dir):
    rows = orders(spark, sf_dir).select("id", F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("day"), ((F.col("id") * 37) % 24 * 100 + (F.col("id") * 11) % 60).alias("clock"))
    return rows.select("id", meta.valid_time(F.col("day"), F.col("clock")).alias("t")).withColumn("stamp", meta.stamp(F.col("t")))


@query("""WITH m AS (SELECT event_type AS f, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS t, event_id AS o, user_id % 3 AS grid FROM events)
SELECT f AS field, t, min(o) AS "offset", any_value(g) AS grid FROM m JOIN (SELECT f, arg_min(grid, o) AS g FROM m GROUP BY 1) USING (f) GROUP BY 1, 2""")
def header_index(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select(F.col("event_type").alias("field"), (F.floor(seconds("ts") / 3600) * 3600).alias("t"), F.col("event_id").alias("offset"), (F.col("user_id") % 3).alias("grid"))
    return meta.first_messages(messages)


@query("""SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN 'short' ELSE 'short' END,
  CASE WHEN p_size % 4 = 0 OR p_size % 7 IN (0, 1) THEN '' ELSE concat('_isobaric', CAST(p_size % 7 AS VARCHAR)) END) AS key FROM part""")
def field_keys(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    cf = F.when(key % 3 == 0, F.col("p_brand")).when(key % 3 == 1, "unknown").otherwise(" ")
    return table(spark, sf_dir, "part").select(key.alias("id"), meta.field_key(cf, F.lit("short"), F.when(size % 4 == 0, "surface").otherwise("isobaric"), (size % 7).cast("int")).alias("key"))


@query("""WITH p AS (SELECT s_suppkey, CAST(0.01 * (s_suppkey % 5 + 1) AS FLOAT) AS scale, CAST(s_suppkey % 7 AS FLOAT) AS off FROM supplier)
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 100 IN (99, 50) THEN NULL ELSE round(CAST(CAST(CAST(l_partkey % 100 AS FLOAT) * scale AS FLOAT) + off AS DOUBLE), 3) END AS value FROM lineitem JOIN p ON s_suppkey = l_suppkey""")
def unpacked_values(spark, sf_dir):
    packing = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.lit(0.01) * (F.col("s_suppkey") % 5 + 1)).cast("float").alias("scale"), (F.col("s_suppkey") % 7).cast("float").alias("off"))
    raw = (F.col("l_partkey") % 100).cast("int")
    value = meta.unpacked(raw, F.lit(99), F.lit(50), F.col("scale"), F.col("off"))
    return table(spark, sf_dir, "lineitem").join(packing, "l_suppkey").select("l_orderkey", "l_linenumber", F.round(value.cast("double"), 3).alias("value"))


@query(f"""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 4 AS u, o_orderkey % 1000 / 8.0 AS v, o_orderkey % 28 + 1 AS d, o_orderkey % 5 AS z FROM orders)
SELECT id, CASE WHEN z = 4 THEN NULL ELSE CAST(epoch(make_date(2000, 3, CAST(d AS INTEGER))) AS BIGINT) + 6 * 3600 + 30 * 60 - CASE z WHEN 1 THEN 19800 WHEN 2 THEN -12600 ELSE 0 END
  + CAST(round_even(v * CASE u WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END, 0) AS BIGINT) END AS t FROM x""")
def decoded_times(spark, sf_dir):
    key = F.col("id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (key % n + 1).cast("int"))
    units = F.concat(pick(["seconds", "Min", "hours", "days"], 4), F.lit(" since 2000-3-"), (key % 28 + 1).cast("string"), F.lit(" 06:30"), pick([":00", ":00 +05:30", ":00 -0330", "Z", " UTC"], 5))
    return orders(spark, sf_dir).select("id", meta.decoded_time(key % 1000 / 8.0, units, F.when(key % 5 == 4, "360_day").otherwise("standard")).alias("t"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 4 WHEN 0 THEN l_quantity - 273.15 WHEN 1 THEN l_quantity / 100 WHEN 2 THEN l_quantity / 3600 ELSE l_quantity END, 6) AS value,
  CASE l_linenumber % 4 WHEN 0 THEN '°C' WHEN 1 THEN 'hPa' WHEN 2 THEN 'W m⁻²' ELSE 'm' END AS unit FROM lineitem""")
def display_units(spark, sf_dir):
    units = F.element_at(F.array(*[F.lit(u) for u in (" K", "Pa", "J  m**-2", "m")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    value, unit = meta.displayed(F.col("l_quantity"), units, F.lit(3600))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(value, 6).alias("value"), unit.alias("unit"))


@query("""WITH t AS (SELECT DISTINCT event_type AS field, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS t FROM events), g AS (SELECT field, t - lag(t) OVER (PARTITION BY field ORDER BY t) AS d FROM t)
SELECT field, CASE WHEN length(field) % 2 = 0 THEN 1800.0 ELSE quantile_cont(d, 0.5) END AS seconds FROM g GROUP BY 1""")
def accumulation_seconds(spark, sf_dir):
    times = table(spark, sf_dir, "events").select(F.col("event_type").alias("field"), (F.floor(seconds("ts") / 3600) * 3600).alias("t")).distinct()
    known = times.select("field").distinct().withColumn("step", F.when(F.length("field") % 2 == 0, 1800).otherwise(0))
    return layers.accumulation_seconds(known, times)


@query("""SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'diverging' WHEN 1 THEN 'plain' WHEN 2 THEN 'temperature' WHEN 3 THEN 'share' WHEN 4 THEN 'radiation' WHEN 5 THEN 'pressure' ELSE 'plain' END AS kind FROM part""")
def scale_classes(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % 7 + 1).cast("int"))
    kind = meta.scale_class(pick(["u10", "ws10", "t2m", "tcc", "ssrd", "msl", "swh"]), pick(["10 metre U wind component", "10 metre wind speed", "2 metre temperature", "Total cloud cover", "Solar radiation", "Pressure", "Wave height"]), pick(["m s**-1", "m s**-1", "K", "(0 - 1)", "J m**-2", "Pa", "m"]))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN concat('step', CAST(p_size AS VARCHAR), 'h') WHEN p_partkey % 3 = 1 THEN concat('depth', CAST(p_size AS VARCHAR)) ELSE concat('depth', CAST(p_size AS VARCHAR), '.5') END AS tag FROM part""")
def coord_tags(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    tag = meta.coord_tag(F.when(key % 3 == 0, "step").otherwise("depth"), F.when(key % 3 == 0, size), size + F.when(key % 3 == 2, 0.5).otherwise(0.0))
    return table(spark, sf_dir, "part").select(key.alias("id"), tag.alias("tag"))


@query("""WITH x AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) * 10 * (p_partkey % 300) * (p_partkey % 40 + 1) * 4 AS b, p_size FROM part)
SELECT id, b AS bytes, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0) ELSE concat(CAST(b AS VARCHAR), ' B') END AS size,
  round(0.25 * 111.32 * greatest(cos(radians(p_size + 40)), 0.02), 4) AS width_km FROM x""")
def field_sizes(spark, sf_dir):
    size = meta.field_bytes(F.col("p_size") * 10, F.col("p_partkey") % 300, F.col("p_partkey") % 40 + 1, F.lit(4))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), size.alias("bytes"), meta.human(size).alias("size"), F.round(meta.cell_size_km(F.lit(0.25), F.lit(0.25), F.col("p_size") + 40)[1], 4).alias("width_km"))


@query("""WITH x AS (SELECT p_partkey AS id, p_retailprice * (p_partkey % 9 + 1) AS w FROM part), c AS (SELECT id, w, m * power(10, floor(log10(w / 4))) AS v FROM x, (VALUES (1), (2), (5), (10)) l(m)),
r AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY abs(v - w / 4), v) AS n FROM c) SELECT id, CAST(v AS DOUBLE) AS km FROM r WHERE n = 1""")
def scale_bars(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), meta.scale_bar_km(F.col("p_retailprice") * (F.col("p_partkey") % 9 + 1)).alias("km"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN concat(p_brand, ':raw') ELSE p_brand END AS name, CASE p_partkey % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'normalized' END AS mode FROM part""")
def channel_specs(spark, sf_dir):
    suffix = F.element_at(F.array(F.lit(":unit"), F.lit(":normalized"), F.lit(":raw")), (F.col("p_partkey") % 3 + 1).cast("int"))
    name, mode = meta.channel_spec(F.concat("p_brand", suffix))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), mode.alias("mode"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '()' WHEN 1 THEN concat('(', CAST(p_size AS VARCHAR), ',)') ELSE concat('(', CAST(p_size AS VARCHAR), ', 7)') END AS shape,
  left(sha1(concat_ws('|', p_name, CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR))), 16) AS key FROM part""")
def shapes_and_index_keys(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    shape = F.when(key % 3 == 0, F.array().cast("array<int>")).when(key % 3 == 1, F.array(size)).otherwise(F.array(size, F.lit(7)))
    return table(spark, sf_dir, "part").select(key.alias("id"), meta.shape_text(shape).alias("shape"), meta.index_key(F.col("p_name"), size, key).alias("key"))


WEATHER = """g AS (SELECT c AS n, c // 651 AS i, (c // 31) % 21 AS j, c % 31 AS k FROM range(0, 2604) t(c)),
p AS (SELECT i, j, k, 1704067200 + i * 21600 AS t, 60 - j * 0.5 AS lat, -5 + k * 0.5 AS lon, (i * 6) % 24 AS h FROM g)"""


@query(f"""WITH {WEATHER}, v AS (SELECT t, j, k, unnest(['10u', '10v', 'ssrd', 'tcc', '2t']) AS field, unnest([8 * sin(radians(lon) * 3 + i / 8.0) * cos(radians(lat) * 2), 6 * cos(radians(lat) * 3 - i / 11.0),
  least(greatest(sin((h + lon / 15.0 - 6) / 12 * pi()), 0), 1) * 3.6e6 * least(greatest(cos(radians(lat)), 0.1), 1), least(greatest(0.5 + 0.45 * sin(radians(lon) * 2 + radians(lat) * 2 + i / 6.0), 0), 1),
  300 - 0.5 * (lat - 35) + 4 * sin((h - 3) / 24.0 * 2 * pi())]) AS value FROM p)
SELECT field, CAST(t AS BIGINT) AS t, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, round(value, 4) AS value FROM v""")
def synthetic_weather(spark, sf_dir):
    return synthetic.cube(spark, "small", T0).select("field", "t", "j", "k", F.round("value", 4).alias("value"))


@query(f"""WITH {WEATHER} SELECT CAST(t AS BIGINT) AS t, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, round(sqrt(power(8 * sin(radians(lon) * 3 + i / 8.0) * cos(radians(lat) * 2), 2) + power(6 * cos(radians(lat) * 3 - i / 11.0), 2)), 4) AS value, 'ws10' AS field FROM p""")
def wind_speed(spark, sf_dir):
    cube = synthetic.cube(spark, "small", T0).where("field in ('10u', '10v')").withColumn("field", F.when(F.col("field") == "10u", "u10").otherwise("v10"))
    return layers.wind_speeds(cube).withColumn("value", F.round("value", 4))


# --- axes and selection


@query("""WITH t AS (SELECT DISTINCT o_orderstatus AS s, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders), g AS (SELECT s, t, t - lag(t) OVER (PARTITION BY s ORDER BY t) AS d FROM t)
SELECT s AS field, count(*) AS n, min(t) AS first, max(t) AS last, quantile_cont(d, 0.5) AS step, min(d) AS shortest, max(d) AS longest FROM g GROUP BY 1""")
def axis_report(spark, sf_dir):
    return layers.axis_report(orders(spark, sf_dir).select(F.col("o_orderstatus").alias("field"), seconds("o_orderdate").alias("t")), "field")


@query("""SELECT p_size % 5 AS ny, p_size % 3 AS nx, concat_ws(',', list_sort(list(DISTINCT p_name))) AS members FROM part GROUP BY 1, 2""")
def grid_groups(spark, sf_dir):
    edge = {c: F.lit(v) for c, v in (("south", -1.00001), ("north", 1.0), ("west", 0.0), ("east", 9.0))}
    got = layers.by_grid(table(spark, sf_dir, "part").select(F.col("p_name").alias("field"), (F.col("p_size") % 5).alias("ny"), (F.col("p_size") % 3).alias("nx")).withColumns(edge))
    return got.select("ny", "nx", F.array_join("members", ",").alias("members"))


@query("""WITH f AS (SELECT s_name AS path, s_nationkey % 3 AS units, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 2 END AS shape FROM supplier), w AS (SELECT arg_min(units, path) AS u, (SELECT shape FROM f ORDER BY path LIMIT 1) AS s FROM f)
SELECT path, concat_ws(',', CASE WHEN units IS DISTINCT FROM u THEN 'units' END, CASE WHEN shape IS DISTINCT FROM s THEN 'shape' END) AS differs FROM f, w WHERE units IS DISTINCT FROM u OR shape IS DISTINCT FROM s""")
def compatibility(spark, sf_dir):
    key = F.col("s_suppkey")
    files = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"), (F.col("s_nationkey") % 3).alias("units"), F.when(key % 4 != 0, key % 2).alias("shape"))
    return layers.incompatible(files, ["units", "shape"]).select("path", F.array_join("differs", ",").alias("differs"))


def dated(spark, sf_dir):
    return orders(spark, sf_dir).select("id", seconds("o_orderdate").alias("t"), F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("value"))


@query("""SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders WHERE epoch(o_orderdate) BETWEEN 800000000 AND 850000000""")
def time_window(spark, sf_dir):
    return select.time_window(dated(spark, sf_dir).select("id", "t"), 800000000, 850000000)


@query("""WITH d AS (SELECT DISTINCT CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders WHERE epoch(o_orderdate) <= 850000000), r AS (SELECT row_number() OVER (ORDER BY t) - 1 AS i, t FROM d) SELECT CAST(i AS INTEGER) AS i, t FROM r WHERE i % 5 = 0""")
def window_stride(spark, sf_dir):
    return select.pick_times(dated(spark, sf_dir), end=850000000, stride=5)


@query("""SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders WHERE epoch(o_orderdate) IN (SELECT epoch(o_orderdate) FROM orders WHERE o_orderkey % 97 = 0)""")
def kept_times(spark, sf_dir):
    rows = dated(spark, sf_dir).select("id", "t")
    return select.keep_times(rows, rows.where("id % 97 = 0")).select("id", "t")


@query("""SELECT DISTINCT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS t FROM events""")
def union_of_times(spark, sf_dir):
    return select.union_times(table(spark, sf_dir, "events").select("event_type", (F.floor(seconds("ts") / 3600) * 3600).alias("t")))


AXIS = """ax AS (SELECT n_nationkey AS i, CAST(n_nationkey * 14.4 AS DOUBLE) AS lon FROM nation)"""


def nation_axis(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") * F.lit(14.4)).alias("lon"))


@query(f"""WITH {AXIS}, k AS (SELECT i FROM ax WHERE ((lon - 300) % 360 + 360) % 360 <= 100) SELECT min(i) AS first, max(i) AS last, count(*) AS n, max(i) - min(i) + 1 = count(*) AS contiguous FROM k""")
def lon_run(spark, sf_dir):
    return select.is_run(select.lon_window(nation_axis(spark, sf_dir), 300.0, 40.0))


@query(f"""WITH {AXIS}, r AS (SELECT i, (lon + 180) % 360 - 180 AS lon FROM ax) SELECT i, round(lon, 6) AS lon, CAST(row_number() OVER (ORDER BY lon) - 1 AS INTEGER) AS at_ FROM r""")
def rolled_axis(spark, sf_dir):
    return select.rolled(nation_axis(spark, sf_dir)).select("i", F.round("lon", 6).alias("lon"), F.col("at").alias("at_"))


@query("""SELECT n_regionkey AS i, CAST(24 - n_nationkey AS INTEGER) AS j, n_nationkey AS was FROM nation""")
def flipped(spark, sf_dir):
    return select.north_up(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("i"), F.col("n_nationkey").alias("j"), F.col("n_nationkey").alias("was")), 25)


@query("""SELECT CAST(0.1 AS DOUBLE) AS start, CAST(0.1 AS DOUBLE) AS step, count(*) AS n, TRUE AS even FROM customer""")
def axis_fit(spark, sf_dir):
    axis = table(spark, sf_dir, "customer").select((F.row_number().over(Window.orderBy("c_custkey")) - 1).alias("i")).withColumn("v", F.lit(0.1) + F.col("i") * 0.1)
    return select.axis_step(axis).withColumn("step", F.round("step", 9))


@query("""SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber % 4 = 3 AND l_suppkey % 5 = 0""")
def at_index(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_linenumber") % 4).alias("level"), (F.col("l_suppkey") % 5).alias("member"))
    return select.at_index(rows, {"level": -1}, {"level": 4, "member": 5})


@query("""WITH f AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderstatus AS s FROM orders), c AS (SELECT i, s, CASE WHEN s <> lag(s) OVER (ORDER BY i) THEN 1 ELSE 0 END AS c FROM f), r AS (SELECT i, s, sum(c) OVER (ORDER BY i) AS r FROM c)
SELECT s AS source, CAST(min(i) AS INTEGER) AS lo, CAST(max(i) + 1 AS INTEGER) AS hi FROM r GROUP BY r, s""")
def source_runs(spark, sf_dir):
    return select.source_runs(orders(spark, sf_dir).select((F.row_number().over(Window.orderBy("id")) - 1).alias("i"), F.col("o_orderstatus").alias("source")))


@query("""WITH h AS (SELECT CAST(floor(epoch(ts) / 7200) AS BIGINT) * 7200 AS t, min(event_type) AS s FROM events WHERE event_type <> 'error' AND user_id % 3 = 0 GROUP BY 1), g AS (SELECT t, s, t - lag(t) OVER (ORDER BY t) AS d, lag(s) OVER (ORDER BY t) AS b FROM h),
u AS (SELECT d FROM g WHERE d IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT 1) SELECT t, g.d, s AS source, b AS before FROM g, u WHERE g.d <> u.d""")
def gaps_in_union(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type <> 'error' and user_id % 3 = 0").select((F.floor(seconds("ts") / 7200) * 7200).alias("t"), F.col("event_type").alias("source"))
    return select.joined_gaps(rows)


@query("""SELECT o_custkey AS id, count(*) >= 2 AND max(k) - min(k) = 0 AS even FROM (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) x GROUP BY 1""")
def progressions(spark, sf_dir):
    keys = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("v"))
    return keys.select("id", select.progression(F.col("v")).alias("even"))


# --- sampling


REGION = Axes(T0, DAY, 30, 40.0, 1.0, 20, -10.0, 1.0, 20)


def region_cells(spark, sf_dir):
    at = spark.range(30 * 400).select(F.floor(F.col("id") / 400).cast("int").alias("i"), F.pmod(F.floor(F.col("id") / 20), F.lit(20)).cast("int").alias("j"), F.pmod("id", F.lit(20)).cast("int").alias("k"))
    return at.withColumn("value", F.when((F.col("i") * 7 + F.col("j") * 3 + F.col("k")) % 53 != 0, (F.col("i") * 31 + F.col("j") * 17 + F.col("k") * 5) % 101 / 4.0))


REGION_CELLS = """cells AS (SELECT CAST(c // 400 AS INTEGER) AS i, CAST((c // 20) % 20 AS INTEGER) AS j, CAST(c % 20 AS INTEGER) AS k FROM range(0, 12000) t(c)),
known AS (SELECT i, j, k, (i * 31 + j * 17 + k * 5) % 101 / 4.0 AS value FROM cells WHERE (i * 7 + j * 3 + k) % 53 <> 0)"""
REGION_POINTS = f"""pts AS (SELECT o_orderkey AS id, {T0} + (o_orderkey * 7919) % {30 * DAY} AS t, CAST((o_orderkey * 31) % 220 AS DOUBLE) / 10 + 39 AS lat, CAST((o_orderkey * 17) % 3000 AS DOUBLE) / 100 + CASE WHEN o_orderkey % 2 = 0 THEN 345 ELSE -15 END AS lon FROM orders),
loc AS (SELECT id, (t - {T0}) / CAST({DAY} AS DOUBLE) AS ti, lat - 40 AS yi, ((lon + 10) % 360 + 360) % 360 AS xi FROM pts),
idx AS (SELECT id, ti, yi, xi, CAST(floor(ti) AS INTEGER) AS i0, CAST(floor(yi) AS INTEGER) AS j0, CAST(floor(xi) AS INTEGER) AS k0 FROM loc WHERE ti BETWEEN 0 AND 29 AND yi BETWEEN 0 AND 19 AND xi BETWEEN 0 AND 19)"""
CORNERS = """corners AS (SELECT id, least(i0 + a.d, 29) AS i, least(j0 + b.d, 19) AS j, least(k0 + c.d, 19) AS k, (CASE WHEN a.d = 1 THEN ti - i0 ELSE 1 - (ti - i0) END) * (CASE WHEN b.d = 1 THEN yi - j0 ELSE 1 - (yi - j0) END) * (CASE WHEN c.d = 1 THEN xi - k0 ELSE 1 - (xi - k0) END) AS w
  FROM idx, (VALUES (0), (1)) a(d), (VALUES (0), (1)) b(d), (VALUES (0), (1)) c(d))"""


def region_points(spark, sf_dir):
    key = F.col("id")
    return orders(spark, sf_dir).select("id", (F.lit(T0) + key * 7919 % (30 * DAY)).alias("t"), (key * 31 % 220 / 10.0 + 39).alias("lat"), (key * 17 % 3000 / 100.0 + F.when(key % 2 == 0, 345).otherwise(-15)).alias("lon"))


@query(f"""WITH {REGION_CELLS}, {REGION_POINTS}, {CORNERS} SELECT id, round(sum(w * value) + 1e-9, 5) AS value FROM corners JOIN known USING (i, j, k) GROUP BY id HAVING count(*) = 8""")
def sample_regional(spark, sf_dir):
    cube = fields.frames(region_cells(spark, sf_dir), REGION)
    return fields.sample(region_points(spark, sf_dir), cube, REGION, side=7).select("id", F.round(F.col("value") + 1e-9, 5).alias("value"))


@query(f"""WITH {REGION_CELLS}, o AS (SELECT k, (((k - 10) - 355 + 720) % 360) AS o FROM range(0, 20) t(k)), r AS (SELECT k, o, row_number() OVER (ORDER BY o) - 1 AS col FROM o WHERE o <= 8)
SELECT cells.i, CAST(cells.j - 5 AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(40 + cells.j AS DOUBLE) AS lat, CAST(355 + o AS DOUBLE) AS lon, value FROM cells JOIN r ON cells.k = r.k LEFT JOIN known ON known.i = cells.i AND known.j = cells.j AND known.k = cells.k WHERE cells.j BETWEEN 5 AND 9""")
def cropped(spark, sf_dir):
    return fields.crop(region_cells(spark, sf_dir), REGION, -5.0 + 360, 45.0, 3.0, 49.0).select("i", "row", "col", "lat", "lon", "value")


@query("""WITH t(number, t0, e) AS (VALUES (0, 1704067200, 1704499200), (1, 1704499200, 1704931200), (2, 1705017600, 1705449600)), p AS (SELECT o_orderkey AS id, 1704067200 + (o_orderkey * 7919) % 2592000 AS t FROM orders)
SELECT id, p.t, CAST(arg_min(number, t0) AS BIGINT) AS number, CAST(min(t0) AS BIGINT) AS t0 FROM p JOIN t ON p.t BETWEEN t0 AND e GROUP BY id, p.t""")
def point_parts(spark, sf_dir):
    from tidalgrid.sources import archive

    spans = spark.createDataFrame([(0, T0, T0 + 5 * DAY), (1, T0 + 5 * DAY, T0 + 10 * DAY), (2, T0 + 11 * DAY, T0 + 16 * DAY)], "number long, t0 long, end long")
    return archive.point_part(region_points(spark, sf_dir).select("id", "t"), spans, 5 * DAY + 1)


# --- tracks


TRACK = """tr AS (SELECT o_custkey AS run, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 1000 AS t, o_orderkey AS id, CAST((o_orderkey * 13) % 1500 AS DOUBLE) / 10 - 75 AS lat, CAST((o_orderkey * 29) % 3600 AS DOUBLE) / 10 - 180 AS lng FROM orders)"""


def order_track(spark, sf_dir):
    key = F.col("id")
    return orders(spark, sf_dir).select(F.col("o_custkey").alias("run"), (seconds("o_orderdate") + key % 1000).alias("t"), "id", (key * 13 % 1500 / 10.0 - 75).alias("lat"), (key * 29 % 3600 / 10.0 - 180).alias("lng"))


@query(f"""WITH {TRACK}, q AS (SELECT DISTINCT run, run AS id, 830000000 AS t FROM tr), xyz AS (SELECT run, t, cos(radians(lat)) * cos(radians(lng)) AS x, cos(radians(lat)) * sin(radians(lng)) AS y, sin(radians(lat)) AS z FROM tr),
a AS (SELECT q.id, max(xyz.t) AS t0, arg_max(x, xyz.t) AS x0, arg_max(y, xyz.t) AS y0, arg_max(z, xyz.t) AS z0 FROM q JOIN xyz ON xyz.run = q.run AND xyz.t <= q.t GROUP BY 1),
b AS (SELECT q.id, min(xyz.t) AS t1, arg_min(x, xyz.t) AS x1, arg_min(y, xyz.t) AS y1, arg_min(z, xyz.t) AS z1 FROM q JOIN xyz ON xyz.run = q.run AND xyz.t > q.t GROUP BY 1),
m AS (SELECT q.id, coalesce((830000000 - t0) / CAST(t1 - t0 AS DOUBLE), 0) AS f, * EXCLUDE (id) FROM q LEFT JOIN a ON a.id = q.id LEFT JOIN b ON b.id = q.id),
v AS (SELECT id, coalesce(x0 + (x1 - x0) * f, x0, x1) AS x, coalesce(y0 + (y1 - y0) * f, y0, y1) AS y, coalesce(z0 + (z1 - z0) * f, z0, z1) AS z FROM m)
SELECT id, round(degrees(asin(z / sqrt(x * x + y * y + z * z))), 3) AS lat, round(degrees(atan2(y, x)), 3) AS lng FROM v""")
def track_position(spark, sf_dir):
    track = order_track(spark, sf_dir)
    asked = track.select("run").distinct().select(F.col("run").alias("id"), "run", F.lit(830000000).cast("long").alias("t"))
    return layers.position_at(asked, track).select("id", F.round("lat", 3).alias("lat"), F.round("lng", 3).alias("lng"))


@query("""WITH c AS (SELECT event_type AS cell, CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS t, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2), d AS (SELECT t, lead(t) OVER (ORDER BY t) AS n FROM (SELECT DISTINCT t FROM c) x),
q AS (SELECT n_nationkey AS id, 1704067200 - 43200 + n_nationkey * 100000 AS t FROM nation), e AS (SELECT t AS a, n AS b, row_number() OVER (ORDER BY t DESC) AS last, row_number() OVER (ORDER BY t) AS first FROM d WHERE n IS NOT NULL),
p AS (SELECT id, q.t, a, b FROM q JOIN e ON (q.t >= a OR first = 1) AND (q.t < b OR last = 1)), f AS (SELECT *, least(greatest((t - a) / CAST(b - a AS DOUBLE), 0), 1) AS f FROM p)
SELECT id, x.cell, round(x.value + (y.value - x.value) * f, 4) AS value FROM f JOIN c x ON x.t = a JOIN c y ON y.t = b AND y.cell = x.cell""")
def frame_at(spark, sf_dir):
    cells = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cell"), (F.floor(seconds("ts") / DAY) * DAY).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.lit(T0 - 43200) + F.col("n_nationkey").cast("long") * 100000).alias("t"))
    return layers.frame_at(asked, cells).select(F.col("id").cast("int").alias("id"), "cell", F.round("value", 4).alias("value"))


PLACES = """p AS (SELECT c_custkey AS id, CAST((c_custkey * 13) % 1700 AS DOUBLE) / 10 - 85 AS lat1, CAST((c_custkey * 29) % 3600 AS DOUBLE) / 10 - 180 AS lng1, CAST((c_custkey * 7) % 1700 AS DOUBLE) / 10 - 85 AS lat2, CAST((c_custkey * 31) % 3500 AS DOUBLE) / 10 - 180 AS lng2 FROM customer)"""


def places(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), (key * 13 % 1700 / 10.0 - 85).alias("lat1"), (key * 29 % 3600 / 10.0 - 180).alias("lng1"), (key * 7 % 1700 / 10.0 - 85).alias("lat2"), (key * 31 % 3500 / 10.0 - 180).alias("lng2"))


@query(f"""WITH {PLACES}, x AS (SELECT id, k, k / 7.0 AS f, cos(radians(lat1)) * cos(radians(lng1)) AS ax, cos(radians(lat1)) * sin(radians(lng1)) AS ay, sin(radians(lat1)) AS az, cos(radians(lat2)) * cos(radians(lng2)) AS bx, cos(radians(lat2)) * sin(radians(lng2)) AS "by", sin(radians(lat2)) AS bz FROM p, range(0, 8) t(k)),
w AS (SELECT *, acos(least(greatest(ax * bx + ay * "by" + az * bz, -1), 1)) AS o FROM x), v AS (SELECT id, k, o, ax * sin((1 - f) * o) / sin(o) + bx * sin(f * o) / sin(o) AS x, ay * sin((1 - f) * o) / sin(o) + "by" * sin(f * o) / sin(o) AS y, az * sin((1 - f) * o) / sin(o) + bz * sin(f * o) / sin(o) AS z FROM w)
SELECT id, CAST(k AS INTEGER) AS k, CASE WHEN o < 1e-9 THEN round(CASE WHEN k = 0 THEN lat1 ELSE lat2 END, 3) ELSE round(degrees(asin(least(greatest(z / sqrt(x * x + y * y + z * z), -1), 1))), 3) END AS lat FROM v JOIN p USING (id) WHERE o >= 1e-9 OR k IN (0, 7)""")
def great_circles(spark, sf_dir):
    return layers.great_circle_points(places(spark, sf_dir), 8).select("id", "k", F.round("lat", 3).alias("lat"))


@query(f"""WITH {PLACES}, h AS (SELECT id, lat1, lat2, power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lng2 - lng1) / 2), 2) AS h, radians(lat1) AS a, radians(lat2) AS b FROM p)
SELECT id, round(2 * 6371008.8 * atan2(sqrt(h), sqrt(greatest(1 - h, 0))), 1) AS m,
  round(sqrt(power(2 * sin(a) + 3 * sin(b), 2) + power(2 * cos(a) + 3 * cos(b), 2)), 5) AS speed, round(greatest(0, sin(2 * pi() * ((id % 48 - lat1 / 15) / 24 - 0.25))), 6) AS sun,
  CASE WHEN abs(lat2 / 20) <= 3 THEN round(lat1 / 50 + sqrt(9 - power(lat2 / 20, 2)), 6) END AS crab FROM h""")
def geodesy(spark, sf_dir):
    a, b = F.col("lat1"), F.col("lat2")
    speed, _ = geo.add_flows(F.lit(2.0), a, F.lit(3.0), b)
    return places(spark, sf_dir).select("id", F.round(geo.great_circle_m(a, F.col("lng1"), b, F.col("lng2")), 1).alias("m"), F.round(speed, 5).alias("speed"), F.round(geo.solar_fraction(F.col("id") % 48, a), 6).alias("sun"), F.round(geo.crabbing_speed(F.lit(3.0), a / 50, b / 20), 6).alias("crab"))


@query("""SELECT o_custkey AS run, row_number() OVER w AS step, min(o_totalprice) OVER w AS nearest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def closest_so_far(spark, sf_dir):
    rows = orders(spark, sf_dir).select(F.col("o_custkey").alias("run"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("id")).alias("step"), F.col("o_totalprice").alias("km"))
    return layers.closest_so_far(rows)


@query("""SELECT o_custkey AS run, count(*) AS points, max(epoch(o_orderdate) / 3600) - min(epoch(o_orderdate) / 3600) AS hours, round(avg(CASE WHEN o_totalprice / 1000 <= 150 THEN 100.0 ELSE 0 END), 6) AS in_band, round(avg(CASE WHEN o_orderkey % 3 <> 0 THEN 100.0 ELSE 0 END), 6) AS skipped FROM orders GROUP BY 1""")
def track_reports(spark, sf_dir):
    rows = orders(spark, sf_dir).select(F.col("o_custkey").alias("run"), (seconds("o_orderdate") / 3600).alias("hours"), (F.col("o_totalprice") / 1000).alias("shore"), (F.col("id") % 3 == 0).alias("asked"))
    return layers.track_report(rows, 150.0).withColumns({c: F.round(c, 6) for c in ("in_band", "skipped")})


@query("""WITH c AS (SELECT n_regionkey AS run, n_nationkey AS pos, left(n_name, 1) AS channel FROM nation), g AS (SELECT channel, min(run * 1000 + pos) AS at_, count(DISTINCT run) AS runs FROM c GROUP BY 1)
SELECT channel, CAST(row_number() OVER (ORDER BY at_) - 1 AS INTEGER) AS place, runs, runs = (SELECT count(DISTINCT run) FROM c) AS everywhere FROM g""")
def channel_sets(spark, sf_dir):
    return layers.channel_sets(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("run"), F.col("n_nationkey").alias("pos"), F.substring("n_name", 1, 1).alias("channel")))


CANDIDATES = """c AS (SELECT l_orderkey AS id, l_linenumber AS pos, CAST(l_quantity AS INTEGER) % 5 AS score, l_quantity > 25 AS legal FROM lineitem)"""


def candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity").cast("int") % 5).alias("score"), (F.col("l_quantity") > 25).alias("legal"))
    return rows.groupBy("id", "pos").agg(F.max("score").alias("score"), F.max("legal").alias("legal"))


@query(f"""WITH {CANDIDATES}, g AS (SELECT id, pos, max(score) AS score, max(legal) AS legal FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS n FROM g) SELECT id, pos, score, legal FROM r WHERE n = 1""")
def best_heading(spark, sf_dir):
    return layers.best_candidate(candidates(spark, sf_dir))


@query(f"""WITH {CANDIDATES}, g AS (SELECT id, pos, max(score) AS score, max(legal) AS legal FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM g WHERE legal) SELECT id, pos, score, legal FROM r WHERE n = 1""")
def first_heading(spark, sf_dir):
    return layers.first_legal(candidates(spark, sf_dir))


@query("""SELECT n_name AS run, n_nationkey AS pos FROM nation ORDER BY n_nationkey, n_name LIMIT 10""")
def chart_runs(spark, sf_dir):
    return layers.first_runs(table(spark, sf_dir, "nation").select(F.col("n_name").alias("run"), F.col("n_nationkey").alias("pos")))[0]


@query("""SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1""")
def repeated_names(spark, sf_dir):
    return layers.duplicate_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query("""WITH q AS (SELECT event_type, quantile_cont(value - 50, 0.02) AS a, quantile_cont(value - 50, 0.98) AS b FROM events GROUP BY 1) SELECT event_type, round(-greatest(abs(a), abs(b)), 6) AS lo, round(greatest(abs(a), abs(b)), 6) AS hi FROM q""")
def diverging_limits(spark, sf_dir):
    got = layers.limits(table(spark, sf_dir, "events").select("event_type", (F.col("value") - 50).alias("value")), ["event_type"], diverging=True)
    return got.select("event_type", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("""SELECT event_type, round(quantile_cont(value, 0.98), 6) AS cap FROM events GROUP BY 1""")
def colour_cap(spark, sf_dir):
    return layers.cap(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"]).withColumn("cap", F.round("cap", 6))


# --- water


#: A map of 64 columns whose rows grow with the customers; land by account and by rule.
COLS = 64


def sea_cells(spark, sf_dir):
    cell = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(cell.alias("cell"), F.floor(cell / COLS).alias("row"), (cell % COLS).alias("col"), ((F.col("c_acctbal") >= -500) & (F.pmod(cell, F.lit(13)) != 5)).alias("water"))
    return base.withColumns({"lat": F.col("row") * 0.02, "lng": F.col("col") * 0.5})


SEA = f"""m AS (SELECT c_custkey AS cell, c_custkey // {COLS} AS row, c_custkey % {COLS} AS col, c_acctbal >= -500 AND c_custkey % 13 <> 5 AS water FROM customer), w AS (SELECT * FROM m WHERE water),
nb(dr, dc) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)), e AS (SELECT a.cell AS src, b.cell AS dst FROM w a, nb JOIN w b ON b.row = a.row + dr AND b.col = (a.col + dc + {COLS}) % {COLS}),
km AS (SELECT src, dst, 2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians((b.row - a.row) * 0.02) / 2), 2) + cos(radians(a.row * 0.02)) * cos(radians(b.row * 0.02)) * power(sin(radians((b.col - a.col) * 0.5) / 2), 2)))) AS km FROM e JOIN w a ON a.cell = src JOIN w b ON b.cell = dst)"""


def sea_edges(spark, sf_dir):
    return water.adjacency(sea_cells(spark, sf_dir).where("water"), COLS)


@query(f"""WITH RECURSIVE {SEA}, r AS (SELECT min(src) AS cell FROM e UNION SELECT e.dst FROM r JOIN e ON e.src = r.cell) SELECT cell FROM r""")
def sea_component(spark, sf_dir):
    edges = sea_edges(spark, sf_dir)
    return water.component(edges, edges.agg(F.min("src")).first()[0])


@query(f"""WITH RECURSIVE {SEA}, d AS (SELECT cell, CAST((row * 5 + col * 11) % 17 + 1 AS DOUBLE) AS d FROM w), s AS (SELECT min(src) AS cell FROM e), r(cell, v) USING KEY (cell) AS (SELECT cell, d FROM d WHERE cell = (SELECT cell FROM s) UNION
 SELECT x.cell, x.v FROM (SELECT e.dst AS cell, max(least(r.v, d.d)) AS v FROM r JOIN e ON e.src = r.cell JOIN d ON d.cell = e.dst GROUP BY e.dst) x LEFT JOIN recurring.r o ON o.cell = x.cell WHERE o.cell IS NULL OR x.v > o.v)
SELECT cell, 2 * v AS width FROM r""")
def sea_width(spark, sf_dir):
    edges = sea_edges(spark, sf_dir)
    depth = sea_cells(spark, sf_dir).where("water").select("cell", (F.pmod(F.col("row") * 5 + F.col("col") * 11, F.lit(17)) + 1).cast("double").alias("d"))
    return water.access_width(depth, edges, edges.agg(F.min("src")).first()[0]).withColumnRenamed("value", "width")


TOUCH = f"""tr AS (SELECT DISTINCT a.cell FROM m a, nb LEFT JOIN m b ON b.row = a.row + dr AND b.col = (a.col + dc + {COLS}) % {COLS} WHERE b.cell IS NULL),
sh AS (SELECT DISTINCT a.cell FROM w a, nb JOIN m b ON b.row = a.row + dr AND b.col = (a.col + dc + {COLS}) % {COLS} AND NOT b.water WHERE a.cell NOT IN (SELECT cell FROM tr))"""


@query(f"""WITH {SEA}, {TOUCH} SELECT cell FROM tr""")
def truncated_cells(spark, sf_dir):
    return water.truncated(sea_cells(spark, sf_dir), COLS)


@query(f"""WITH {SEA}, {TOUCH} SELECT cell FROM sh""")
def shore_cells(spark, sf_dir):
    cells = sea_cells(spark, sf_dir)
    return water.shore_sources(cells, cells.where("water"), COLS)


@query(f"""WITH RECURSIVE {SEA}, {TOUCH}, r(cell, v) USING KEY (cell) AS (SELECT cell, CAST(1.5 + cell % 3 AS DOUBLE) AS v FROM sh UNION
 SELECT x.cell, x.v FROM (SELECT g.dst AS cell, min(r.v + g.km) AS v FROM r JOIN km g ON g.src = r.cell GROUP BY g.dst) x LEFT JOIN recurring.r o ON o.cell = x.cell WHERE o.cell IS NULL OR x.v < o.v - 1e-12)
SELECT cell, round(v, 3) AS km FROM r""")
def sea_distance(spark, sf_dir):
    cells = sea_cells(spark, sf_dir)
    sources = water.shore_sources(cells, cells.where("water"), COLS).select("cell", (F.lit(1.5) + F.col("cell") % 3).alias("value"))
    return water.shore_distance(sources, sea_edges(spark, sf_dir)).select("cell", F.round("value", 3).alias("km"))


@query("""WITH c AS (SELECT c_custkey AS cell, CAST(c_custkey % 180 AS DOUBLE) - 90 AS lat, CAST(c_custkey % 360 AS DOUBLE) AS lng, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS km FROM customer), t AS (SELECT lat, lng, km FROM c WHERE km IS NOT NULL ORDER BY km DESC, lat DESC, lng DESC LIMIT 1)
SELECT (SELECT count(*) FROM c) AS cells, (SELECT count(km) FROM c) AS connected, lat, lng, km FROM t""")
def furthest_cell(spark, sf_dir):
    key = F.col("c_custkey")
    return water.furthest(table(spark, sf_dir, "customer").select(key.alias("cell"), (key % 180).cast("double").alias("lat"), (key % 360).cast("double").alias("lng"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("km")).withColumn("lat", F.col("lat") - 90))


BASE = """b AS (SELECT c_custkey // 64 AS row, c_custkey % 64 AS col, least(max(c_acctbal) / 100 - 5, (abs(max(c_acctbal)) / 40 - 12) / 2) AS margin, max(c_acctbal) / 100 - 6 AS budget FROM customer GROUP BY 1, 2),
l AS (SELECT CAST(v AS INTEGER) AS level, CAST(power(2, v) AS BIGINT) AS f FROM range(0, 4) t(v)), y AS (SELECT level, row // f AS row, col // f AS col, min(margin) AS lo, max(margin) AS hi, min(budget) AS budget FROM b, l GROUP BY 1, 2, 3)"""


def tree(spark, sf_dir):
    from tidalgrid.queries import pyramid_base

    return water.pyramid(pyramid_base(spark, sf_dir), 4, toward_zero=True)


@query(f"""WITH {BASE} SELECT level, row, col, lo >= 0 AS legal, hi < 0 AS illegal FROM y WHERE level >= 1""")
def map_leaves(spark, sf_dir):
    return water.leaves(tree(spark, sf_dir), 1)


@query(f"""WITH {BASE}, p AS (SELECT o_orderkey AS id, (o_orderkey * 7) % 30 AS row, (o_orderkey * 11) % 70 AS col FROM orders), f AS (SELECT p.id, l.level, y.lo, y.budget FROM p CROSS JOIN l LEFT JOIN y ON y.level = l.level AND y.row = p.row // l.f AND y.col = p.col // l.f),
h AS (SELECT id, coalesce(max(CASE WHEN lo IS NULL THEN level END), -1) AS hole FROM f GROUP BY 1), d AS (SELECT f.id, min(level) AS level FROM f JOIN h USING (id) WHERE f.level > hole GROUP BY 1)
SELECT h.id, CASE WHEN d.level IS NULL THEN CAST('inf' AS DOUBLE) WHEN f.lo >= 0 THEN round(f.budget + 5 + 1, 6) END AS km FROM h LEFT JOIN d USING (id) LEFT JOIN f ON f.id = d.id AND f.level = d.level""")
def deepest_lookup(spark, sf_dir):
    points = orders(spark, sf_dir).select("id", (F.col("id") * 7 % 30).alias("row"), (F.col("id") * 11 % 70).alias("col"))
    return water.deepest(points, tree(spark, sf_dir), 4, 5.0, 2.0, toward_zero=True).withColumn("km", F.round("km", 6))


@query(f"""WITH {BASE}, o3 AS (SELECT row, col FROM y WHERE level = 3), y2 AS (SELECT * FROM y WHERE level = 2), rg(a, b) AS (SELECT a, b FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) z(b)),
o2 AS (SELECT DISTINCT row + a AS row, col + b AS col FROM y2, rg WHERE lo < 0 AND hi >= 0), y1 AS (SELECT y.* FROM y JOIN o2 ON y.row // 2 = o2.row AND y.col // 2 = o2.col WHERE level = 1),
o1 AS (SELECT DISTINCT row + a AS row, col + b AS col FROM y1, rg WHERE lo < 0 AND hi >= 0), y0 AS (SELECT y.* FROM y JOIN o1 ON y.row // 2 = o1.row AND y.col // 2 = o1.col WHERE level = 0)
SELECT level, row, col, round(lo, 6) AS lo, round(hi, 6) AS hi, round(budget, 6) AS budget FROM (SELECT * FROM y WHERE level = 3 UNION ALL SELECT * FROM y2 UNION ALL SELECT * FROM y1 UNION ALL SELECT * FROM y0) u""")
def map_settled(spark, sf_dir):
    from tidalgrid.queries import pyramid_base

    got = water.settled_pyramid(pyramid_base(spark, sf_dir), 4, 2, toward_zero=True)
    return got.select("level", "row", "col", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "budget")])


@query("""WITH RECURSIVE s AS (SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS step, CAST(l_quantity AS DOUBLE) AS km, l_discount < 0.09 AS legal, CAST(l_partkey % 200 AS DOUBLE) AS budget FROM lineitem),
w AS (SELECT run, CAST(0 AS BIGINT) AS step, TRUE AS legal, CAST(0 AS DOUBLE) AS lft, FALSE AS asked FROM (SELECT DISTINCT run FROM s) x UNION ALL
 SELECT s.run, s.step, w.lft - s.km > 0 OR s.legal, CASE WHEN w.lft - s.km > 0 THEN w.lft - s.km WHEN s.legal THEN s.budget ELSE 0 END, w.lft - s.km <= 0 FROM w JOIN s ON s.run = w.run AND s.step = w.step + 1)
SELECT run, step, legal, lft AS left_, asked FROM w WHERE step > 0""")
def budget_walk(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.row_number().over(order).alias("step"), F.col("l_quantity").alias("km"), (F.col("l_discount") < 0.09).alias("legal"), (F.col("l_partkey") % 200).alias("budget"))
    return water.budget_walk(rows).withColumnRenamed("left", "left_")


@query("""WITH p AS (SELECT o_orderkey AS id, CAST((o_orderkey * 31) % 1000 AS DOUBLE) / 10 + 0.05 AS x, CAST((o_orderkey * 17) % 600 AS DOUBLE) / 10 + 0.05 AS y FROM orders), s(x1, y1, x2, y2) AS (VALUES (10.0, 10.0, 90.0, 20.0), (90.0, 20.0, 80.0, 55.0), (80.0, 55.0, 20.0, 50.0), (20.0, 50.0, 10.0, 10.0)),
f AS (SELECT *, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)), 0), 1) AS f FROM p, s), n AS (SELECT id, x, y, x1 + f * (x2 - x1) AS px, y1 + f * (y2 - y1) AS py FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY power(px - x, 2) + power(py - y, 2), px, py) AS r FROM n)
SELECT id, round(2 * 6371.0088 * asin(sqrt(least(1, power(sin(radians(py - y) / 2), 2) + cos(radians(y)) * cos(radians(py)) * power(sin(radians(px - x) / 2), 2)))), 3) AS km FROM b WHERE r = 1""")
def shore_km(spark, sf_dir):
    points = orders(spark, sf_dir).select("id", (F.col("id") * 31 % 1000 / 10.0 + 0.05).alias("x"), (F.col("id") * 17 % 600 / 10.0 + 0.05).alias("y"))
    ring = [(10.0, 10.0), (90.0, 20.0), (80.0, 55.0), (20.0, 50.0)]
    edges = spark.createDataFrame([(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])], "x1 double, y1 double, x2 double, y2 double")
    return water.nearest_shore_km(points, edges).withColumn("km", F.round("km", 3))


@query(f"""WITH {BASE}, p AS (SELECT o_orderkey AS id, (o_orderkey * 7) % 30 AS row, (o_orderkey * 11) % 70 AS col FROM orders), f AS (SELECT p.*, l.level, y.lo, y.hi FROM p CROSS JOIN l LEFT JOIN y ON y.level = l.level AND y.row = p.row // l.f AND y.col = p.col // l.f),
d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level DESC) AS n FROM f WHERE lo IS NULL OR lo >= 0 OR hi < 0 OR level = 0) SELECT id, row, col FROM d WHERE n = 1 AND lo >= 0""")
def legal_points(spark, sf_dir):
    points = orders(spark, sf_dir).select("id", (F.col("id") * 7 % 30).alias("row"), (F.col("id") * 11 % 70).alias("col"))
    return water.legal(points, tree(spark, sf_dir), 4, toward_zero=True)


@query(f"""WITH RECURSIVE {SEA}, ok AS (SELECT cell FROM w WHERE cell % 7 <> 3), g AS (SELECT k.* FROM km k JOIN ok a ON a.cell = k.src JOIN ok b ON b.cell = k.dst), r(cell, v) USING KEY (cell) AS (SELECT cell, CAST(0 AS DOUBLE) AS v FROM ok WHERE cell = 130 UNION
 SELECT x.cell, x.v FROM (SELECT g.dst AS cell, min(r.v + g.km) AS v FROM r JOIN g ON g.src = r.cell GROUP BY g.dst) x LEFT JOIN recurring.r o ON o.cell = x.cell WHERE o.cell IS NULL OR x.v < o.v - 1e-12)
SELECT cell, round(v, 3) AS km FROM r""")
def cost_to_go(spark, sf_dir):
    cells = sea_cells(spark, sf_dir).where("water and cell % 7 <> 3")
    return water.cost_to_go(130, cells, sea_edges(spark, sf_dir)).select("cell", F.round("value", 3).alias("km"))


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal <= 600 THEN 0.0 ELSE 500.0 END AS motor, CASE WHEN c_acctbal <= 0 THEN 0.0 WHEN c_acctbal <= 600 THEN 25.0 ELSE 100.0 END AS avionics FROM customer""")
def power_policy(spark, sf_dir):
    motor, other = geo.power_policy(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), motor.alias("motor"), other.alias("avionics"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'j m**-2' WHEN 1 THEN 'm s-1' WHEN 2 THEN 'kg m-2' ELSE 'j/m2' END AS units, p_partkey % 4 IN (0, 3) OR p_partkey % 3 = 0 AS accumulated FROM part""")
def plain_units(spark, sf_dir):
    units = F.element_at(F.array(*[F.lit(u) for u in (" J   m**-2", "M S-1 ", "kg  m-2", "J/m2")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    total = geo.is_accumulated(units, F.when(F.col("p_partkey") % 3 == 0, "area: mean time : sum").otherwise("time: mean"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), geo.plain_units(units).alias("units"), total.alias("accumulated"))


@query("""WITH r AS (SELECT DISTINCT o_orderpriority AS source, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders), g AS (SELECT source, t - lag(t) OVER (PARTITION BY source ORDER BY t) AS d FROM r)
SELECT source, min(d) AS shortest, max(d) AS longest FROM g GROUP BY 1 HAVING min(d) <> max(d)""")
def uneven_sources(spark, sf_dir):
    return fields.uneven_sources(dated(spark, sf_dir))


@query("""WITH s AS (SELECT o_orderpriority AS source, min(epoch(o_orderdate)) AS a, max(epoch(o_orderdate)) AS b FROM orders GROUP BY 1), l AS (SELECT source, b, max(b) OVER (ORDER BY a, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s) SELECT source FROM l WHERE b <= m""")
def skipped_sources(spark, sf_dir):
    return fields.skipped_sources(dated(spark, sf_dir))


@query("""SELECT n_nationkey AS id, CAST(floor((n_nationkey * 0.3) / 0.5 + 0.5) * 720 + CAST(floor((n_nationkey * 14.7 + 180) / 0.5 + 0.5) AS BIGINT) % 720 AS BIGINT) AS cell, CAST((n_nationkey + 1) * 720 AS BIGINT) AS cells, round((n_nationkey + 1) * 720 * 230 / 1073741824.0, 9) AS gb FROM nation""")
def map_cells_of_points(spark, sf_dir):
    key = F.col("n_nationkey")
    n, gb = water.cell_count((key + 1).cast("long"), F.lit(720))
    return table(spark, sf_dir, "nation").select(key.alias("id"), water.cell_of(key * 0.3, key * 14.7, 720, 0.0, -180.0, 0.5).cast("long").alias("cell"), n.alias("cells"), F.round(gb, 9).alias("gb"))


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
