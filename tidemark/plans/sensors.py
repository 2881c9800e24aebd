"""More registered queries: rotations, units and texts, gates, gaps, similarity, selections. Same table and roles as in catalog.py.

A device's day log (one row a day, its largest reading) serves where the operators need ticks with gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import physics, rotation, text, units
from tidemark.operators import agreement, gates, lookups, modes, motion, sliced, statistics, windows
from tidemark.operators.sliced import Series
from tidemark.plans.catalog import ORDER, OVER, QUERIES, log, query, scalar, six

US = "epoch_us(ts)"
DAY_SQL = f"d AS (SELECT user_id, ({US} // 86400000000)::BIGINT AS tick, max(value) AS v FROM events GROUP BY ALL)"


def seconds() -> Column:
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)


def days(e: DataFrame) -> DataFrame:
    tick = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000)
    return e.groupBy("user_id", tick.alias("tick")).agg(F.max("value").alias("v"))


# --- physics, units, texts

scalar("vapour_pressure", lambda e: physics.vapour_pressure(F.pmod(e.v, F.lit(40.0)), F.lit(45.0)), "0.45 * 6.112 * exp(17.62 * (v % 40) / (243.12 + v % 40))")
scalar("oxygen_left", lambda e: physics.oxygen(20.9, physics.foreign_fraction({"co": e.v * 10, "ch4": e.v / 5}, {"co": 25.0}, {"ch4": 4.4})), "20.9 * (1 - (greatest(v * 10 - 25, 0) * 1e-6 + greatest(v / 5, 0) / 100 * 4.4 / 100))")
scalar("quantised_decimal", lambda e: physics.quantised(e.v - 25, 0.1, -20, 60), "least(greatest(round(round_even((v - 25) / 0.1, 0) * 0.1, 10) + 0.0, -20), 60)")
scalar("raw_counts", lambda e: text.raw_counts(e.v, 0.25) * 100 + text.sample_bits(0, 500, 0.25), "round_even(v / 0.25, 0) * 100 + ceil(log2(500 / 0.25 + 1))")
scalar("fahrenheit_output", lambda e: e.v * units.output_transform("°C", "degF")[0] + units.output_transform("°C", "degF")[1] + e.v * units.output_transform("°C/min", "F/min")[0], "v * 1.8 + 32 + v * 1.8")


@query("""SELECT event_id, unit, round(value * CASE unit WHEN 'Pa' THEN 0.01 WHEN 'kPa' THEN 10 WHEN 'mbar' THEN 1 WHEN 'hPa' THEN 1 END, 8) AS hpa,
  round(value * CASE unit WHEN 'Pa' THEN 0.01 WHEN 'kPa' THEN 10 WHEN 'mbar' THEN 1 WHEN 'hPa' THEN 1 END * 24.0 / 730.0, 8) AS hpa_per_day
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'Pa' WHEN 'view' THEN 'kPa' WHEN 'purchase' THEN 'mbar' WHEN 'signup' THEN 'hPa' ELSE 'mg' END AS unit FROM events)""")
def unit_convert(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    own = e.withColumn("unit", F.when(kind == "click", "Pa").when(kind == "view", "kPa").when(kind == "purchase", "mbar").when(kind == "signup", "hPa").otherwise("mg"))
    return own.select("event_id", "unit", F.round(F.col("value") * units.factor(F.col("unit"), "hPa"), 8).alias("hpa"), F.round(F.col("value") * units.factor(F.concat("unit", F.lit("/month")), "hPa/day"), 8).alias("hpa_per_day"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%H:%M:%S') WHEN 1 THEN strftime(ts, '%H:%M') WHEN 2 THEN round(value)::BIGINT || 'min' WHEN 3 THEN round(value)::BIGINT || ' h' ELSE 'soon' END AS s, ts, round(value)::BIGINT AS v FROM events),
p AS (SELECT event_id, s, CASE event_id % 5 WHEN 0 THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) WHEN 1 THEN hour(ts) * 3600 + minute(ts) * 60 WHEN 2 THEN v * 60 WHEN 3 THEN v * 3600 END::DOUBLE AS t, ts FROM s)
SELECT event_id, t, CASE WHEN t IS NOT NULL THEN lpad((t::BIGINT // 3600)::VARCHAR, greatest(2, length((t::BIGINT // 3600)::VARCHAR))::INTEGER, '0') || ':' || lpad((t::BIGINT // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((t::BIGINT % 60)::VARCHAR, 2, '0') END AS hms,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM p""")
def times_parsed(e: DataFrame) -> DataFrame:
    n, whole = F.col("event_id") % 5, F.round("value").cast("long").cast("string")
    s = F.when(n == 0, F.date_format("ts", "HH:mm:ss")).when(n == 1, F.date_format("ts", "HH:mm")).when(n == 2, F.concat(whole, F.lit("min"))).when(n == 3, F.concat(whole, F.lit(" h"))).otherwise("soon")
    own = e.select("event_id", "ts", text.parse_time(s).alias("t"))
    return own.select("event_id", "t", F.when(F.col("t").isNotNull(), text.hms(F.col("t"))).alias("hms"), text.iso_utc(F.col("ts")).alias("utc"))


@query("""SELECT event_id, trim(regexp_replace(lower(event_type || ' / Temp ' || props), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CASE WHEN event_type = 'signup' THEN 'humidity' WHEN event_type = 'view' THEN 'magnetic' WHEN event_type = 'click' THEN 'temperature' ELSE 'other' END AS category,
  (event_id % 2 = 0) AS iso, (props->>'$.k')::INTEGER AS k FROM events""")
def names_and_json(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    column = F.when(kind == "signup", "Rel_HUMidity").when(kind == "view", "mag_x").when(kind == "click", "temperature_mag").otherwise("gps")
    stamp = F.when(F.col("event_id") % 2 == 0, text.iso_utc(F.col("ts"))).otherwise(F.col("ts").cast("string"))
    return e.select("event_id", text.slug(F.concat(kind, F.lit(" / Temp "), "props")).alias("slug"), text.category(column).alias("category"), text.is_iso_utc(stamp).alias("iso"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT event_id, trim(user_id || ' ' || upper(event_type) || ': ' || event_type || ' {nobody} ' || coalesce(props->>'$.k', '')) AS label FROM events""")
def label_text(e: DataFrame) -> DataFrame:
    values = {"user": F.col("user_id"), "kind": F.col("event_type"), "k": F.get_json_object("props", "$.k")}
    return e.select("event_id", text.filled(" {user} {kind.upper}: {kind} {nobody} {k} ", values).alias("label"))


@query("""SELECT CASE WHEN value < 20 THEN 'low' WHEN value < 90 THEN 'usual' ELSE 'high' END AS state, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events WHERE event_id % 3 = 0 OR value < 90 OR event_type IN ('view', 'error') GROUP BY 1""")
def state_kinds(e: DataFrame) -> DataFrame:
    """The kinds of event that put a device into each state."""
    state = F.when(F.col("value") < 20, "low").when(F.col("value") < 90, "usual").otherwise("high")
    own = e.where((F.col("event_id") % 3 == 0) | (F.col("value") < 90) | F.col("event_type").isin("view", "error"))
    return own.groupBy(state.alias("state")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query(f"""WITH a AS (SELECT user_id, value, row_number() OVER {OVER} AS i FROM events WHERE event_type = 'view'), b AS (SELECT user_id, value, row_number() OVER {OVER} AS i FROM events WHERE event_type = 'click')
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.i, b.i) AS i, a.value AS view, b.value AS click FROM a FULL JOIN b ON a.user_id = b.user_id AND a.i = b.i""")
def rows_aligned(e: DataFrame) -> DataFrame:
    """A device's views and clicks side by side, by their number."""
    a, b = (e.where(F.col("event_type") == k).select("user_id", "ts", "event_id", "value") for k in ("view", "click"))
    return lookups.aligned(a, b, "user_id", ORDER).select("user_id", "i", F.col("left.value").alias("view"), F.col("right.value").alias("click"))


@query(f"""WITH p AS (SELECT *, row_number() OVER {OVER} AS i, event_type IN ('error', 'signup') AS q FROM events), c AS (SELECT *, CASE WHEN q IS DISTINCT FROM lag(q) OVER {OVER} THEN 1 ELSE 0 END AS c FROM p),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c), b AS (SELECT user_id, run, min(i) AS s, max(i) + 1 AS e FROM r WHERE q GROUP BY ALL),
o AS (SELECT b.user_id, b.run, b.s, min(p.i) FILTER (p.value - 10 > 4.0) AS up, min(p.i) FILTER (100 - p.value - 10 > 2.5) AS other FROM b JOIN p ON p.user_id = b.user_id AND p.i >= greatest(1, b.s - 2) AND p.i < b.e GROUP BY ALL),
n AS (SELECT user_id, count(*) FILTER (up IS DISTINCT FROM s OR other IS DISTINCT FROM s) AS late, count(*) AS runs FROM o GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, 'bump_late' AS "rule", coalesce(late, 0) AS violations FROM u LEFT JOIN n USING (user_id) UNION ALL SELECT user_id, 'bump_missing', (runs IS NULL)::BIGINT FROM u LEFT JOIN n USING (user_id)""")
def gate_bump(e: DataFrame) -> DataFrame:
    """Errors and signups as tests in which the reading and 100 minus it have to move at once."""
    own = e.withColumn("testing", F.col("event_type").isin("error", "signup")).withColumn("rest", 100 - F.col("value"))
    return gates.bumps(own, "user_id", ORDER, "testing", {"value": (10.0, 90.0, 0.5), "rest": (10.0, 60.0, 0.5)}, before=2)


# --- rotations: roll, pitch and yaw are 4, 1.5 and 0.7 times the reading, in degrees

Q_SQL = f"""h AS (SELECT event_id, user_id, ts, radians(4 * value) / 2 AS r, radians(1.5 * value) / 2 AS p, radians(0.7 * value) / 2 AS y, {US} / 1e6 AS t FROM events),
q AS (SELECT event_id, user_id, ts, t, cos(r) * cos(p) * cos(y) + sin(r) * sin(p) * sin(y) AS qw, sin(r) * cos(p) * cos(y) - cos(r) * sin(p) * sin(y) AS qx,
  cos(r) * sin(p) * cos(y) + sin(r) * cos(p) * sin(y) AS qy, cos(r) * cos(p) * sin(y) - sin(r) * sin(p) * cos(y) AS qz FROM h)"""


def oriented(e: DataFrame) -> DataFrame:
    v = F.col("value")
    return e.select("event_id", "user_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), rotation.from_euler(4 * v, 1.5 * v, 0.7 * v).alias("q"))


@query(f"""WITH {Q_SQL} SELECT event_id, round(1 - 2 * (qy * qy + qz * qz) + 4 * (qx * qy - qw * qz) + 6 * (qx * qz + qw * qy), 6) AS x, round(2 * (qx * qy + qw * qz) + 2 * (1 - 2 * (qx * qx + qz * qz)) + 6 * (qy * qz - qw * qx), 6) AS y,
  round(2 * (qx * qz - qw * qy) + 4 * (qy * qz + qw * qx) + 3 * (1 - 2 * (qx * qx + qy * qy)), 6) AS z FROM q""")
def quat_rotate(e: DataFrame) -> DataFrame:
    r = rotation.rotated(F.col("q"), rotation.vector(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return oriented(e).select("event_id", r.alias("r")).select("event_id", *(six(F.col(f"r.{c}")).alias(c) for c in "xyz"))


@query(f"""WITH {Q_SQL} SELECT event_id, round(qw * 0.8 - qx * 0.6, 6) AS w, round(qw * 0.6 + qx * 0.8, 6) AS x, round(qy * 0.8 + qz * 0.6, 6) AS y, round(qz * 0.8 - qy * 0.6, 6) AS z,
  round(degrees(2 * acos(least(abs(qw * 0.8 + qx * 0.6), 1))), 4) AS angle, round(degrees(acos(greatest(-1, least(1, 2 * (qy * qz + qw * qx) * 0.96 + (1 - 2 * (qx * qx + qy * qy)) * 0.28)))), 4) AS tilt FROM q""")
def quat_product(e: DataFrame) -> DataFrame:
    fixed = rotation.quaternion(F.lit(0.8), F.lit(0.6), F.lit(0.0), F.lit(0.0))
    own = oriented(e).withColumn("f", fixed)
    return own.withColumn("m", rotation.product(F.col("q"), F.col("f"))).select("event_id", *(six(F.col(f"m.{c}")).alias(c) for c in "wxyz"), F.round(rotation.angle_degrees(F.col("q"), F.col("f")), 4).alias("angle"), F.round(rotation.tilt_degrees(F.col("q"), F.col("f")), 4).alias("tilt"))


@query(f"""WITH {Q_SQL}, c AS (SELECT *, CASE WHEN qw < 0 THEN -1 ELSE 1 END AS s FROM q)
SELECT event_id, round(s * qw, 6) AS w, round(s * qx, 6) AS x, round(abs(qw), 5) AS w_again FROM c""")
def quat_canonical(e: DataFrame) -> DataFrame:
    own = oriented(e).withColumn("c", rotation.canonical(F.col("q")))
    again = rotation.with_w(F.col("c.x"), F.col("c.y"), F.col("c.z"))
    return own.select("event_id", six(F.col("c.w")).alias("w"), six(F.col("c.x")).alias("x"), F.round(again["w"], 5).alias("w_again"))


@query(f"""WITH {Q_SQL}, f AS (SELECT *, CASE WHEN qw * lag(qw) OVER w + qx * lag(qx) OVER w + qy * lag(qy) OVER w + qz * lag(qz) OVER w < 0 THEN 1 ELSE 0 END AS f FROM q WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(qw * CASE WHEN sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 2 = 1 THEN -1 ELSE 1 END, 6) AS w FROM f""")
def quat_unwrap(e: DataFrame) -> DataFrame:
    own = log(oriented(e)).framed(1, f=lambda w: rotation.flips(F.col("q"), w))
    return windows.unwrapped_sign(own, "sign", F.col("f")).rows.select("event_id", six(F.col("q.w") * F.col("sign")).alias("w"))


@query(f"""WITH {Q_SQL} SELECT event_id, round(degrees(2 * acos(least(abs(qw * lag(qw) OVER w + qx * lag(qx) OVER w + qy * lag(qy) OVER w + qz * lag(qz) OVER w), 1))) / (t - lag(t) OVER w), 5) AS speed
FROM q WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def angular_speed(e: DataFrame) -> DataFrame:
    return log(oriented(e)).framed(1, speed=lambda w: F.round(rotation.angular_speed(F.col("q"), F.col("t"), w), 5)).rows.select("event_id", "speed")


# --- windows and state

@query(f"""WITH m AS (SELECT event_id, user_id, ts, {US} // 1000000 AS t, stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING) > 30 AS m FROM events),
s AS (SELECT event_id, t - coalesce(last_value(CASE WHEN m THEN t END IGNORE NULLS) OVER {OVER}, first_value(t) OVER {OVER} - 60) AS still FROM m)
SELECT event_id, still::BIGINT AS still, CASE WHEN still >= 90000 THEN 'alert' WHEN still >= 40000 THEN 'pre_alarm' ELSE 'ok' END AS state FROM s""")
def stillness_timer(e: DataFrame) -> DataFrame:
    own = log(e).with_columns(t=seconds()).framed(3, m=lambda w: windows.moving([F.col("value")], w, 4, 30.0))
    own = windows.since(own, "still", F.col("m"), F.col("t"), 60).rows
    return own.select("event_id", F.col("still").cast("long").alias("still"), windows.stillness(F.col("still"), 40000, 50000).alias("state"))


@query(f"""WITH m AS (SELECT *, CASE WHEN value <= 5 THEN 1 WHEN value > 8 THEN 0 END AS m FROM events)
SELECT event_id, CASE WHEN last_value(m IGNORE NULLS) OVER {OVER} = 1 THEN 'LOW' ELSE 'fine' END AS low, max((value >= 120)::INTEGER) OVER {OVER} AS ever FROM m""")
def alarm_chain(e: DataFrame) -> DataFrame:
    v = F.col("value")
    own = windows.threshold_alarm(log(e), "low", v, 5, above=False, hysteresis=3, on="LOW", off="fine")
    return windows.threshold_alarm(own, "ever", v, 120, latching=True).rows.select("event_id", "low", "ever")


@query(f"""WITH d0 AS (SELECT event_id, user_id, {US} // 1000000 AS t FROM events), i AS (SELECT user_id, t AS s, t + 10800 AS e FROM d0 JOIN events USING (event_id, user_id) WHERE event_type = 'signup')
SELECT event_id, EXISTS (SELECT 1 FROM i WHERE i.user_id = d0.user_id AND t >= s AND t < e)::INTEGER AS flag FROM d0""")
def state_flag(e: DataFrame) -> DataFrame:
    p = e.select("event_id", "user_id", seconds().alias("t"), "event_type")
    i = p.where("event_type = 'signup'").select("user_id", F.col("t").alias("s"), (F.col("t") + 10800).alias("e"))
    clear = lookups.outside(p, i, "user_id", "t", "s", "e", 10800).select("event_id", F.lit(1).alias("clear"))
    return p.join(clear, "event_id", "left").select("event_id", F.when(F.col("clear").isNull(), 1).otherwise(0).alias("flag"))


@query(f"""WITH p AS (SELECT event_id, user_id, ts, event_type, value, CASE WHEN event_type = 'purchase' THEN 1 WHEN value < 20 THEN 0 END AS m FROM events)
SELECT event_id, CASE WHEN last_value(m IGNORE NULLS) OVER {OVER} = 1 THEN 'exposed' ELSE 'normal' END AS mode FROM p""")
def event_mode(e: DataFrame) -> DataFrame:
    """From an event's row until the reading is back below 20."""
    return windows.latch(log(e), "mode", F.col("event_type") == "purchase", F.col("value") < 20, on="exposed", off="normal").rows.select("event_id", "mode")


@query(f"""WITH p AS (SELECT event_id, user_id, event_type, value, {US} // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY {US} // 1000000, event_id) AS i FROM events),
v AS (SELECT user_id, t AS s, t + 7200 AS e FROM p WHERE event_type = 'purchase' AND value > 60),
f AS (SELECT v.user_id, s, e, (SELECT min(i) FROM p WHERE p.user_id = v.user_id AND p.t >= s) AS i0, (SELECT min(i) FROM p WHERE p.user_id = v.user_id AND p.t >= e) AS i1 FROM v),
b AS (SELECT f.*, p.value AS base FROM f JOIN p ON p.user_id = f.user_id AND p.i = greatest(i0 - 1, 1)),
j AS (SELECT b.user_id, i0, CASE WHEN i1 IS NULL THEN NULL ELSE (SELECT min(i) FROM p WHERE p.user_id = b.user_id AND p.i >= i1 AND abs(p.value - base) <= 8) END AS j FROM b)
SELECT event_id, EXISTS (SELECT 1 FROM j WHERE j.user_id = p.user_id AND p.i >= i0 AND (j IS NULL OR p.i < j)) AS mode FROM p""")
def mode_until_back(e: DataFrame) -> DataFrame:
    """From a large purchase on, through two hours, until the reading is within 8 of the one before it."""
    own = e.select("event_id", "user_id", "event_type", "value", seconds().alias("t"))
    large = own.where("event_type = 'purchase' and value > 60").select("user_id", F.col("t").alias("s"), (F.col("t") + 7200).alias("e"))
    return modes.until_back(own, "user_id", ["t", "event_id"], "value", large, "s", "e", 8.0).select("event_id", "mode")


@query(f"""WITH i AS (SELECT user_id, {US} // 1000000 AS s, {US} // 1000000 + 3600 AS e FROM events WHERE event_type = 'signup'),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach >= 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS episode FROM m)
SELECT user_id, episode::BIGINT AS episode, min(s)::BIGINT AS s, max(e)::BIGINT AS e, count(*) AS n FROM n GROUP BY user_id, episode""")
def merged_episodes(e: DataFrame) -> DataFrame:
    i = e.where("event_type = 'signup'").select("user_id", seconds().alias("s"), (seconds() + 3600).alias("e"))
    return windows.episodes(i, "user_id", "s", "e", 7200)


@query(f"""WITH m AS (SELECT *, row_number() OVER w AS i, CASE WHEN count(value) OVER f >= 3 THEN stddev_samp(value) OVER f END AS sd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 5 PRECEDING)),
b AS (SELECT *, greatest(first_value(sd IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.5) AS g FROM m)
SELECT event_id, round(first_value(g) OVER (PARTITION BY user_id, (i - 1) // 4 ORDER BY ts, event_id), 5) AS sd FROM b""")
def held_deviation(e: DataFrame) -> DataFrame:
    own = log(e).framed(5, sd=lambda w: windows.rolling_deviation(F.col("value"), w, 6))
    return windows.held(own, "sd", 4, 1.5).select("event_id", F.round("sd", 5).alias("sd"))


# --- gaps and gates over the day log

BOUNDS_SQL = f"""{DAY_SQL}, b AS (SELECT *, least(tick - min(tick) OVER (PARTITION BY user_id) + 1, 5) - count(v) OVER w AS missing, sum(v) OVER w AS known FROM d WINDOW w AS (PARTITION BY user_id ORDER BY tick RANGE 4 PRECEDING))"""


@query(f"WITH {BOUNDS_SQL} SELECT user_id, tick, missing::BIGINT AS missing, round(known / 5, 6) AS low, round((known + 500 * missing) / 5, 6) AS high FROM b")
def win_gap_bounds(e: DataFrame) -> DataFrame:
    b = windows.gap_bounds(days(e), "user_id", "tick", "v", 5, 0.0, 500.0)
    return b.select("user_id", "tick", "missing", six(F.col("mean_low")).alias("low"), six(F.col("mean_high")).alias("high"))


@query(f"""WITH p AS (SELECT event_id, user_id, event_type, {US} // 1000000 AS t FROM events), g AS (SELECT user_id, t + 1 AS s, t + 7200 AS e FROM p WHERE event_type = 'error')
SELECT event_id, user_id, t::BIGINT AS t FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = p.user_id AND t >= s AND t < e)""")
def filter_gap(e: DataFrame) -> DataFrame:
    p = e.select("event_id", "user_id", "event_type", seconds().alias("t"))
    g = p.where("event_type = 'error'").select("user_id", (F.col("t") + 1).alias("s"), (F.col("t") + 7200).alias("e"))
    return lookups.outside(p, g, "user_id", "t", "s", "e", 7200).select("event_id", "user_id", "t")


@query("""WITH b AS (SELECT user_id, count(*) FILTER (NOT (value >= 0 - 1e-9 AND value <= 200 + 1e-9)) AS range, count(*) FILTER (NOT (abs(value / 0.05 - round_even(value / 0.05, 0)) < 1e-6 + 1e-9 * abs(value / 0.05) OR value = 0 OR value = 200)) AS resolution, count(*) FILTER (event_type NOT IN ('click', 'view', 'signup', 'error')) AS states FROM events GROUP BY user_id)
SELECT user_id, 'range' AS "rule", range AS violations FROM b UNION ALL SELECT user_id, 'resolution', resolution FROM b UNION ALL SELECT user_id, 'states', states FROM b""")
def gate_range_grid(e: DataFrame) -> DataFrame:
    v = F.col("value")
    return gates.counted(e, "user_id", range=gates.out_of_range(v, 0, 200), resolution=gates.off_grid(v, 0.05, 0, 200), states=~F.col("event_type").isin("click", "view", "signup", "error"))


TIMES_SQL = f"""{DAY_SQL}, g AS (SELECT DISTINCT user_id, {US} // 86400000000 - 1 AS s, {US} // 86400000000 + 1 AS e FROM events WHERE event_type = 'error'),
grid AS (SELECT user_id, unnest(range(min(tick), max(tick) + 1)) AS tick FROM d GROUP BY user_id),
u AS (SELECT DISTINCT user_id FROM d)
SELECT user_id, 'missing' AS "rule", (SELECT count(*) FROM grid WHERE grid.user_id = u.user_id AND NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = grid.user_id AND d.tick = grid.tick) AND NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = grid.user_id AND grid.tick >= s AND grid.tick < e)) AS violations FROM u
UNION ALL SELECT user_id, 'inside_gap', (SELECT count(*) FROM d WHERE d.user_id = u.user_id AND EXISTS (SELECT 1 FROM g WHERE g.user_id = d.user_id AND d.tick >= s AND d.tick < e)) FROM u
UNION ALL SELECT user_id, 'repeated', 0 FROM u"""


@query(f"WITH {TIMES_SQL}")
def gate_timestamps(e: DataFrame) -> DataFrame:
    tick = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000)
    g = e.where("event_type = 'error'").select("user_id", (tick - 1).alias("s"), (tick + 1).alias("e")).distinct()
    return gates.timestamps(days(e), "user_id", "tick", g, "s", "e", 8)


@query(f"""WITH m AS (SELECT *, coalesce(last_value(CASE WHEN value >= 60 THEN 1 WHEN value < 50 THEN 0 END IGNORE NULLS) OVER {OVER}, 0) AS s FROM events)
SELECT user_id, 'alarm' AS "rule", count(*) FILTER (s <> (value >= 60)::INTEGER) AS violations FROM m GROUP BY user_id""")
def gate_alarm(e: DataFrame) -> DataFrame:
    """The reported alarm has no hysteresis, the rule has."""
    return gates.alarm(e.withColumn("reported", (F.col("value") >= 60).cast("int")), "user_id", ORDER, "value", "reported", 60, 10)


@query(f"""WITH p AS (SELECT *, {US} / 1e6 - lag({US}) OVER {OVER} / 1e6 AS step, row_number() OVER {OVER} AS i, CASE WHEN event_id % 3 = 0 THEN 1 ELSE (value >= 60)::INTEGER END AS y FROM events),
m AS (SELECT *, coalesce(step > 28800, false) OR i = 1 AS anew FROM p),
s AS (SELECT *, last_value(CASE WHEN value >= 60 THEN 1 WHEN anew THEN CASE WHEN value < 40 THEN 0 ELSE y END WHEN value < 40 THEN 0 END IGNORE NULLS) OVER {OVER} AS s,
  last_value(CASE WHEN value >= 60 THEN 1 WHEN anew THEN CASE WHEN value < 40 THEN 0 ELSE y END END IGNORE NULLS) OVER {OVER} AS k FROM m)
SELECT user_id, 'alarm' AS "rule", count(*) FILTER (s <> y) AS violations FROM s GROUP BY user_id UNION ALL SELECT user_id, 'latched', count(*) FILTER (k <> y) FROM s GROUP BY user_id""")
def gate_alarm_gaps(e: DataFrame) -> DataFrame:
    """Reported alarms are set on every third event; after gaps of eight hours the latch goes on from what is reported there. With and without a clear."""
    y = F.when(F.col("event_id") % 3 == 0, 1).otherwise((F.col("value") >= 60).cast("int"))
    own = e.withColumn("reported", y).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    plain, latched = (gates.alarm(own, "user_id", ORDER, "value", "reported", 60, 20, latching=on, seconds="t", gap=28800) for on in (False, True))
    return plain.unionByName(latched.withColumn("rule", F.lit("latched")))


@query(f"""WITH {BOUNDS_SQL}, r AS (SELECT *, sum(v) OVER (PARTITION BY user_id ORDER BY tick ROWS 4 PRECEDING) / 5 + CASE WHEN (user_id + tick) % 17 = 0 THEN 300 ELSE 0 END AS y FROM b)
SELECT user_id, 'stel_exact' AS "rule", count(*) FILTER (missing = 0 AND abs(y - known / 5) > 0.005 + 1e-9) AS violations FROM r GROUP BY user_id
UNION ALL SELECT user_id, 'stel_bounded', count(*) FILTER (missing > 0 AND (y < known / 5 - 0.005 - 1e-9 OR y > (known + 500 * missing) / 5 + 0.005 + 1e-9)) FROM r GROUP BY user_id""")
def gate_stel(e: DataFrame) -> DataFrame:
    """The reported mean takes the last five rows, whatever their days, and is tampered with in places."""
    own = Series(days(e), "user_id", ["tick"]).framed(4, y=lambda w: windows.exposure_mean(F.col("v"), w, 5) + F.when((F.col("user_id") + F.col("tick")) % 17 == 0, 300.0).otherwise(0.0))
    return gates.exposure(own.rows, "user_id", "tick", "v", "y", 5, 0.0, 500.0, 0.01)


TWA_SQL = f"""{DAY_SQL}, y AS (SELECT *, coalesce(tick - lag(tick) OVER w - 1, 0) AS gap, sum(v) OVER w * 0.1 + CASE WHEN (user_id + tick) % 19 = 0 THEN 5 ELSE 0 END AS y FROM d WINDOW w AS (PARTITION BY user_id ORDER BY tick)),
s AS (SELECT *, sum((gap > 0)::INTEGER) OVER w AS seg, lag(y) OVER w AS before FROM y WINDOW w AS (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, sum(v) OVER w AS inside, first_value(y) OVER w AS y0, first_value(v) OVER w AS v0 FROM s WINDOW w AS (PARTITION BY user_id, seg ORDER BY tick))"""


@query(f"""WITH {TWA_SQL}
SELECT user_id, 'twa_segment' AS "rule", count(*) FILTER (abs(y - CASE WHEN seg = 0 THEN inside * 0.1 ELSE y0 + (inside - v0) * 0.1 END) > CASE WHEN seg = 0 THEN 0.005 ELSE 0.01 END + 1e-9) AS violations FROM f GROUP BY user_id
UNION ALL SELECT user_id, 'twa_jump', count(*) FILTER (gap > 0 AND (y - before < v * 0.1 - 0.01 - 1e-9 OR y - before > (v + 500 * gap) * 0.1 + 0.01 + 1e-9)) FROM f GROUP BY user_id""")
def gate_twa(e: DataFrame) -> DataFrame:
    own = windows.dose(Series(days(e), "user_id", ["tick"]), "y", F.col("v"), 0.1, 1)
    own = own.with_columns(y=F.col("y") + F.when((F.col("user_id") + F.col("tick")) % 19 == 0, 5.0).otherwise(0.0))
    return gates.dose(own.rows, "user_id", "tick", "v", "y", 0.1, 0.0, 500.0, 0.01)


@query(f"""WITH m AS (SELECT user_id, value >= 80 AS a, {US} // 1000000 AS t, last_value(CASE WHEN event_type = 'purchase' THEN {US} // 1000000 END IGNORE NULLS) OVER {OVER} AS l FROM events)
SELECT user_id, 'no_recent_cause' AS "rule", count(*) FILTER (a AND coalesce(t - l >= 43200, true)) AS violations FROM m GROUP BY user_id
UNION ALL SELECT user_id, 'no_cause', count(*) FILTER (a AND l IS NULL) FROM m GROUP BY user_id""")
def gate_cause(e: DataFrame) -> DataFrame:
    return gates.cause(e.withColumn("t", seconds()), "user_id", ORDER, "t", F.col("value") >= 80, F.col("event_type") == "purchase", 43200)


ROLL_SQL = """c AS (SELECT user_id, unnest(['range', 'alarm', 'gap']) AS "rule", unnest([count(*) FILTER (value > 150), count(*) FILTER (value >= 60 AND event_type = 'view'), count(*) FILTER (event_type = 'error' AND value > 100)]) AS n FROM events GROUP BY user_id)"""


def three_checks(e: DataFrame) -> DataFrame:
    v, kind = F.col("value"), F.col("event_type")
    return gates.counted(e, "user_id", range=v > 150, alarm=(v >= 60) & (kind == "view"), gap=(kind == "error") & (v > 100))


@query(f"""WITH {ROLL_SQL} SELECT user_id, bool_and(n = 0) AS passed, count(*) FILTER (n > 0) AS n_failed, coalesce(string_agg("rule", ',' ORDER BY "rule") FILTER (n > 0), '') AS failed FROM c GROUP BY user_id""")
def agg_gate_rollup(e: DataFrame) -> DataFrame:
    return gates.roll_up(three_checks(e), "user_id")


@query(f"""WITH {ROLL_SQL} SELECT (user_id % 7)::BIGINT AS row, round(avg((n = 0)::INTEGER) FILTER ("rule" = 'range'), 6) AS range, round(avg((n = 0)::INTEGER) FILTER ("rule" = 'alarm'), 6) AS alarm, round(avg((n = 0)::INTEGER) FILTER ("rule" = 'gap'), 6) AS gap FROM c GROUP BY 1""")
def agg_pass_matrix(e: DataFrame) -> DataFrame:
    names = ["range", "alarm", "gap"]
    return gates.pass_matrix(three_checks(e), F.col("user_id") % 7, "rule", names).select("row", *(six(F.col(n)).alias(n) for n in names))


# --- lookups

@query(f"""WITH s AS (SELECT user_id, {US} // 1000000 AS t, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL), q AS (SELECT event_id, user_id, {US} // 1000000 AS t FROM events WHERE event_type <> 'click'),
a AS (SELECT q.*, s.t AS ta, s.v AS va FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.t >= s.t), b AS (SELECT a.*, s.t AS tb, s.v AS vb FROM a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.t <= s.t)
SELECT event_id, CASE WHEN ta IS NULL OR tb - t < t - ta THEN vb ELSE va END AS value, coalesce(va, vb) AS held FROM b""")
def join_nearest(e: DataFrame) -> DataFrame:
    own = e.withColumn("t", seconds())
    samples = own.where("event_type = 'click'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    q = own.where("event_type <> 'click'").select("event_id", "user_id", "t")
    near = lookups.nearest(q, samples, "user_id", "t", "value")
    return lookups.as_of(near, samples.withColumnRenamed("value", "held"), "user_id", "t", "held", clip=True).select("event_id", "value", "held")


@query(f"""WITH a AS (SELECT user_id, round_even({US} / 1e6 / 3600, 0)::BIGINT AS tick, max(value) AS v FROM events GROUP BY ALL)
SELECT x.user_id AS a, y.user_id AS b, count(*) AS n, round(avg(((x.v > 30) = (y.v > 30))::INTEGER), 6) AS agree FROM a x JOIN a y ON x.tick = y.tick AND x.user_id < y.user_id AND x.user_id % 10 = y.user_id % 10 GROUP BY ALL""")
def sensor_pairs(e: DataFrame) -> DataFrame:
    """Pairs of devices of one group that report in the same hour, and how often both or neither are active."""
    tick = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 / 3600).cast("long")
    own = e.groupBy("user_id", tick.alias("tick")).agg((F.max("value") > 30).alias("active")).withColumn("g", F.col("user_id") % 10)
    return agreement.agreement(own, "g", "user_id", "tick", "active").withColumn("agree", six(F.col("agree")))


@query("""WITH s AS (SELECT event_type AS a, epoch_us(ts) // 3600000000 AS tick, avg(value) AS v FROM events GROUP BY ALL), n AS (SELECT min(tick) AS t0, max(tick) - min(tick) + 1 AS n FROM s),
x AS (SELECT a, tick - t0 AS i, n, v - avg(v) OVER (PARTITION BY a) AS x FROM s, n), q AS (SELECT a, sum(x * x) AS q FROM x GROUP BY a),
y AS (SELECT a AS b, (i + lag + n) % n AS i, x AS y, lag FROM x, (SELECT unnest(range(-6, 7)) AS lag)),
c AS (SELECT a, b, lag, sum(x * y) AS s FROM x JOIN y USING (i) WHERE a < b GROUP BY ALL), r AS (SELECT c.a, c.b, lag, round(s / coalesce(nullif(sqrt(qa.q * qb.q), 0), 1), 9) AS r FROM c JOIN q qa ON qa.a = c.a JOIN q qb ON qb.a = c.b)
SELECT a, b, lag::INTEGER AS lag, round(r, 6) AS r FROM r QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY r DESC, lag) = 1""")
def agg_cross_lags(e: DataFrame) -> DataFrame:
    """Kinds of event as sensors with hourly means: the shift of up to six hours at which two of them go together best."""
    tick = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000)
    hourly = e.groupBy("event_type", tick.alias("tick")).agg(F.avg("value").alias("v"))
    return statistics.cross_lags(hourly, "event_type", "tick", "v", 6).withColumn("r", six(F.col("r")))


# --- statistics

SIMILARITY_SQL = """WITH s AS (SELECT *, {side} AS side, value - lag(value) OVER (PARTITION BY event_type, {side} ORDER BY ts, event_id) AS step FROM events),
sp AS (SELECT event_type, max(value) FILTER (side = 0) - min(value) FILTER (side = 0) AS r, max(step) FILTER (side = 0) - min(step) FILTER (side = 0) AS sr, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS n FROM s GROUP BY 1),
long AS (SELECT event_type, side, 'v' AS kind, value AS x FROM s UNION ALL SELECT event_type, side, 'k', round(value, 4) FROM s UNION ALL SELECT event_type, side, 's', step FROM s WHERE step IS NOT NULL),
c AS (SELECT event_type, kind, x, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM long GROUP BY ALL),
g AS (SELECT event_type, kind, abs(sum(n0) OVER w / sum(n0) OVER p - sum(n1) OVER w / sum(n1) OVER p) AS gap, lead(x) OVER (PARTITION BY event_type, kind ORDER BY x) - x AS width FROM c WINDOW w AS (PARTITION BY event_type, kind ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY event_type, kind)),
d AS (SELECT event_type, sum(gap * width) FILTER (kind = 'v') AS wv, max(gap) FILTER (kind = 'k') AS ks, sum(gap * width) FILTER (kind = 's') AS ws FROM g GROUP BY 1),
o AS (SELECT event_type, side, row_number() OVER (PARTITION BY event_type, side ORDER BY ts, event_id) AS i, value - avg(value) OVER (PARTITION BY event_type, side) AS x, var_pop(value) OVER (PARTITION BY event_type, side) AS v, count(*) OVER (PARTITION BY event_type, side) AS n FROM s),
a AS (SELECT l.event_type, l.side, r.i - l.i AS lag, sum(l.x * r.x) / (any_value(l.v) * any_value(l.n)) AS acf FROM o l JOIN o r ON l.event_type = r.event_type AND l.side = r.side AND r.i - l.i BETWEEN 0 AND 10 GROUP BY ALL),
ad AS (SELECT event_type, avg(abs(e)) AS acf_diff, avg(e * e) AS acf_mse FROM (SELECT event_type, lag, max(acf) FILTER (side = 0) - max(acf) FILTER (side = 1) AS e FROM a GROUP BY ALL) GROUP BY 1)
SELECT event_type, round(wv / r, 5) AS w_value, round(ks, 6) AS ks, round(least(1, greatest(0, CASE WHEN ks = 0 THEN 1 ELSE list_sum(list_transform(range(1, 400), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2 * k * k * ks * ks * n / 2.0))) END)), 6) AS ks_p, round(1.36 * sqrt(2.0 / n), 6) AS ks_critical, round(ws / sr, 5) AS w_step, round(acf_diff, 5) AS acf_diff, round(acf_mse, 6) AS acf_mse, CASE WHEN ks < 0.02 THEN 'GOOD' WHEN ks < 0.1 THEN 'OK' ELSE 'POOR' END AS verdict
FROM sp JOIN d USING (event_type) JOIN ad USING (event_type)"""


@query(SIMILARITY_SQL.replace("{side}", "user_id % 2"))
def agg_similarity_row(e: DataFrame) -> DataFrame:
    return similar(e, F.col("user_id") % 2)


def similar(e: DataFrame, side: Column) -> DataFrame:
    s = statistics.similarity(e.withColumn("side", side), "event_type", "value", "side", ORDER)
    return s.select("event_type", F.round("w_value", 5).alias("w_value"), six(F.col("ks")).alias("ks"), six(F.col("ks_p")).alias("ks_p"), six(F.col("ks_critical")).alias("ks_critical"), F.round("w_step", 5).alias("w_step"), F.round("acf_diff", 5).alias("acf_diff"), six(F.col("acf_mse")).alias("acf_mse"), statistics.verdict(F.col("ks"), 0.02, 0.1).alias("verdict"))


@query(SIMILARITY_SQL.replace("{side}", "(epoch_us(ts) // 600000000) % 2"))
def floor_by_blocks(e: DataFrame) -> DataFrame:
    """What similarity real data has to itself: odd against even blocks of ten minutes."""
    return similar(e, F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600000000) % 2)


@query(SIMILARITY_SQL.replace("{side}", "(('0x' || substr(md5('3/split/' || event_id), 1, 8))::BIGINT % 2)"))
def floor_by_chance(e: DataFrame) -> DataFrame:
    """The same for a seeded random half of the rows against the others."""
    return similar(e, F.conv(F.substring(F.md5(F.concat(F.lit("3/split/"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("long") % 2)


@query("""WITH b AS (SELECT epoch_us(ts) // 86400000000 AS day, sum(value) AS s, count(*) AS n FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS k FROM b),
d AS (SELECT rep, (('0x' || substr(md5('5/boot/' || rep || '/' || i), 1, 8))::BIGINT) % k AS j FROM o, (SELECT unnest(range(1, 201)) AS rep)),
m AS (SELECT rep, sum(s) / sum(n) AS m FROM d JOIN o ON d.j = o.i GROUP BY rep)
SELECT count(*) AS reps, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM m""")
def agg_block_bootstrap(e: DataFrame) -> DataFrame:
    """Mean and its deviation over 200 draws of as many days, with replacement. What is drawn are the days' sums."""
    b = e.groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).alias("day")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    o = b.select("s", "n", (F.row_number().over(Window.orderBy("day")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("k"))  # one row a day
    draw = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit("5/boot"), F.col("rep").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("k")
    d = o.select("i", "k", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("rep")).select("rep", draw.alias("j"))
    m = d.join(o, F.col("j") == F.col("i")).groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("m"))
    return m.agg(F.count(F.lit(1)).alias("reps"), six(F.avg("m")).alias("mean"), six(F.stddev_samp("m")).alias("sd"))


@query(f"""WITH {Q_SQL}, g AS (SELECT user_id, 2 * (qx * qz - qw * qy) AS x, 2 * (qy * qz + qw * qx) AS y, 1 - 2 * (qx * qx + qy * qy) AS z FROM q),
m AS (SELECT user_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM g GROUP BY 1), u AS (SELECT user_id, mx / s AS mx, my / s AS my, mz / s AS mz FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS s FROM m))
SELECT user_id, round(mx, 5) AS x, round(mz, 5) AS z, round(sqrt(avg(pow(degrees(acos(greatest(-1, least(1, x * mx + y * my + z * mz)))), 2))), 3) AS spread FROM g JOIN u USING (user_id) GROUP BY user_id, mx, my, mz""")
def direction_spread(e: DataFrame) -> DataFrame:
    g = oriented(e).select("user_id", rotation.gravity(F.col("q")).alias("g"))
    return motion.mean_direction(g, "user_id", "g").select("user_id", F.round("x", 5).alias("x"), F.round("z", 5).alias("z"), F.round("spread", 3).alias("spread"))


@query(f"""WITH p AS (SELECT event_type, value AS y, lag(value) OVER {OVER} AS x, (event_type = lag(event_type) OVER {OVER})::INTEGER AS same, user_id FROM events)
SELECT user_id, CASE WHEN count(x) >= 10 THEN round(corr(x, y), 5) END AS r, round(avg(same), 6) AS sticky FROM p GROUP BY user_id""")
def agg_sticky(e: DataFrame) -> DataFrame:
    p = log(e).framed(1, x=lambda w: F.lag("value").over(w), same=lambda w: (F.col("event_type") == F.lag("event_type").over(w)).cast("int")).rows.withColumn("y", F.col("value"))
    return p.groupBy("user_id").agg(F.round(statistics.correlation("x", "y"), 5).alias("r"), six(F.avg("same")).alias("sticky"))


@query("""WITH b AS (SELECT event_type, value, min(value) OVER p AS lo, (max(value) OVER p - min(value) OVER p) / 30 AS w FROM events WINDOW p AS (PARTITION BY event_type)),
c AS (SELECT event_type, lo, w, least(floor((value - lo) / w), 29)::INTEGER AS bin, count(*) AS n FROM b GROUP BY ALL)
SELECT event_type, bin, n, round(lo + (bin + 0.5) * w, 6) AS middle FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bin) = 1""")
def agg_mode_bin(e: DataFrame) -> DataFrame:
    return statistics.mode_bin(e, "event_type", "value").withColumn("middle", six(F.col("middle")))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, list_transform(range(10, 90, 2), lambda p: p / 100.0)) AS ts FROM events GROUP BY 1),
t AS (SELECT event_type, unnest(range(10, 90, 2)) AS p, unnest(ts) AS t FROM q),
w AS (SELECT t.event_type, p, t, count(*) FILTER (value <= t) * var_pop(value) FILTER (value <= t) + count(*) FILTER (value > t) * var_pop(value) FILTER (value > t) AS within, avg(value) FILTER (value <= t) AS low, avg(value) FILTER (value > t) AS high
  FROM t JOIN events e ON e.event_type = t.event_type GROUP BY ALL HAVING count(*) FILTER (value <= t) >= 10 AND count(*) FILTER (value > t) >= 10)
SELECT event_type, p::INTEGER AS percentile, round(t, 6) AS threshold, round(low, 5) AS low_mean, round(high, 5) AS high_mean FROM w QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY within, p) = 1""")
def agg_otsu(e: DataFrame) -> DataFrame:
    return statistics.otsu(e, "event_type", "value").select("event_type", "percentile", six(F.col("threshold")).alias("threshold"), F.round("low_mean", 5).alias("low_mean"), F.round("high_mean", 5).alias("high_mean"))


@query(f"""WITH r AS (SELECT event_type, user_id, value, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER {OVER} THEN 1 ELSE 0 END AS c FROM events)),
s AS (SELECT event_type, user_id, run, avg(value) AS m, var_pop(value) AS v, count(*) AS n FROM r GROUP BY ALL)
SELECT event_type, count(*) AS segments, round(sum(m * n) / sum(n), 6) AS mean, round(avg(v), 4) AS within, round(var_pop(m), 4) AS "between" FROM s GROUP BY event_type""")
def fit_by_label(e: DataFrame) -> DataFrame:
    """Per label: its segments, mean, and the variance within and between segments."""
    own = windows.run_id(log(e), "run", "event_type").rows
    s = own.groupBy("event_type", "user_id", "run").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return s.groupBy("event_type").agg(F.count(F.lit(1)).alias("segments"), six(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean"), F.round(F.avg("v"), 4).alias("within"), F.round(F.var_pop("m"), 4).alias("between"))


@query(f"""SELECT user_id, ({US} // 86400000000)::BIGINT AS day, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 5) AS sd, round(quantile_cont(value, 0.05), 6) AS p5, round(median(value), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY ALL HAVING count(*) >= 3""")
def win_tumbling_features(e: DataFrame) -> DataFrame:
    """Features of a device's days that have three rows or more: a group is one day's rows."""
    day, v = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000), F.col("value")
    q = F.percentile(v, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    g = e.groupBy("user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"), six(F.avg(v)).alias("mean"), F.round(F.stddev_pop(v), 5).alias("sd"), q.alias("q")).where("n >= 3")
    return g.select("user_id", "day", "n", "mean", "sd", *(six(F.col("q")[i]).alias(n) for i, n in enumerate(("p5", "p50", "p95"))))


# --- selections and sets

@query(f"""WITH p AS (SELECT *, ({US} // 600000000) % 2 AS half, ('0x' || substr(md5('3/split/' || event_id), 1, 8))::BIGINT AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events)
SELECT event_id, half::BIGINT AS half, (u < 2147483648) AS chosen, (i % 4 = 1) AS strided, coalesce(value > high, true) AS record FROM p WHERE epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-05') AND epoch_us(ts) < epoch_us(TIMESTAMP '2024-01-20')""")
def splits_and_strides(e: DataFrame) -> DataFrame:
    """A span of time: odd and even blocks of ten minutes, a seeded half, every fourth row, rows above all before."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("3/split/"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("long")
    own = log(e).running(i=sliced.number(), high=sliced.highest(F.col("value"))).framed(1, before=lambda w: F.lag("high").over(w)).rows.where("ts >= '2024-01-05' AND ts < '2024-01-20'")
    return own.select("event_id", (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600000000) % 2).alias("half"), (u < 2147483648).alias("chosen"), (F.col("i") % 4 == 1).alias("strided"), F.coalesce(F.col("value") > F.col("before"), F.lit(True)).alias("record"))


@query("""SELECT user_id, event_id, value, k::INTEGER AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 40), event_id) AS k FROM events) WHERE k <= 3""")
def topk_nearest(e: DataFrame) -> DataFrame:
    """The three readings of each device nearest to 40."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.abs(F.col("value") - 40), "event_id"))
    return e.select("user_id", "event_id", "value", k.alias("k")).where("k <= 3")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 60), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 60)
SELECT user_id, 'both' AS part FROM (FROM a INTERSECT FROM b) UNION ALL SELECT user_id, 'first' FROM (FROM a EXCEPT FROM b) UNION ALL SELECT user_id, 'second' FROM (FROM b EXCEPT FROM a)""")
def set_parts(e: DataFrame) -> DataFrame:
    a, b = (e.where((F.col("event_type") == k) & (F.col("value") > 60)).select("user_id").distinct() for k in ("purchase", "signup"))
    parts = [(a.intersect(b), "both"), (a.subtract(b), "first"), (b.subtract(a), "second")]
    x, y, z = (df.select("user_id", F.lit(n).alias("part")) for df, n in parts)
    return x.unionByName(y).unionByName(z)


@query("""SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time_utc, round_even(value, 1) AS reading, round_even(value, 0)::INTEGER AS whole, upper(event_type) || ' ' || user_id AS label FROM events""")
def output_log(e: DataFrame) -> DataFrame:
    """Columns in order, under outside names, with fixed decimals."""
    return e.select(F.col("event_id").alias("id"), text.iso_utc(F.col("ts")).alias("time_utc"), F.bround("value", 1).alias("reading"), F.bround("value", 0).cast("int").alias("whole"), F.concat(F.upper("event_type"), F.lit(" "), F.col("user_id").cast("string")).alias("label"))


def orientation_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientations of devices whose accelerometer sees gravity tilted by the reading and whose gyroscope reads it too. No SQL: each row's state feeds the next."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    a = F.radians("value")
    own = e.select("user_id", "event_id", F.sin(a).alias("ax"), F.lit(0.0).alias("ay"), F.cos(a).alias("az"), F.lit(0.0).alias("gx"), F.col("value").alias("gy"), F.lit(0.0).alias("gz"))
    q = motion.orientations(own, "user_id", "event_id", ["ax", "ay", "az"], ["gx", "gy", "gz"])
    return q.select("user_id", "event_id", *(six(F.col(c)).alias(c) for c in "wxyz"))


@query(f"""WITH RECURSIVE a AS (SELECT event_id, user_id, ts, (1 + CASE WHEN value >= 80 THEN 1.5 ELSE 0 END) * sin(radians(value)) AS x, (1 + CASE WHEN value >= 80 THEN 1.5 ELSE 0 END) * cos(radians(value)) AS z FROM events),
m AS (SELECT *, row_number() OVER w AS i, avg(x) OVER f AS gx, avg(z) OVER f AS gz FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 1 PRECEDING)),
u AS (SELECT user_id, avg(x) AS ux, avg(z) AS uz FROM m WHERE i <= 5 GROUP BY 1),
t AS (SELECT m.*, sqrt(x * x + z * z) >= 2 AS spike, degrees(acos(greatest(-1, least(1, (gx * ux + gz * uz) / greatest(sqrt(gx * gx + gz * gz), 1e-9) / sqrt(ux * ux + uz * uz))))) AS tilt FROM m JOIN u USING (user_id)),
d AS (SELECT s.user_id, s.i AS sp, min(r.i) AS down FROM t s JOIN t r ON s.user_id = r.user_id AND r.i >= s.i AND r.i < s.i + 4 AND r.tilt >= 40 WHERE s.spike GROUP BY ALL),
n AS (SELECT d.user_id, sp, down, min(r.i) AS up FROM d LEFT JOIN t r ON r.user_id = d.user_id AND r.i >= down AND r.tilt < 20 GROUP BY ALL),
o AS (SELECT n.*, (SELECT min(sp) FROM n k WHERE k.user_id = n.user_id AND k.sp >= n.up) AS next FROM n),
c AS (SELECT user_id, min(sp) AS sp FROM o GROUP BY 1 UNION ALL SELECT o.user_id, o.next FROM c JOIN o USING (user_id, sp) WHERE o.next IS NOT NULL),
f AS (SELECT o.* FROM o JOIN c USING (user_id, sp))
SELECT t.event_id, coalesce(max(CASE WHEN t.i < f.down + 2 THEN 'pre_alarm' ELSE 'alert' END) FILTER (f.down IS NOT NULL), 'ok') AS state FROM t LEFT JOIN f ON f.user_id = t.user_id AND t.i >= f.down AND (f.up IS NULL OR t.i < f.up) GROUP BY t.event_id""")
def fall_alarms(e: DataFrame) -> DataFrame:
    """Falls of devices whose acceleration is tilted by the reading, and larger from 80 on: a spike, then a tilt of 40 degrees against the first five rows, until upright."""
    size, angle = F.when(F.col("value") >= 80, 2.5).otherwise(1.0), F.radians("value")
    own = e.select("event_id", "user_id", "ts", rotation.vector(size * F.sin(angle), F.lit(0.0), size * F.cos(angle)).alias("a"))
    return motion.spike_then_still(own, "user_id", ORDER, "a", 2.0, 40.0, 4, 2, 5, 2).select("event_id", "state")


QUERIES |= {"orientation_fusion": orientation_fusion}
