"""Registered queries over whole recordings: copies, physical checks, periods, cycles, rhythm, fits of orientations. Same table and roles as in catalog.py.

Hourly sums of a kind of event serve as series on a grid (0 where there is no event), even devices as a reference and odd ones as what is compared with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rotation
from tidemark.operators import attitude, copies, forecast, periods, physical, rhythm, statistics, twosample
from tidemark.plans.catalog import ORDER, QUERIES, query, six
from tidemark.plans.sensors import Q_SQL, US, oriented

HOUR = 3_600_000_000


def hours(e: DataFrame) -> DataFrame:
    """(event_type, side, i, s, n): every hour from the first to the last of all, for each kind of event and side of the devices."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / HOUR)
    own = e.groupBy("event_type", (F.col("user_id") % 2).alias("side"), hour.alias("hour")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    ends = e.agg(F.min(hour).alias("_a"), F.max(hour).alias("_b"))  # one row
    days = e.select("event_type").distinct().join(F.broadcast(ends)).select("event_type", "_a", F.explode(F.sequence("_a", "_b")).alias("hour"))
    grid = days.select("event_type", "hour", (F.col("hour") - F.col("_a")).alias("i"), F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")).alias("side"))
    return grid.join(own, ["event_type", "side", "hour"], "left").select("event_type", "side", "i", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("n", F.lit(0.0)).alias("n"))


HOURS_SQL = f"""ends AS (SELECT min({US} // {HOUR}) AS a, max({US} // {HOUR}) AS b FROM events),
grid AS (SELECT event_type, side, unnest(range(0, b - a + 1)) AS i, a FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest([0, 1]) AS side), ends),
g AS (SELECT grid.event_type, grid.side, i, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM grid LEFT JOIN
  (SELECT event_type, user_id % 2 AS side, {US} // {HOUR} AS hour, sum(value) AS s, count(*)::DOUBLE AS n FROM events GROUP BY ALL) h ON h.event_type = grid.event_type AND h.side = grid.side AND h.hour = grid.a + grid.i)"""


def hourly_pairs(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reference and what is compared with it: of views, five days from the sixth on are the reference's of 50 hours before."""
    g = hours(e)
    ref = g.where("side = 0").drop("side")
    old = ref.where("event_type = 'view'").select("event_type", (F.col("i") + 50).alias("i"), F.col("s").alias("_s"), F.col("n").alias("_n")).where("i between 120 and 239")
    own = g.where("side = 1").join(old, ["event_type", "i"], "left").select("event_type", "i", F.coalesce("_s", "s").alias("s"), F.coalesce("_n", "n").alias("n"))
    return own, ref


COPY_SQL = f"""WITH {HOURS_SQL}, ref AS (SELECT event_type, i, s, n FROM g WHERE side = 0),
raw AS (SELECT o.event_type, o.i, coalesce(r.s, o.s) AS s, coalesce(r.n, o.n) AS n FROM g o LEFT JOIN ref r ON o.event_type = 'view' AND r.event_type = 'view' AND o.i = r.i + 50 AND o.i BETWEEN 120 AND 239 WHERE o.side = 1),
m AS (SELECT event_type, avg(s) AS ms, avg(n) AS mn, CASE WHEN stddev_pop(s) > 1e-9 THEN stddev_pop(s) ELSE 1 END AS ds, CASE WHEN stddev_pop(n) > 1e-9 THEN stddev_pop(n) ELSE 1 END AS dn FROM ref GROUP BY 1),
x AS (SELECT event_type, i, (s - ms) / ds AS s, (n - mn) / dn AS n FROM ref JOIN m USING (event_type)), z AS (SELECT event_type, i, (s - ms) / ds AS s, (n - mn) / dn AS n FROM raw JOIN m USING (event_type)),
w AS (SELECT event_type, i // 24 AS win, i % 24 AS j, s - avg(s) OVER p AS s, n - avg(n) OVER p AS n, count(*) OVER p AS size FROM z WINDOW p AS (PARTITION BY event_type, i // 24)),
own AS (SELECT event_type, win, sum(s * s + n * n) AS p FROM w WHERE size = 24 GROUP BY ALL),
o AS (SELECT x.event_type, x.i - k AS o, sum(s * s) - sum(s) * sum(s) / 24 + sum(n * n) - sum(n) * sum(n) / 24 AS p FROM x, (SELECT unnest(range(24)) AS k) WHERE x.i >= k GROUP BY ALL HAVING count(*) = 24),
met AS (SELECT w.event_type, win, x.i - w.j AS o, sum(w.s * x.s + w.n * x.n) AS num FROM w JOIN x ON w.event_type = x.event_type AND x.i >= w.j WHERE size = 24 GROUP BY ALL),
best AS (SELECT own.event_type, own.win, max(CASE WHEN own.p > 1e-12 AND o.p > 1e-12 THEN num / sqrt(own.p * o.p) END) AS r FROM own JOIN met USING (event_type, win) JOIN o USING (event_type, o) GROUP BY ALL)"""


@query(f"""{COPY_SQL} SELECT event_type, win::BIGINT AS day, round(r, 6) AS r FROM best""")
def copy_windows(e: DataFrame) -> DataFrame:
    """The largest correlation of each day of the odd devices with any 24 hours of the even ones, sums and counts together."""
    own, ref = hourly_pairs(e)
    scaled = [copies.standardised(df, ref, "event_type", ["s", "n"]) for df in (own, ref)]
    found = copies.largest_correlations(*scaled, "event_type", "i", ["s", "n"], 24, block=256, batch=16)
    return found.select("event_type", F.col("window").alias("day"), six(F.col("r")).alias("r"))


@query(f"""{COPY_SQL} SELECT event_type, count(r) AS windows, count(*) FILTER (r > 0.99) AS copied, round(100 * count(*) FILTER (r > 0.99) / count(r), 6) AS percent, coalesce(100 * count(*) FILTER (r > 0.99) / count(r) <= 5, false) AS passed FROM best GROUP BY 1""")
def gate_copy(e: DataFrame) -> DataFrame:
    """No more than 5 % of windows copied."""
    own, ref = hourly_pairs(e)
    scaled = [copies.standardised(df, ref, "event_type", ["s", "n"]) for df in (own, ref)]
    found = copies.copied(copies.largest_correlations(*scaled, "event_type", "i", ["s", "n"], 24, block=256, batch=16), "event_type")
    return found.select("event_type", "windows", "copied", six(F.col("percent")).alias("percent"), F.coalesce(F.col("percent") <= 5, F.lit(False)).alias("passed"))


MOTION_SQL = f"""{Q_SQL}, k AS (SELECT event_id % 2 AS side, event_type, ts, event_id, t / 3600 AS t, qw, qx, qy, qz FROM q JOIN (SELECT event_id, event_type FROM events) USING (event_id)),
d AS (SELECT *, t - lag(t) OVER w AS dt, degrees(2 * acos(least(1, abs(qw * lag(qw) OVER w + qx * lag(qx) OVER w + qy * lag(qy) OVER w + qz * lag(qz) OVER w)))) AS a,
  (abs(qx - lag(qx) OVER w) > 0.3 OR abs(qy - lag(qy) OVER w) > 0.3 OR abs(qz - lag(qz) OVER w) > 0.3) AND NOT (abs(qx + lag(qx) OVER w) < 0.1 AND abs(qy + lag(qy) OVER w) < 0.1 AND abs(qz + lag(qz) OVER w) < 0.1) AS jump
  FROM k WINDOW w AS (PARTITION BY side, event_type ORDER BY ts, event_id)),
u AS (SELECT side, event_type, median(dt) AS usual FROM d WHERE dt > 0 GROUP BY ALL),
r AS (SELECT d.*, coalesce(dt > 0 AND dt <= 2 * usual, false) AS regular FROM d JOIN u USING (side, event_type)),
f AS (SELECT side, event_type, quantile_cont(a / dt, 0.99) AS p99 FROM r WHERE regular GROUP BY ALL),
j AS (SELECT event_type, count(*) FILTER (jump AND regular) AS jumps, count(*) FILTER (jump AND NOT regular AND a / greatest(dt, 1e-3) > f.p99 * 1.25) AS gap_jumps FROM r JOIN (SELECT event_type, p99 FROM f WHERE side = 0) f USING (event_type) WHERE r.side = 1 GROUP BY 1)"""


@query(f"""WITH {MOTION_SQL}
SELECT event_type, 'jumps' AS "rule", jumps::DOUBLE AS value, jumps = 0 AS passed FROM j UNION ALL SELECT event_type, 'gap_jumps', gap_jumps, gap_jumps = 0 FROM j
UNION ALL SELECT event_type, 'validity', 0, true FROM j
UNION ALL SELECT o.event_type, 'rate', round(o.p99, 4), o.p99 BETWEEN p.p99 * 0.75 AND p.p99 * 1.25 FROM f o JOIN f p ON o.event_type = p.event_type AND o.side = 1 AND p.side = 0""")
def gate_motion(e: DataFrame) -> DataFrame:
    """Orientations of odd events against those of even ones, by kind: steps, jumps, and turning rates (an hour counts as a second)."""
    own = oriented(e).join(e.select("event_id", "event_type"), "event_id").withColumn("t", F.col("t") / 3600).withColumn("a", rotation.gravity(F.col("q")))
    found = physical.gate(own.where("event_id % 2 = 1"), own.where("event_id % 2 = 0"), "event_type", ORDER, "t", "q", "a")
    return found.where("rule <> 'gravity'").select("event_type", "rule", F.round("value", 4).alias("value"), "passed")


DAYLIGHT_SQL = f"""ends AS (SELECT min({US} // {HOUR}) AS a, max({US} // {HOUR}) AS b FROM events), grid AS (SELECT k, unnest(range(0, b - a + 1)) AS i, a FROM (SELECT DISTINCT user_id % 3 AS k FROM events), ends),
s AS (SELECT grid.k, i, coalesce(v, 0) AS v FROM grid LEFT JOIN (SELECT user_id % 3 AS k, {US} // {HOUR} AS hour, sum(value * greatest(0, cos(2 * pi() * ({US} // {HOUR}) / 24))) AS v FROM events GROUP BY ALL) h ON h.k = grid.k AND h.hour = a + i),
c AS (SELECT k, i, v - avg(v) OVER (PARTITION BY k) AS x FROM s), n AS (SELECT k, sum(x * x) AS n FROM c GROUP BY k),
r AS (SELECT l.k, r.i - l.i AS lag, round(sum(l.x * r.x) / any_value(n.n), 12) AS r FROM c l JOIN c r ON l.k = r.k AND r.i - l.i BETWEEN 10 AND 59 JOIN n ON n.k = l.k GROUP BY ALL),
p AS (SELECT *, r > lag(r) OVER w AND r > lead(r) OVER w AND r >= 0.2 AS peak FROM r WINDOW w AS (PARTITION BY k ORDER BY lag))"""


@query(f"""WITH {DAYLIGHT_SQL} SELECT k::BIGINT AS k, min(lag) FILTER (peak)::DOUBLE AS period FROM p GROUP BY k""")
def agg_period(e: DataFrame) -> DataFrame:
    """The period of hourly sums, weighted by the hour of the day, of three groups of devices: the first peak of the autocorrelation between 10 and 60 hours."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / HOUR)
    weight = F.greatest(F.lit(0.0), F.cos(2 * F.pi() * hour / 24))
    own = e.groupBy((F.col("user_id") % 3).alias("k"), hour.alias("hour")).agg(F.sum(F.col("value") * weight).alias("v"))
    ends = e.agg(F.min(hour).alias("_a"), F.max(hour).alias("_b"))  # one row
    grid = e.select((F.col("user_id") % 3).alias("k")).distinct().join(F.broadcast(ends)).select("k", "_a", F.explode(F.sequence("_a", "_b")).alias("hour"))
    s = grid.join(own, ["k", "hour"], "left").select("k", (F.col("hour") - F.col("_a")).alias("i"), F.coalesce("v", F.lit(0.0)).alias("v"))
    return periods.period(s, "k", "i", "v", 1.0, low=10, high=60, height=0.2, span=1e9, block=256)


@query(f"""WITH RECURSIVE p AS (SELECT event_type, event_id, ts, {US} / 3600000000.0::DOUBLE AS t, value < 45 AS q FROM events),
c AS (SELECT *, CASE WHEN q IS DISTINCT FROM lag(q) OVER w THEN 1 ELSE 0 END AS c FROM p WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
q AS (SELECT event_type, run, (min(t) + max(t)) / 2 AS mid, max(t) - min(t) AS size FROM r WHERE q GROUP BY ALL HAVING max(t) - min(t) >= 1),
s AS (SELECT event_type, min(t) AS t0 FROM p GROUP BY 1),
n AS (SELECT a.event_type, a.run, arg_max(b.run, (b.size, -b.mid)) FILTER (b.mid > a.mid + 0.7 * 24 AND b.mid < a.mid + 1.3 * 24) AS near, arg_min(b.run, b.mid) FILTER (b.mid > a.mid + 1.3 * 24) AS late FROM q a JOIN q b USING (event_type) GROUP BY ALL),
f AS (SELECT event_type, coalesce(arg_max(run, (size, -mid)) FILTER (mid < t0 + 24), arg_min(run, mid)) AS run FROM q JOIN s USING (event_type) GROUP BY 1),
chain AS (SELECT event_type, run FROM f UNION ALL SELECT n.event_type, coalesce(n.near, n.late) FROM chain JOIN n USING (event_type, run) WHERE coalesce(n.near, n.late) IS NOT NULL)
SELECT chain.event_type, round(a.mid, 6) AS from_h, round(b.mid, 6) AS to_h FROM chain JOIN n USING (event_type, run) JOIN q a ON a.event_type = chain.event_type AND a.run = chain.run JOIN q b ON b.event_type = chain.event_type AND b.run = n.near""")
def cycle_cuts(e: DataFrame) -> DataFrame:
    """Cycles of about a day, in hours, between quiet runs of the readings of each kind of event."""
    own = e.select("event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0).alias("t"), (F.col("value") < 45).alias("q"))
    day = e.select("event_type").distinct().withColumn("period", F.lit(24.0))
    return periods.cycles(own, "event_type", ["t", "event_id"], "q", day).select("event_type", six(F.col("start")).alias("from_h"), six(F.col("end")).alias("to_h"))


PHASE_SQL = f"""p AS (SELECT event_type AS k, event_id, {US} // 1000000 AS t, CASE WHEN count(value) OVER w = 8 THEN stddev_samp(value) OVER w END AS noise FROM events WINDOW w AS (PARTITION BY event_type ORDER BY {US} // 1000000, event_id ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)),
ts AS (SELECT k, unnest(range(10, 90, 2)) AS pct, unnest(quantile_cont(noise, list_transform(range(10, 90, 2), lambda x: x / 100.0))) AS cut FROM p WHERE noise IS NOT NULL GROUP BY k HAVING count(*) >= 100),
v AS (SELECT ts.k, pct, cut, count(*) FILTER (noise <= cut) * var_pop(noise) FILTER (noise <= cut) + count(*) FILTER (noise > cut) * var_pop(noise) FILTER (noise > cut) AS within FROM ts JOIN p ON p.k = ts.k AND noise IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (noise <= cut) >= 10 AND count(*) FILTER (noise > cut) >= 10),
b AS (SELECT k, cut FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY within, pct) = 1),
o AS (SELECT p.*, avg(CASE WHEN noise > cut THEN 1.0 WHEN noise IS NOT NULL THEN 0.0 END) OVER (PARTITION BY p.k ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS share FROM p JOIN b ON b.k = p.k),
st AS (SELECT *, CASE WHEN share IS NULL THEN 'unknown' WHEN share > 0.5 THEN 'on' ELSE 'off' END AS state FROM o),
l AS (SELECT *, lag(t) OVER w AS before, lag(state) OVER w AS was FROM st WINDOW w AS (PARTITION BY k ORDER BY t, event_id)),
ev AS (SELECT k, before AS start, 1 AS after, 'off' AS state FROM l WHERE t - before > 7200 UNION ALL SELECT k, t, 0, state FROM l WHERE before IS NULL OR t - before > 7200 OR state <> was),
ch AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY k ORDER BY start, after) THEN 1 ELSE 0 END AS c FROM ev),
rn AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY start, after ROWS UNBOUNDED PRECEDING) AS run FROM ch),
g AS (SELECT k, run, min(start) AS start, any_value(state) AS state FROM rn GROUP BY ALL),
e AS (SELECT k, max(t) AS last FROM p GROUP BY k),
d AS (SELECT g.k, state, start, coalesce(lead(start) OVER (PARTITION BY g.k ORDER BY run), last) - start AS seconds FROM g JOIN e ON e.k = g.k)"""


@query(f"WITH {PHASE_SQL} SELECT k AS event_type, state, start::BIGINT AS start, seconds::BIGINT AS seconds FROM d WHERE seconds > 1800")
def phase_durations(e: DataFrame) -> DataFrame:
    """On and off phases of the readings of each kind of event, longer than half an hour; a gap of two hours is an off phase."""
    own = e.select("event_type", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), "value")
    found = rhythm.phases(own, "event_type", ["t", "event_id"], "value", 8, 9)
    return rhythm.durations(found, "event_type", "t", "state", gap=7200, least=1800, also=["event_id"])


@query(f"""WITH p AS (SELECT event_id, user_id, {US} // 1000000 AS t, value < 50 AS off FROM events),
c AS (SELECT *, sum(CASE WHEN off THEN 0 ELSE 1 END) OVER w AS run, lead(off) OVER o IS NULL AS final FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT *, min(t) FILTER (off) OVER g AS a, max(t) FILTER (off) OVER g AS b, max(run) OVER (PARTITION BY user_id) > run AS later FROM c WINDOW g AS (PARTITION BY user_id, run))
SELECT event_id FROM r WHERE NOT off OR t - a < 43200 OR (later AND b - t < 43200)""")
def filter_gated(e: DataFrame) -> DataFrame:
    """What a log keeps that is only written around readings of 50 and more: half a day of lead and tail."""
    own = e.select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), (F.col("value") < 50).alias("off"))
    return rhythm.gated(own, "user_id", ["t", "event_id"], "off", 43200, 43200).select("event_id")


@query("""WITH s AS (SELECT event_type, user_id % 2 AS side, value AS y, row_number() OVER w - 1 AS i, lag(value) OVER w AS x, count(*) OVER (PARTITION BY event_type, user_id % 2) AS n FROM events WINDOW w AS (PARTITION BY event_type, user_id % 2 ORDER BY ts, event_id)),
t AS (SELECT event_type, greatest(2, floor(max(n) * 0.3)) AS train, max(y) - min(y) AS span FROM s WHERE side = 0 GROUP BY 1),
m AS (SELECT event_type, side, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s JOIN t USING (event_type) WHERE i >= 1 AND i < train GROUP BY ALL),
p AS (SELECT event_type, CASE side WHEN 0 THEN 'real' ELSE 'synthetic' END AS model, y, a + b * x AS p, span FROM (SELECT event_type, i, x, y FROM s WHERE side = 0) JOIN t USING (event_type) JOIN m USING (event_type) WHERE i >= train
  UNION ALL SELECT event_type, unnest(['lag_1', 'lag_window']), y, x, span FROM s JOIN t USING (event_type) WHERE side = 0 AND i >= train),
r AS (SELECT event_type, model, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, any_value(span) AS span FROM p GROUP BY ALL)
SELECT event_type, model, n, round(rmse, 5) AS rmse, round(rmse / span, 6) AS nrmse, round(mae, 5) AS mae, round(rmse / first_value(rmse) OVER (PARTITION BY event_type ORDER BY model <> 'lag_1'), 6) AS relative FROM r""")
def forecast_transfer(e: DataFrame) -> DataFrame:
    """Readings of even devices forecast from the one before, learnt from their first 30 % or from odd devices'. (One lag, so that SQL has the same regression.)"""
    real, other = (e.where(F.col("user_id") % 2 == side) for side in (0, 1))
    found = forecast.transfer(real, other, "event_type", ORDER, "value", 1, 0.3)
    return found.select("event_type", "model", "n", F.round("rmse", 5).alias("rmse"), six(F.col("nrmse")).alias("nrmse"), F.round("mae", 5).alias("mae"), six(F.col("relative")).alias("relative"))


@query(f"""WITH p AS (SELECT *, {US} // 1000000 AS t FROM events), c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c), s AS (SELECT event_type, greatest(max(t) - min(t), 0.5)::DOUBLE AS s FROM r GROUP BY user_id, run, event_type),
m AS (SELECT event_type, median(s) AS m, count(*) AS segments FROM s GROUP BY 1), d AS (SELECT event_type, 1.4826 * median(abs(s - m)) AS mad FROM s JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, segments, m AS seconds, round(greatest(mad, m / 10), 4) AS spread, count(*) AS rows, round(CASE WHEN count(*) >= 20 THEN avg(value) END, 6) AS mean, round(CASE WHEN count(*) >= 20 THEN stddev_pop(value) END, 5) AS sd
FROM m JOIN d USING (event_type) JOIN events USING (event_type) GROUP BY ALL""")
def fit_labels(e: DataFrame) -> DataFrame:
    """Kinds of event as labels of devices' recordings: their segments, how long these last, and the readings in them."""
    own = e.select("user_id", "event_id", "event_type", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"))
    found = rhythm.labelled(own, "user_id", ["t", "event_id"], "event_type", "value")
    return found.select("event_type", "segments", "seconds", F.round("spread", 4).alias("spread"), "rows", six(F.col("mean")).alias("mean"), F.round("sd", 5).alias("sd"))


@query("""WITH p AS (SELECT event_type, value, epoch_us(ts) // 86400000000 AS day, user_id FROM events), b AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS k FROM (SELECT DISTINCT event_type, day FROM p WHERE user_id % 2 = 0)),
d AS (SELECT event_type, rep, ('0x' || substr(md5('limits/' || rep || '/' || i), 1, 8))::BIGINT % k AS j FROM b, (SELECT unnest(range(1, 21)) AS rep)),
q AS (SELECT d.event_type, rep, quantile_cont(value, 0.99) AS q FROM d JOIN b ON b.event_type = d.event_type AND b.i = d.j JOIN p ON p.event_type = b.event_type AND p.day = b.day AND p.user_id % 2 = 0 GROUP BY ALL),
r AS (SELECT event_type, quantile_cont(value, 0.99) AS real FROM p WHERE user_id % 2 = 0 GROUP BY 1), s AS (SELECT event_type, stddev_samp(q) AS sigma_real FROM q GROUP BY 1),
o AS (SELECT event_type, stddev_samp(q) AS sigma_seed FROM (SELECT event_type, user_id % 10 AS seed, quantile_cont(value, 0.99) AS q FROM p WHERE user_id % 2 = 1 GROUP BY ALL) GROUP BY 1)
SELECT event_type, round(real, 6) AS real, round(sigma_real, 5) AS sigma_real, round(sigma_seed, 5) AS sigma_seed, round(2 * sqrt(sigma_real * sigma_real + sigma_seed * sigma_seed) / real, 6) AS rel_tol FROM r JOIN s USING (event_type) JOIN o USING (event_type)""")
def derive_limits(e: DataFrame) -> DataFrame:
    """How far a 99th percentile may be from that of even devices: their deviation over drawn days, and that between five groups of odd devices."""
    own = e.withColumn("day", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000))
    real = statistics.bootstrapped(own.where("user_id % 2 = 0"), "event_type", "day", "value", 0.99, 20, "limits")
    seeds = own.where("user_id % 2 = 1").select(F.struct("event_type", (F.col("user_id") % 10).alias("seed")).alias("of"), "value")
    seeds = statistics.quantiles(seeds, "of", "value", {"q": 0.99}).groupBy(F.col("of.event_type").alias("event_type")).agg(F.stddev_samp("q").alias("sigma_seed"))
    found = real.join(seeds, "event_type")
    limit = statistics.tolerance(F.col("sigma"), F.col("sigma_seed")) / F.col("quantile")
    return found.select("event_type", six(F.col("quantile")).alias("real"), F.round("sigma", 5).alias("sigma_real"), F.round("sigma_seed", 5).alias("sigma_seed"), six(limit).alias("rel_tol"))


def registered(f):  # noqa: ANN001, ANN201
    """A query that has no SQL; tests compare its operator with plain Python."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return f


@registered
def fit_rhythm(e: DataFrame) -> DataFrame:
    """Rhythm of the readings of each kind of event. No SQL: medians are trimmed in rounds."""
    own = e.select("event_type", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), "value")
    return rhythm.rhythm(own, "event_type", ["t", "event_id"], "value", 8, 9, least_ratio=1.0, most_apart=1000.0)


@registered
def fit_hard_iron(e: DataFrame) -> DataFrame:
    """Offsets of each device's magnetometer, which sees a field turned by its orientation and moved by its reading. No SQL: a system of six equations a device."""
    v = F.col("value")
    own = oriented(e).join(e.select("event_id", "value"), "event_id")
    seen = rotation.rotated(rotation.conjugate(F.col("q")), rotation.vector(F.lit(20.0), F.lit(5.0), F.lit(-40.0)))
    own = own.withColumn("s", seen).withColumn("m", rotation.vector(F.col("s.x") + v / 100, F.col("s.y") - 3, F.col("s.z") + F.col("user_id") % 5))
    return attitude.hard_iron(own, "user_id", "q", "m")


@registered
def counter_rotation(e: DataFrame) -> DataFrame:
    """Neighbouring kinds of event as sensors on an hourly grid: how often they turn against each other. No SQL: orientations are interpolated on the sphere."""
    own = oriented(e).join(e.select("event_id", "event_type"), "event_id")
    yaws = attitude.yaw_rates(own, "event_type", "t", "q", hertz=1 / 3600)
    pairs = e.sparkSession.createDataFrame([("click", "view"), ("view", "purchase"), ("purchase", "signup"), ("signup", "error")], "a string, b string")
    return attitude.counter_rotation(yaws, pairs, "event_type", hertz=1 / 3600, merge=3600, least=3600)


@registered
def fingerprint_distances(e: DataFrame) -> DataFrame:
    """How far odd devices' motion is from even ones' (an hour counts as a second). No SQL: the axis of a step is a product of quaternions."""
    own = oriented(e).withColumn("side", (F.col("user_id") % 2).cast("int")).withColumn("t", F.col("t") / 3600).withColumn("a", rotation.gravity(F.col("q")))
    prints = attitude.fingerprint(own.withColumn("m", F.col("a")), "side", ORDER, "t", "q", "a", "m", longest=1e9)
    return attitude.fingerprint_distance(prints, "side")


@registered
def two_sample_test(e: DataFrame) -> DataFrame:
    """Whether trees tell days of odd devices from days of even ones, and how well they tell permuted labels. No SQL: trees are grown level by level."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    own = e.groupBy("user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("high"), F.min("value").alias("low"), F.avg(F.hour("ts")).alias("hour"))
    own = own.withColumn("id", F.col("user_id") * 100_000 + F.col("day") % 100_000).withColumn("side", F.col("user_id") % 2)
    return twosample.accuracies(own, "id", "side", "day", ["n", "mean", "high", "low", "hour"], permutations=10, trees=5)
