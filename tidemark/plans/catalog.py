"""Registered queries for the sensor analytics, with the same queries in SQL.

The events table serves as sensor log: user_id is the device, event_type its state, value the reading; event_id breaks ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import physics
from tidemark.operators import lookups, sliced, statistics, windows
from tidemark.operators.sliced import Series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "exposure_alarms"

ORDER = ["ts", "event_id"]
OVER = "(PARTITION BY user_id ORDER BY ts, event_id)"


def query(sql: str) -> Callable:
    def register(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/events.parquet"))
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def six(x: Column) -> Column:
    return F.round(x, 6)


def log(e: DataFrame) -> Series:
    """The devices' series."""
    return Series(e, "user_id", ORDER)


def scalar(name: str, column: Callable[[Column], Column], sql: str) -> None:
    """A query of one expression of the reading v (seconds of the day: t)."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
        e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.col("value")).withColumn("t", seconds.cast("double"))
        return e.select("event_id", six(column(e)).alias("x"))

    QUERIES[name] = f
    ORACLE_SQL[name] = f"SELECT event_id, round({sql}, 6) AS x FROM (SELECT event_id, value AS v, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS t FROM events)"


scalar("saturation_vapour", lambda e: physics.saturation_vapour_pressure(F.pmod(e.v, F.lit(40.0))), "6.112 * exp(17.62 * (v % 40) / (243.12 + v % 40))")
scalar("relative_humidity", lambda e: physics.relative_humidity(F.lit(12.0), F.pmod(e.v, F.lit(40.0))), "least(100 * 12 / (6.112 * exp(17.62 * (v % 40) / (243.12 + v % 40))), 100)")
scalar("pressure_at_height", lambda e: physics.pressure_at(F.lit(1013.25), e.v), "1013.25 * pow(1 - 2.25577e-5 * v, 5.25588)")
scalar("quantised_reading", lambda e: physics.quantised(e.v, 0.5, 0, 50), "least(greatest(round_even(v / 0.5, 0) * 0.5, 0), 50)")
scalar("deadband_reading", lambda e: physics.deadband(e.v, 10, 2.5), "CASE WHEN abs(v - 10) < 2.5 THEN 10.0::DOUBLE ELSE v END")
scalar("step_signal", lambda e: physics.step(e.t, 36000, 5.0, 1.0), "CASE WHEN t >= 36000 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END")
scalar("ramp_signal", lambda e: physics.ramp(e.t, 20000, 30000, 1.0, 9.0), "1.0::DOUBLE + 8.0::DOUBLE * least(greatest((t - 20000) / 30000, 0), 1)")
scalar("pulse_signal", lambda e: physics.pulse(e.t, 20000, 10000, 4.0, 5000), "4.0::DOUBLE * least(greatest(least((t - 20000) / 5000, (40000 - t) / 5000), 0), 1)")
scalar("periodic_signal", lambda e: physics.periodic(e.t, 3600, 2.0, 10.0, 900), "10.0::DOUBLE + 2.0::DOUBLE * sin(2 * pi() * (t - 900) / 3600)")
scalar("duty_cycle_signal", lambda e: physics.duty_cycle(e.t, 1800, 0.25, 3.0), "CASE WHEN t % 1800 < 450 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END")
scalar("counter_uniform", lambda e: physics.uniform("42", "noise", e.event_id), "(('0x' || substr(md5('42/noise/' || event_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE")
scalar("affine_output", lambda e: e.v * 1.8 + 32, "v * 1.8::DOUBLE + 32")


@query(f"""
WITH m AS (SELECT event_id, user_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING) / 10 AS stel FROM events),
l AS (SELECT *, coalesce(last_value(CASE WHEN stel >= 40 THEN 1 WHEN stel < 30 THEN 0 END IGNORE NULLS) OVER {OVER}, 0) AS alarm FROM m)
SELECT event_id, user_id, round(stel, 6) AS stel, alarm::INTEGER AS alarm FROM l""")
def exposure_alarms(e: DataFrame) -> DataFrame:
    m = log(e).framed(9, stel=lambda w: windows.exposure_mean(F.col("value"), w, 10))
    return windows.latch(m, "alarm", F.col("stel") >= 40, F.col("stel") < 30).rows.select("event_id", "user_id", six(F.col("stel")).alias("stel"), "alarm")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 10 / 28800, 8) AS twa FROM events")
def cumulative_dose(e: DataFrame) -> DataFrame:
    return windows.dose(log(e), "twa", F.col("value"), 10, 28800).rows.select("event_id", F.round("twa", 8).alias("twa"))


@query(f"SELECT event_id, round(coalesce((value - lag(value, 3) OVER {OVER}) / 30 * 60, 0), 6) AS rate FROM events")
def rate_of_change(e: DataFrame) -> DataFrame:
    return log(e).framed(3, rate=lambda w: six(windows.rate_of_change(F.col("value"), w, 3, 10, 60))).rows.select("event_id", "rate")


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(quantile_cont(value, 0.5) OVER w, 6) AS median FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)""")
def centred_window(e: DataFrame) -> DataFrame:
    own = log(e).framed(5, 4, mean=lambda w: six(F.avg("value").over(windows.centred(10, w))), median=lambda w: six(F.percentile("value", F.lit(0.5)).over(windows.centred(10, w))))
    return own.rows.select("event_id", "mean", "median")


@query("""SELECT event_id, round(CASE WHEN count(value) OVER w >= 5 THEN stddev_samp(value) OVER w END, 5) AS sd FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING)""")
def rolling_deviation(e: DataFrame) -> DataFrame:
    return log(e).framed(9, sd=lambda w: F.round(windows.rolling_deviation(F.col("value"), w, 10), 5)).rows.select("event_id", "sd")


@query(f"SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS high, round(value - lag(value) OVER {OVER}, 6) AS diff FROM events")
def running_maximum(e: DataFrame) -> DataFrame:
    own = log(e).running(high=sliced.highest(F.col("value"))).framed(1, diff=lambda w: six(F.col("value") - F.lag("value").over(w)))
    return own.rows.select("event_id", "high", "diff")


@query(f"""WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER {OVER} THEN 1 ELSE 0 END AS c FROM events),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def state_runs(e: DataFrame) -> DataFrame:
    return windows.runs(log(e), "event_type")


@query(f"""WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER {OVER} THEN 1 ELSE 0 END AS c FROM events),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT event_id, round(percent_rank() OVER (PARTITION BY user_id, run ORDER BY ts, event_id), 6) AS progress FROM r""")
def run_progress(e: DataFrame) -> DataFrame:
    own = windows.run_id(log(e), "run", "event_type").running(i=sliced.number()).framed(1, 1, starts=lambda w: ~F.col("run").eqNullSafe(F.lag("run").over(w)), ends=lambda w: ~F.col("run").eqNullSafe(F.lead("run").over(w)))
    own = own.running(a=sliced.last(F.when(F.col("starts"), F.col("i"))), b=sliced.upcoming(F.when(F.col("ends"), F.col("i"))))
    return own.rows.select("event_id", six(F.when(F.col("b") == F.col("a"), 0.0).otherwise((F.col("i") - F.col("a")) / (F.col("b") - F.col("a")))).alias("progress"))


@query(f"SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER {OVER})) // 1000000 AS gap_s FROM events QUALIFY gap_s > 21600")
def gaps(e: DataFrame) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = log(e).with_columns(us=micros).framed(1, gap_s=lambda w: F.floor((F.col("us") - F.lag("us").over(w)) / 1000000))
    return own.rows.select("event_id", "gap_s").where("gap_s > 21600")


@query(f"""SELECT event_id, (epoch_us(ts) - epoch_us(last_value(CASE WHEN value > 60 THEN ts END IGNORE NULLS) OVER {OVER})) // 1000000 AS still_s FROM events""")
def time_since_movement(e: DataFrame) -> DataFrame:
    own = log(e).with_columns(us=F.unix_micros(F.col("ts").cast("timestamp"))).running(last=sliced.last(F.when(F.col("value") > 60, F.col("us"))))
    return own.rows.select("event_id", F.floor((F.col("us") - F.col("last")) / 1000000).alias("still_s"))


@query("""WITH s AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT q.event_id, q.user_id, q.ts, s.value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'click') q
ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.ts >= s.ts""")
def as_of_backward(e: DataFrame) -> DataFrame:
    samples = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return lookups.as_of(e.where("event_type <> 'click'").select("event_id", "user_id", "ts"), samples, "user_id", "ts", "value")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL),
q AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type <> 'click'),
a AS (SELECT q.*, s.t AS ta, s.v AS va FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.t >= s.t),
b AS (SELECT a.*, s.t AS tb, s.v AS vb FROM a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.t <= s.t)
SELECT event_id, round(CASE WHEN ta = tb THEN va ELSE coalesce(va + (vb - va) * ((t - ta) / (tb - ta)::DOUBLE), va, vb) END, 6) AS value FROM b""")
def linear_interpolation(e: DataFrame) -> DataFrame:
    own = e.withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    samples = own.where("event_type = 'click'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    return lookups.interpolated(own.where("event_type <> 'click'").select("event_id", "user_id", "t"), samples, "user_id", "t", "value").select("event_id", six(F.col("value")).alias("value"))


@query("""WITH p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t, event_type FROM events),
i AS (SELECT event_id AS label_id, user_id, t AS s, t + 7200 AS e FROM p WHERE event_type = 'purchase')
SELECT p.event_id, i.label_id FROM p JOIN i ON p.user_id = i.user_id AND p.t >= i.s AND p.t < i.e""")
def interval_labels(e: DataFrame) -> DataFrame:
    points = e.select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), "event_type")
    labels = points.where("event_type = 'purchase'").select(F.col("event_id").alias("label_id"), "user_id", F.col("t").alias("s"), (F.col("t") + 7200).alias("e"))
    return lookups.within(points.drop("event_type"), labels, "user_id", "t", "s", "e", 7200).select("event_id", "label_id")


@query("""WITH p AS (SELECT user_id, epoch_us(ts) // 86400000000 AS d FROM events),
g AS (SELECT user_id, unnest(range(min(d), max(d) + 1)) AS d FROM p GROUP BY user_id)
SELECT user_id, d::BIGINT AS d FROM g ANTI JOIN p USING (user_id, d)""")
def missing_grid_rows(e: DataFrame) -> DataFrame:
    p = e.select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).alias("d"))
    grid = p.groupBy("user_id").agg(F.min("d").alias("a"), F.max("d").alias("b")).select("user_id", F.explode(F.sequence("a", "b")).alias("d"))
    return grid.join(p, ["user_id", "d"], "left_anti")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS low, max(value) AS high, round(stddev_pop(value), 5) AS sd_pop,
round(stddev_samp(value), 5) AS sd_samp, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95, round(kurtosis_pop(value), 4) AS kurtosis, count(DISTINCT value) AS levels
FROM events GROUP BY event_type""")
def column_summary(e: DataFrame) -> DataFrame:
    v = F.col("value")
    plain = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), six(F.avg(v)).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.stddev_pop(v), 5).alias("sd_pop"), F.round(F.stddev_samp(v), 5).alias("sd_samp"), F.round(F.kurtosis(v), 4).alias("kurtosis"))
    levels = e.groupBy("event_type", "value").agg(F.lit(1).alias("one")).groupBy("event_type").agg(F.count("value").alias("levels"))
    ranks = statistics.quantiles(e, "event_type", "value", {"median": 0.5, "p5": 0.05, "p95": 0.95})
    return plain.join(levels, "event_type").join(ranks.select("event_type", *(six(F.col(c)).alias(c) for c in ("median", "p5", "p95"))), "event_type")


@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1)
SELECT event_type, round(1.4826 * median(abs(value - m)), 6) AS mad FROM events JOIN m USING (event_type) GROUP BY event_type""")
def median_deviation(e: DataFrame) -> DataFrame:
    return statistics.mad(e, "event_type", "value").select("event_type", six(F.col("mad")).alias("mad"))


@query("""WITH c AS (SELECT event_type, value, count(*) FILTER (user_id % 2 = 0) AS n0, count(*) FILTER (user_id % 2 = 1) AS n1 FROM events GROUP BY 1, 2),
f AS (SELECT event_type, abs(sum(n0) OVER w / sum(n0) OVER (PARTITION BY event_type) - sum(n1) OVER w / sum(n1) OVER (PARTITION BY event_type)) AS gap, lead(value) OVER (PARTITION BY event_type ORDER BY value) - value AS width
FROM c WINDOW w AS (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING))
SELECT event_type, round(max(gap), 6) AS ks, round(sum(gap * width), 5) AS wasserstein FROM f GROUP BY event_type""")
def two_sample_distances(e: DataFrame) -> DataFrame:
    return statistics.distances(e.withColumn("side", F.col("user_id") % 2), "event_type", "value", "side").select("event_type", six(F.col("ks")).alias("ks"), F.round("wasserstein", 5).alias("wasserstein"))


@query("""WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value - avg(value) OVER (PARTITION BY user_id) AS x, var_pop(value) OVER (PARTITION BY user_id) AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT a.user_id, (b.i - a.i)::INTEGER AS lag, round(sum(a.x * b.x) / (any_value(a.v) * any_value(a.n)), 5) AS acf FROM o a JOIN o b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 0 AND 10 GROUP BY ALL""")
def autocorrelation(e: DataFrame) -> DataFrame:
    return statistics.autocorrelation(e, "user_id", "value", ORDER, 10).select("user_id", "lag", F.round("acf", 5).alias("acf"))


@query(f"""WITH t AS (SELECT event_type AS a, lead(event_type) OVER {OVER} AS b FROM events),
c AS (SELECT a, b, count(*) AS n FROM t WHERE a <> b GROUP BY ALL)
SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS share FROM c""")
def state_transitions(e: DataFrame) -> DataFrame:
    return statistics.transitions(e, "user_id", "event_type", ORDER).withColumn("share", six(F.col("share")))


@query("""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT least(floor((value - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS n FROM events, b GROUP BY 1""")
def histogram(e: DataFrame) -> DataFrame:
    b = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # one row
    at = F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 30))
    return e.crossJoin(F.broadcast(b)).groupBy(F.least(at, F.lit(29)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT event_type, value AS y, lag(value) OVER {OVER} AS x FROM events)
SELECT event_type, round(corr(x, y), 5) AS r, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 5) AS r2 FROM p GROUP BY event_type""")
def lag_regression(e: DataFrame) -> DataFrame:
    p = log(e).framed(1, x=lambda w: F.lag("value").over(w)).rows.select("event_type", F.col("value").alias("y"), "x")
    return p.groupBy("event_type").agg(F.round(F.corr("x", "y"), 5).alias("r"), F.round(F.regr_slope("y", "x"), 5).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.round(F.regr_r2("y", "x"), 5).alias("r2"))


@query("""SELECT event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('7/' || event_id), event_id) AS k FROM events) WHERE k <= 5""")
def seeded_sample(e: DataFrame) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.md5(F.concat(F.lit("7/"), F.col("event_id").cast("string"))), "event_id"))
    return e.withColumn("k", k).where("k <= 5").select("event_id", "value")


@query("""SELECT user_id, count(*) AS rows, count(*) FILTER (value < 0 OR value > 500) AS out_of_range, count(*) FILTER (abs(value / 0.01 - round_even(value / 0.01, 0)) > 1e-6 * greatest(1, abs(value / 0.01))) AS off_grid,
count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase', 'signup', 'error')) AS unknown_state FROM events GROUP BY user_id""")
def reading_gate(e: DataFrame) -> DataFrame:
    q = F.col("value") / 0.01
    bad = lambda c: F.count(F.when(c, 1))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), bad((F.col("value") < 0) | (F.col("value") > 500)).alias("out_of_range"), bad(F.abs(q - F.rint(q)) > 1e-6 * F.greatest(F.lit(1.0), F.abs(q))).alias("off_grid"),
        bad(~F.col("event_type").isin("click", "view", "purchase", "signup", "error")).alias("unknown_state"))
