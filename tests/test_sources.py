"""Files, streaming forms, gates on tampered rows, and helpers of edge cases."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import physics, rotation, text, units
from tidemark.operators import gates, lookups, statistics, windows
from tidemark.operators.sliced import Series
from tidemark.sources import tables
from tidemark.streaming import features

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_csv_with_fallback_encoding_gzip_and_quoted_names(spark, tmp_path):
    body = '" timestamp ","orientation_x","note"\n1,0.5,café\n2,oops,x\n'
    schema = "timestamp long, orientation_x string, note string"
    (tmp_path / "a.csv").write_bytes(body.encode("latin-1"))
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(body.encode()))
    for name in ("a.csv", "b.csv.gz"):
        df = tables.read_csv(spark, str(tmp_path / name), schema)
        assert [tuple(r) for r in df.orderBy("timestamp").collect()] == [(1, "0.5", "café"), (2, "oops", "x")]
    found = tables.numeric(tables.aliased(tables.plain_names(df.toDF('" timestamp "', "orientation_x", "note"))))
    assert found.columns == ["timestamp", "x"] and [r.x for r in found.orderBy("timestamp").collect()] == [0.5, None]
    with pytest.raises(ValueError, match="timestamp"):
        tables.numeric(df.toDF("a", "b", "c"))


def test_encodings_are_tried_in_order(spark, tmp_path):
    schema = "a string, b int"
    tried = ("US-ASCII", "UTF-8", "ISO-8859-1")
    for name, word, encoding in (("j", "plain", "US-ASCII"), ("k", "Żółw", "UTF-8"), ("l", "caf\xe9 \xff", "ISO-8859-1")):
        (tmp_path / f"{name}.csv").write_bytes(f"a,b\n{word},1\n".encode(encoding))
        assert tables.encoding_of(spark, str(tmp_path / f"{name}.csv"), tried) == encoding
        assert tables.read_csv(spark, str(tmp_path / f"{name}.csv"), schema, tried).first().a == word
    (tmp_path / "packed.csv").write_bytes(gzip.compress(b"a,b\nx,1\n"))
    with pytest.raises(ValueError, match="packed.csv"):
        tables.read_csv(spark, str(tmp_path / "packed.csv"), schema)


def test_recording_summary_and_report(spark, tmp_path):
    (tmp_path / "r.csv").write_text('" timestamp ",sensor_id,orientation_x\n1000,a,0.5\n1040,a,x\n1080,a,0.25\n')
    found = tables.recording(spark, str(tmp_path / "r.csv"), "timestamp long, sensor_id string, orientation_x string", "sensor_id").orderBy("timestamp").collect()
    assert [(r.seconds, r.x) for r in found] == [(0.0, 0.5), (0.04, None), (0.08, 0.25)]
    checks = spark.createDataFrame([("a", "range", 0), ("a", "alarm", 3), ("b", "range", 0)], "k string, rule string, violations long")
    tables.summary(checks, "k", str(tmp_path / "s"))
    back = {r.k: r for r in spark.read.schema("k string, passed boolean, rules int, failed array<struct<rule:string,violations:long>>").json(str(tmp_path / "s")).collect()}
    assert (back["a"].passed, back["a"].rules, [tuple(f) for f in back["a"].failed]) == (False, 2, [("alarm", 3)]) and back["b"].passed and back["b"].failed == []
    tables.report(checks, "k", str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["FAIL a alarm 3", "ok   a range 0", "ok   b range 0"]


def test_log_labels_and_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.345, 7.5, "a"), (2, 2.355, 8.5, "b")], "t long, x double, n double, device string")
    tables.write_log(df, str(tmp_path / "log"), ["t", "x", "n"], {"x": "reading"}, {"x": 2, "n": 0}, "device")
    back = spark.read.schema("t long, reading double, n int, part string").csv(str(tmp_path / "log"), header=True)
    assert sorted(map(tuple, back.collect())) == [(1, 2.34, 8, "a"), (2, 2.36, 8, "b")]
    got = tables.labels(spark.createDataFrame([(0.0, 90.5, "e", "d", "world")], "s double, e double, event string, detail string, scope string"), "s", "e", F.timestamp_seconds(F.lit(0))).first()
    assert (got.start_utc, got.end_utc, got.scope) == ("1970-01-01T00:00:00Z", "1970-01-01T00:01:30Z", "world")
    tables.manifest(df.where("t = 1"), seed=42).write.text(str(tmp_path / "m"))
    assert tables.read_json(spark, str(tmp_path / "m"), "t long, seed long").first() == (1, 42)


def test_seconds_of_milliseconds_and_seconds(spark):
    df = spark.createDataFrame([("ms", 1000 * k) for k in range(4)] + [("s", k) for k in range(4)], "d string, t long")
    assert {(r.d, r.seconds) for r in tables.seconds_since_start(df, "d", "t").collect()} == {(d, float(k)) for d in ("ms", "s") for k in range(4)}


def test_quantised_has_no_negative_zero_and_no_float_noise(spark):
    a, b = one(spark, physics.quantised(F.lit(-0.1), 0.5), physics.quantised(F.lit(0.3), 0.1))
    assert math.copysign(1, a) == 1 and b == 0.3


def test_quaternions(spark):
    q = rotation.from_axis_angle(rotation.vector(F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2)))
    r = one(spark, rotation.rotated(q, rotation.vector(F.lit(1.0), F.lit(0.0), F.lit(0.0))), rotation.from_axis_angle(rotation.vector(F.lit(0.0), F.lit(0.0), F.lit(0.0))), rotation.angle_degrees(q, rotation.conjugate(q)))
    assert [round(x, 9) for x in r[0]] == [0, 1, 0] and tuple(r[1]) == (1, 0, 0, 0) and r[2] == pytest.approx(180)


def test_texts(spark):
    times = [text.parse_time(F.lit(x)) for x in ("01:30", "1:02:03.5", "90s", "1.5 h", "20min", "7", "soon")]
    assert one(spark, *times) == (5400.0, 3723.5, 90.0, 5400.0, 1200.0, 7.0, None)
    factors = [units.factor(F.lit(u), t) for u, t in (("mg", "g"), ("uT/√Hz", "µT/√Hz"), ("hPa/year", "hPa/h"), ("%", "%RH"), ("g", "hPa"))]
    assert one(spark, *factors)[:2] == (0.001, 1.0) and one(spark, factors[2])[0] == pytest.approx(1 / 8760) and one(spark, *factors[3:]) == (1.0, None)
    assert units.output_transform("°C", "K") == (1.0, 273.15) and units.output_transform("°C", "K", absolute=False) == (1.0, 0.0) and text.decimals(0.25) == 2


def test_lookups_before_the_first_sample(spark):
    q = spark.createDataFrame([("a", 1), ("a", 5)], "k string, t int")
    s = spark.createDataFrame([("a", 3, 9.0), ("a", 8, 7.0)], "k string, t int, v double")
    assert [r.v for r in lookups.as_of(q, s, "k", "t", "v").orderBy("t").collect()] == [None, 9.0]
    assert [r.v for r in lookups.as_of(q, s, "k", "t", "v", clip=True).orderBy("t").collect()] == [9.0, 9.0]


def test_statistics_of_constant_and_short_series(spark):
    df = spark.createDataFrame([("c", i, 5.0) for i in range(20)] + [("s", 0, 1.0), ("s", 1, 2.0)], "k string, i int, v double")
    acf = {(r.k, r.lag): r.acf for r in statistics.autocorrelation(df, "k", "v", ["i"], 3).collect()}
    assert all(acf["c", k] == 0 for k in range(4)) and set(acf) == {("c", 0), ("c", 1), ("c", 2), ("c", 3), ("s", 0), ("s", 1)}
    q = {r.k: (r.a, r.b) for r in statistics.quantiles(df, "k", "v", {"a": 0.5, "b": 0.25}).collect()}
    assert q == {"c": (5.0, 5.0), "s": (1.5, 1.25)}


@pytest.fixture(scope="module")
def clean(spark):
    """A device's log without a fault: ticks 0 to 59, a gap announced at 20 to 29."""
    rows = [(1, t, float((t * 7) % 20)) for t in range(60) if not 20 <= t < 30]
    log = spark.createDataFrame(rows, "k int, tick int, v double")
    return windows.gap_bounds(log, "k", "tick", "v", 5, 0.0, 20.0).select("k", "tick", "v", F.col("mean_low").alias("stel")), spark.createDataFrame([(1, 20, 30)], "k int, s int, e int")


def failed(checks):
    return {r["rule"] for r in checks.where("violations > 0").collect()}


TAMPERED = {
    "clean": (lambda d: d, set()),
    "dropped": (lambda d: d.where("tick <> 40"), {"missing"}),
    "added": (lambda d: d.union(d.where("tick = 19").withColumn("tick", F.lit(25))), {"inside_gap"}),
    "repeated": (lambda d: d.union(d.where("tick = 19")), {"repeated"}),
}


@pytest.mark.parametrize("case", TAMPERED)
def test_timestamps_gate(clean, case):
    log, gaps = clean
    change, want = TAMPERED[case]
    assert failed(gates.timestamps(change(log), "k", "tick", gaps, "s", "e")) == want


def test_value_gates_on_tampered_rows(clean):
    log, _ = clean
    stel = lambda d: failed(gates.exposure(d, "k", "tick", "v", "stel", 5, 0.0, 20.0, 0.01))
    changed = lambda t, by: log.withColumn("stel", F.col("stel") + F.when(F.col("tick") == t, by).otherwise(0.0))
    assert stel(log) == set() and stel(changed(10, 0.1)) == {"stel_exact"} and stel(changed(31, 30.0)) == {"stel_bounded"}
    dosed = windows.dose(Series(log, "k", ["tick"]), "y", F.col("v"), 0.1, 1).rows
    twa = lambda d: failed(gates.dose(d, "k", "tick", "v", "y", 0.1, 0.0, 20.0, 0.01))
    more = lambda c, by: dosed.withColumn("y", F.col("y") + F.when(c, by).otherwise(0.0))
    assert twa(dosed) == set() and twa(more(F.col("tick") == 45, 1.0)) == {"twa_segment"} and twa(more(F.col("tick") >= 30, 99.0)) == {"twa_jump"}
    alarmed = windows.threshold_alarm(Series(log, "k", ["tick"]), "a", F.col("v"), 15, hysteresis=5).rows
    assert failed(gates.alarm(alarmed, "k", ["tick"], "v", "a", 15, 5)) == set()
    assert failed(gates.alarm(alarmed.withColumn("a", F.lit(1)), "k", ["tick"], "v", "a", 15, 5)) == {"alarm"}
    summary = gates.roll_up(gates.counted(log, "k", low=F.col("v") < 0, high=F.col("v") > 18), "k").first()
    assert (summary.passed, summary.n_failed, summary.failed) == (False, 1, "high")


def streamed(spark, tmp_path, name, f, mode, order):
    """The rows of a stream over the events in several files."""
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy(order).coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = f(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return e, spark.table(name)


def test_tumbling_stream_is_batch(spark, tmp_path):
    e, found = streamed(spark, tmp_path, "tumbled", lambda s: features.tumbling(s, "user_id", "ts", "value", "1 day"), "complete", "ts")
    rows = lambda df: sorted((r.user_id, r.start, r.n, round(r["mean"], 9), r.low, r.high) for r in df.collect())
    assert rows(found) == rows(features.tumbling(e, "user_id", "ts", "value", "1 day"))


def test_session_stream_is_batch_but_for_the_open_ones(spark, tmp_path):
    e, found = streamed(spark, tmp_path, "sessioned", lambda s: features.sessions(s, "user_id", "ts"), "append", "ts")
    rows = lambda df: {tuple(r) for r in df.collect()}
    batch, stream = rows(features.sessions(e, "user_id", "ts")), rows(found)
    assert stream <= batch and len(stream) > 0.8 * len(batch)


def test_latched_stream_is_batch(spark, tmp_path):
    e, found = streamed(spark, tmp_path, "latched", lambda s: features.latched(s, "user_id", "event_id", "value", 60, 50), "append", "event_id")
    batch = windows.dose(windows.threshold_alarm(Series(e, "user_id", ["event_id"]), "alarm", F.col("value"), 60, hysteresis=10), "dose", F.col("value"), 1, 1).rows.select("user_id", "event_id", "alarm", "dose")
    rows = lambda df: sorted((r.user_id, r.event_id, r.alarm, round(r.dose, 6)) for r in df.collect())
    assert len(rows(found)) == e.count()
    if [f for f in sorted((tmp_path / "in").glob("*.parquet"))]:
        assert rows(found) == rows(batch)
