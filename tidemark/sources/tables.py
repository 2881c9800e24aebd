"""Files of recordings, labels, manifests and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import statistics
from tidemark.operators.sliced import Series

# Names under which a recording's columns are found, the first that is there.
NAMES = {"x": ["quat_x", "orientation_x"], "y": ["quat_y", "orientation_y"], "z": ["quat_z", "orientation_z"], "ax": ["accel_x", "acceleration_x"], "ay": ["accel_y", "acceleration_y"], "az": ["accel_z", "acceleration_z"]}


def readable(line: bytes, encoding: str) -> bool:
    try:
        line.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def encoding_of(spark: SparkSession, path: str, encodings: tuple[str, ...]) -> str:
    """The first of the encodings in which all lines of the files can be read; the last if none is. One pass over the lines tries all of them; a task sends one row a batch."""
    tried = encodings[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lines = part.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([any(not readable(x, e) for x in lines)]) for e in tried], names=[f"e{i}" for i in range(len(tried))])

    if not tried:
        return encodings[-1]
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("line"))
    broken = lines.mapInArrow(run, ", ".join(f"e{i} boolean" for i in range(len(tried)))).agg(*(F.coalesce(F.bool_or(f"e{i}"), F.lit(False)).alias(f"e{i}") for i in range(len(tried)))).first()
    return next((e for e, bad in zip(tried, broken, strict=True) if not bad), encodings[-1])


def gzipped(spark: SparkSession, path: str) -> list[str]:
    """Files that begin with gzip's two magic bytes, whatever their names."""
    heads = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 2).alias("head"))
    return [r.path for r in heads.where(F.col("head") == F.unhex(F.lit("1F8B"))).collect()]


def read_csv(spark: SparkSession, path: str, schema: StructType | str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """CSV files with a header and a given schema: types are never guessed. Files are plain, or gzip by suffix; a gzip file under another name is an error that
    names it, since Spark unpacks by suffix. The encoding is the first in which all lines can be read."""
    hidden = [p for p in gzipped(spark, path) if not p.endswith(".gz")]
    if hidden:
        raise ValueError(f"packed by gzip, but not named .gz: {', '.join(hidden[:5])}")
    return spark.read.schema(schema).csv(path, header=True, encoding=encoding_of(spark, path, encodings))


def recording(spark: SparkSession, path: str, schema: StructType | str, key: str, time: str = "timestamp", names: dict[str, list[str]] | None = None) -> DataFrame:
    """A recorded log as operators take it: CSV by read_csv(), plain names, columns under the names of NAMES, and seconds since each key's first row, whatever the unit of its times."""
    found = aliased(plain_names(read_csv(spark, path, schema)), names or NAMES)
    return seconds_since_start(found, key, time)


def summary(checks: DataFrame, key: str, path: str) -> None:
    """One JSON object for each key of gates' rows (key, rule, violations): whether all passed, how many rules there are, and those that failed with their violations."""
    failed = F.collect_list(F.when(F.col("violations") > 0, F.struct("rule", "violations")))
    found = checks.groupBy(key).agg((F.max("violations") == 0).alias("passed"), F.count(F.lit(1)).alias("rules"), F.array_sort(failed).alias("failed"))
    found.write.mode("errorifexists").json(path)


def report(checks: DataFrame, key: str, path: str) -> None:
    """Lines of text for each row of gates' checks, in order of key and rule: a sign, the rule and what was found."""
    line = F.concat_ws(" ", F.when(F.col("violations") == 0, "ok  ").otherwise("FAIL"), F.col(key).cast("string"), F.col("rule"), F.col("violations").cast("string"))
    checks.orderBy(key, "rule").select(line.alias("value")).write.mode("errorifexists").text(path)


def plain_names(df: DataFrame) -> DataFrame:
    """Column names without the spaces and quotation marks around them."""
    return df.toDF(*(c.strip().strip('"').strip() for c in df.columns))


def aliased(df: DataFrame, names: dict[str, list[str]] = NAMES) -> DataFrame:
    """df with each column of names that one of its aliases gives, as a number (null where it isn't one)."""
    found = {n: next((a for a in own if a in df.columns), None) for n, own in names.items()}
    return df.withColumns({n: F.col(f"`{a}`").try_cast("double") for n, a in found.items() if a})


def numeric(df: DataFrame, keep: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """The columns to keep, which must be there, and all that hold numbers, of which there must be one."""
    numbers = [c for c, t in df.dtypes if t.split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal") and c not in keep]
    if missing := [c for c in keep if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)}")
    if not numbers:
        raise ValueError("no column of numbers")
    return df.select(*keep, *numbers)


def seconds_since_start(df: DataFrame, key: str, time: str) -> DataFrame:
    """df with `seconds` since each key's first row, from whole numbers of milliseconds or seconds: milliseconds where a key's median step is 10 or more."""
    steps = Series(df.select(key, time), key, [time]).framed(0, 1, _step=lambda w: (F.lead(time).over(w) - F.col(time)).cast("double")).rows
    unit = statistics.quantiles(steps, key, "_step", {"_median": 0.5})
    first = df.groupBy(key).agg(F.min(time).alias("_first"))
    scaled = (F.col(time) - F.col("_first")) / F.when(F.col("_median") >= 10, 1000.0).otherwise(1.0)
    return df.join(first, key).join(unit, key, "left").withColumn("seconds", scaled).drop("_first", "_median")


def rounded(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Columns rounded, halves to even; to no digits as whole numbers."""
    return df.withColumns({c: F.bround(c, d).cast("int") if d == 0 else F.bround(c, d) for c, d in decimals.items()})


def write_log(df: DataFrame, path: str, columns: list[str], names: dict[str, str], decimals: dict[str, int], by: str) -> None:
    """One CSV folder for each value of `by`: the columns in order, under their outside names, with fixed decimals."""
    rounded(df, decimals).select(*(F.col(c).alias(names.get(c, c)) for c in columns), F.col(by).alias("part")).write.mode("errorifexists").partitionBy("part").csv(path, header=True)


def labels(intervals: DataFrame, start: str, end: str, zero: Column) -> DataFrame:
    """Label rows: start and end in seconds and as times in UTC, and event, detail and scope of intervals; ordered by the writer."""
    at = lambda c: F.timestamp_micros((F.unix_micros(zero) + F.round(F.col(c) * 1000000)).cast("long"))
    return intervals.select(F.col(start).alias("start_s"), F.col(end).alias("end_s"), F.date_format(at(start), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_utc"), F.date_format(at(end), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("end_utc"), "event", "detail", "scope")


def manifest(df: DataFrame, **values) -> DataFrame:
    """One row of JSON for each row of df: its columns, and fixed values."""
    return df.select(F.to_json(F.struct(*df.columns, *(F.lit(v).alias(k) for k, v in values.items()))).alias("value"))


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Documents of one JSON object a file, such as manifests and thresholds, with a given schema."""
    return spark.read.schema(schema).json(path, multiLine=True)
