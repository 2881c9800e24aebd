"""What the operators of this subpackage share: staged tables, global row numbers, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def small_batches(spark: SparkSession, rows: int = 500, most_bytes: int = 8 << 20) -> None:
    """Texts can be long, so tasks exchange fewer rows, and bytes, at a time with Python than Spark's defaults
    of 10,000 and 64 MB; a longer text is a batch of its own. Spark has these settings for a whole session only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in spark.checkpoint.dir. Only where that is unset and the master is local (tests on one
    machine) a temporary folder is made and set for the session; on a cluster, where executors would each
    write to a disk of their own, the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: this cuts the lineage, so a lost
    executor costs at most the tasks that were running, and rows numbered once keep their numbers."""
    small_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_parts(parts: Iterable[DataFrame], empty: DataFrame, name: str) -> DataFrame:
    """staged(), for a table that comes in parts, each written before the next is asked for; empty: a table of its columns, for the case that no part comes."""
    small_batches(empty.sparkSession)
    path = f"{shared_folder(empty.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    empty.write.parquet(path)
    for part in parts:
        part.select(*empty.columns).write.mode("append").parquet(path)
    return empty.sparkSession.read.schema(empty.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more. What a result still reads stays, and is the caller's to clear with the folder."""
    for table in tables:
        folder = table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else ""
        if "/tidemark/" in folder:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The column of row numbers that keyed() adds.
ROW = "_tidemark_row_number"


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row, staged so that it stays the same: decisions go by row, whatever its id."""
    return staged(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def among(rows: DataFrame, column: str, wanted: DataFrame, there: bool = True) -> DataFrame:
    """The rows whose number in column (long) is in the only column of wanted, or with there=False the others. Rows without a number are among none.

    wanted is broadcast as one bit for each number: 1 kB for 8,192 numbers in sequence, as keyed() gives them (2 MB for 16
    million rows), so rows with long texts aren't shuffled for a join. Scattered numbers take up to 1 kB each.
    """
    bits = wanted.toDF("_n").dropna().groupBy(F.shiftright("_n", 13).alias("_high"), F.shiftright("_n", 6).bitwiseAND(127).cast("int").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_n & 63 as int))")).alias("_bits"))
    words = bits.groupBy("_high").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_map"))
    words = words.select(F.col("_high").alias("_tidemark_high"), F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0))).alias("_tidemark_words"))
    number = F.col(column)
    bit = F.getbit(F.get("_tidemark_words", F.shiftright(number, 6).bitwiseAND(127).cast("int")), number.bitwiseAND(63).cast("int"))
    found = rows.join(F.broadcast(words), F.shiftright(number, 13) == F.col("_tidemark_high"), "left")
    return found.where(F.coalesce(bit, F.lit(0)) == int(there)).drop("_tidemark_high", "_tidemark_words")


def without_rows(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows of keyed() docs whose number isn't in the only column of gone, without the number."""
    return among(docs, ROW, staged(gone, name), there=False).drop(ROW)


def least_keyed(rows: DataFrame, most: int, *ties: str) -> DataFrame:
    """The `most` rows of least k, an MD5 as hex digits (of more than the id, which can be null or repeated); ties are ordered by the columns named.

    Rows are counted first, and of each task's rows only those under a bound that about 4 * most of all rows pass are sent
    on, so what meets in one task doesn't grow with the number of tasks.
    """
    share = min(1.0, 4 * most / max(1, rows.count()))
    bound = f"{int(share * 0xFFFFFFFF):08x}" if share < 1 else "g"  # "g" is above all digits
    return rows.where(F.col("k") < bound).orderBy("k", *ties).limit(most)


def sample_key(id_col: str, text_col: str):
    """An MD5 of id and text as hex digits, for seeded samples."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string")))


def numbered(df: DataFrame, order: list, name: str, position: str = "position") -> DataFrame:
    """df with a gapless global position by order, without sorting everything in one task.

    Rows are range-partitioned and sorted; the running offsets of the partitions are the only table
    that is broadcast, and it has one row for each partition. The sorted rows are staged first, so the
    positions stay the same when tasks run again.
    """
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()), name)
    part = F.shiftright("_mid", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(position, F.col("_offset") + F.col("_mid").bitwiseAND((1 << 33) - 1))
        .drop("_mid", "_part", "_offset")
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (src, dst: long): one row (node, root) for each node that has an edge.

    Each round contracts every node into the neighbour of smallest priority, where the priorities are
    a fresh hash of the node in each round, so a constant share of the nodes goes whatever the shape of
    the graph, long chains included. All steps are grouped minimums and joins; nothing is collected.
    """
    edges = staged(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), f"{name}-edges")
    roots = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct().withColumn("root", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.union(edges.select("dst", "src"))
        best = both.groupBy("src").agg(F.min(rank("dst")).alias("near")).select(F.col("src").alias("was"), F.least("near", rank("src")).getField("to").alias("now"))
        best, old = staged(best, f"{name}-hooks"), (edges, roots)
        roots = staged(roots.join(best, roots.root == best.was, "left").select("node", F.coalesce("now", "root").alias("root")), f"{name}-roots")
        a, b = best.toDF("src", "a"), best.toDF("dst", "b")
        moved = edges.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        edges = staged(moved.distinct(), f"{name}-edges")
        release(best, *(old if turn else old[:1]))  # the first roots were never written
        turn += 1
    return roots
