"""Shards that all match the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, staged


def shard(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """One row (doc_id, size, text_crc32, source, shard, slot) for each row of docs.

    The rows of each source are put in a seeded shuffle (by the MD5 of seed and id) and ranked; row k of
    n has the fractional rank (k + 1/2) / n. All rows sorted by fractional rank interleave the sources in
    proportion, and are cut into shards whose counts differ by one at most. Ranks come from two
    range-partitioned sorts, so a source with most of the rows is spread over many tasks, and only ids,
    sizes and checksums move, never texts.

    Null texts have size 16 and checksum 0; null sources are one source of their own; null ids sort
    first. Repeated rows stay rows, each with a slot of its own. An empty table gives an empty result.
    Other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(stratum_col).alias("source"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("shuffled"),
    )
    rows = staged(rows, "shard-rows")
    ties = ["doc_id", "text_crc32", "size"]
    ranked = staged(numbered(rows, ["source", "shuffled", *ties], "shard-source"), "shard-ranked")
    sources = staged(ranked.groupBy("source").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "stratum"), "shard-sources")
    mixed = ranked.join(sources, ranked.source.eqNullSafe(sources.stratum)).withColumn("fraction", (F.col("position") - F.col("first") + F.lit(0.5)) / F.col("n"))
    mixed = mixed.select("doc_id", "size", "text_crc32", "source", "shuffled", "fraction")
    mixed = numbered(mixed, ["fraction", "shuffled", *ties, "source"], "shard-mixed")
    total = rows.count()
    at = F.col("position")
    number = F.expr(f"cast((position * {shards}) div {max(total, 1)} as int)")
    start = F.expr(f"(cast(shard as bigint) * {max(total, 1)} + {shards - 1}) div {shards}")
    return mixed.withColumn("shard", number).withColumn("slot", at - start).select("doc_id", "size", "text_crc32", "source", "shard", "slot")
