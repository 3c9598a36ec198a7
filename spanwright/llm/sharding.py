"""Contiguous shards of balanced bytes.

Rows are range-partitioned and sorted by doc_id. Each partition's totals, one row a partition, give every partition
its offset; within it a running sum gives every row its place in the global byte sequence, which is cut at equal
targets. Only (doc_id, size, checksum) move; texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.common import settled


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs(doc_id, text), repeated rows included.

    size is the text's UTF-8 bytes (null: none) plus 1; text_crc32 its unsigned CRC-32 (null: of no bytes). In the
    order of doc_id (null first; ties by checksum and size) a row whose bytes begin at b of B goes to shard
    floor(b * shards / B), so shards are contiguous and differ from B / shards by less than one row's size at either end.
    slot counts a shard's rows from 0 in that order. Other columns are ignored; an empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()  # a row a partition
    offsets, at_byte, at_row = [], 0, 0
    for t in totals:
        offsets.append((t["part"], at_byte, at_row))
        at_byte, at_row = at_byte + t["bytes"], at_row + t["rows"]
    starts = docs.sparkSession.createDataFrame(offsets, "part int, byte_offset long, row_offset long")
    run = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumns({"byte_end": F.sum("size").over(run), "row_end": F.row_number().over(Window.partitionBy("part").orderBy(*order))})
    ranked = ranked.join(F.broadcast(starts), "part")
    begin = F.col("byte_offset") + F.col("byte_end") - F.col("size")
    shard = F.expr(f"cast(cast(({shards} * cast(b as decimal(30, 0))) as decimal(38, 0)) div {max(at_byte, 1)} as int)")
    ranked = settled(ranked.withColumn("b", begin).withColumn("shard", shard).withColumn("rank", F.col("row_offset") + F.col("row_end") - 1).select("doc_id", "size", "text_crc32", "shard", "rank"))
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))
