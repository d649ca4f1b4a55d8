"""Two-pass external shuffle into shards, by DataFrame functions alone.

Pass one scatters the records by a seeded hash of their content over buckets of a bounded number of
bytes (Spark's exchange is the external store). Pass two holds one bucket in memory, puts it into a
fixed order and permutes it by the built-in shuffle(), an inside-out Fisher-Yates. The buckets, one
after the other, are a random order of all records; the shards are cut from it so that their row
counts differ by one at most (law "rows").

Cases: a null text has size 16 and the checksum of no bytes; null ids, repeated ids and repeated rows
are ordinary records and each gets a slot of its own; an empty table gives no rows; columns of any name
travel inside one struct, so no name can clash. A text larger than a bucket makes that bucket larger.
Records that are equal in every column and would fill a quarter of a bucket are held once, with their
number, and their copies are scattered like other records.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, few, hashable, new_table, quoted

#: Bytes that one bucket may hold in a task's memory.
BUCKET_BYTES = 32 << 20
OVERHEAD = 16
#: Rows that are equal in every column are hot if they fill more than this part of a bucket; so many of their copies are made at once.
HOT, COPIES = 4, 4096
#: Buckets whose offsets are summed in one group.
FAN = 1024


def _expanded(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row n times, with h salted by the copy's number; dealt out in blocks of COPIES, so that no task makes all copies of one."""
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("h", "block")
    first = F.col("block") * COPIES
    copies = blocks.withColumn("copy", F.explode(F.sequence(first, F.least(first + F.lit(COPIES), F.col("n")) - 1)))
    return copies.select(F.xxhash64("h", "copy").alias("h"), *columns)


def shuffle_shards(docs: DataFrame, shards: int = 40, seed: int = 17, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of docs as struct `record`, with `size`, `shard` and `slot`, in seeded random order."""
    keys = [quoted(f.name) for f in docs.schema.fields if hashable(f.dataType)]
    rows = docs.select(
        F.xxhash64(F.lit(seed), *keys).alias("h"),
        (F.coalesce(F.octet_length(quoted(text)), F.lit(0)).cast("long") + F.lit(OVERHEAD)).alias("size"),
        F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("record"),
    )
    # one scan counts; totals, hot rows and the buckets' sizes come from its narrow result
    counted = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("bytes").alias("most")).first()
    buckets = max(shards, math.ceil(total["bytes"] / bucket_bytes))
    hot = F.col("bytes") > bucket_bytes // HOT
    sizes = counted.where(~hot).select("h", "n")
    if (total["most"] or 0) > bucket_bytes // HOT:
        # copies are alike, so each text is held once with their number, and its copies are scattered by their numbers
        names = few(counted.where(hot).select("h"))
        held = rows.join(names, "h", "left_semi").withColumn("tie", F.to_json("record"))
        held = cut(held.groupBy("h", "tie").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("record").alias("record")))
        rows = rows.join(names, "h", "left_anti").unionByName(_expanded(held, "size", "record"))
        sizes = sizes.unionByName(_expanded(held.select("h", "n")).select("h", F.lit(1).cast("long").alias("n")))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("h")), F.lit(buckets)).cast("int").alias("bucket")
    # where each bucket begins: sums within groups of FAN buckets, and over the groups
    counts = sizes.select(bucket, "n").groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("part", (F.col("bucket") / FAN).cast("int"))
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    starts = counts.join(parts, "part").select("bucket", (F.col("before") + F.sum("n").over(W.partitionBy("part").orderBy("bucket")) - F.col("n")).alias("start"))
    ordered = all(hashable(f.dataType) for f in docs.schema.fields)
    item = F.struct("h", "size", "record") if ordered else F.struct("h", "size", F.to_json("record").alias("tie"), "record")
    held = rows.select("*", bucket).repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.collect_list(item).alias("items"))
    if not ordered:
        held = held.withColumn("items", F.array_sort("items", lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0)))
    else:
        held = held.withColumn("items", F.array_sort("items"))
    # a task holds one bucket, and the generator of shuffle() depends on the seed and the task's number
    mixed = held.select("bucket", F.shuffle("items", seed=seed).alias("items"))
    out = mixed.join(few(starts), "bucket").select("start", F.posexplode("items").alias("at", "item"))
    rank = F.col("start") + F.col("at")
    shard = F.expr(f"((start + at + 1) * {shards} - 1) div {max(1, total['n'])}")
    return out.select(
        F.col("item.record").alias("record"),
        F.col("item.size").alias("size"),
        shard.cast("int").alias("shard"),
        rank.alias("rank"),
    ).select("record", "size", "shard", (F.col("rank") - F.expr(f"(cast(shard as bigint) * {max(1, total['n'])}) div {shards}")).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; every file of it holds rising slots, as many files as tasks that held buckets of the shard."""
    flat = sharded.select("record", "size", "slot", "shard")
    flat.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """What write_shards() has written of docs' rows; no rows where these were none."""
    schema = T.StructType().add("record", docs.schema).add("size", "long").add("slot", "long").add("shard", "integer")
    return spark.read.schema(schema).parquet(path)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_table(spark, "shards")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_shards(shuffle_shards(docs), at)
    return read_shards(spark, at, docs).select(
        F.col("record.doc_id").alias("doc_id"),
        F.col("size"),
        F.coalesce(F.crc32(F.col("record.text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard"),
        F.col("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
