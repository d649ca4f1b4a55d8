"""Change detection and keyed storage across runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(now: DataFrame, before: DataFrame, key: str, hash: str) -> DataFrame:
    """key, hash, status: new, changed, unchanged; and, beyond what the next state needs, deleted."""
    a = now.select(F.col(key), F.col(hash).alias("_now"))
    b = before.select(F.col(key), F.col(hash).alias("_before"))
    both = a.join(b, key, "full")
    status = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_now") == F.col("_before"), "unchanged").otherwise("changed")
    return both.select(key, F.coalesce("_now", "_before").alias(hash), status.alias("status"))


def report(changed: DataFrame) -> DataFrame:
    return changed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the one greatest in `order`; a null order loses to all others. Combined within tasks first, so copies of one key don't meet."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), F.col(order))).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with new's rows in place of those of the same key; of new's repeats the last wins. Null keys are one key."""
    fresh = last_wins(new, key, order)
    return old.join(fresh.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(fresh)


def is_complete(chunks: DataFrame, stored: DataFrame, key: str) -> Column:
    """Whether every key of chunks is stored: the correct form of comparing counts."""
    return chunks.select(key).distinct().join(stored.select(key), key, "left_anti").agg((F.count(F.lit(1)) == 0).alias("complete"))


def checked_vectors(rows: DataFrame, vector: str, dimension: int) -> DataFrame:
    """rows; a vector of another length raises when it is read."""
    return rows.withColumn(vector, F.when(F.size(vector) == dimension, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"a vector must have {dimension} numbers, not "), F.size(vector).cast("string")))))
