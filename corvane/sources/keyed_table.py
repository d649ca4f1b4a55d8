"""A table by key in partitions of the key's hash, with versions that are committed as a whole.

A merge reads and writes only the partitions that its keys fall into. A version is one manifest file: which data files make up each partition,
and how far each source of batches has come. It is committed by renaming it to the next number, which fails if that is taken: of two writers one
goes on, and the other takes its own files over if the first touched other partitions, else merges again. Data files are never changed, so readers keep
the version that they have read until expire() takes it away.

Of the rows of one key, stored or new, the one with the greatest order wins, so a merge that comes again, or late, changes nothing; between equal ones the new
row wins. A row whose order is null loses to all others. Null keys are one key. A row whose `deleted` is true hides its key, and stays as a mark until compact(), so that older rows don't come back.

The folder must be on a file system whose rename doesn't replace (HDFS, say). On local folders, which are for tests, that is two steps and
held together by a lock of the process.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .versions import VersionLog

PART, DELETED = "_part", "_deleted"
#: Partitions of a new table.
PARTS = 64


@dataclass(frozen=True)
class Manifest:
    """One version: its number, the partitions' files, the columns, and by source of batches the last one that is in."""

    n: int
    parts: int
    key: str
    order: str
    by: str
    columns: str
    files: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class KeyedTable:
    """The table in a folder. The first merge makes it.

    by: another column to part the rows by, where it follows from the key (a chunk's URL, say), so rows can be found by it.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS, by: str | None = None):
        self.spark, self.path, self.parts, self.by = spark, path.rstrip("/"), parts, by
        self._log = VersionLog(spark, path)

    def versions(self) -> list[int]:
        """The numbers of all versions that are there, in order."""
        return self._log.versions()

    def manifest(self, n: int | None = None) -> Manifest | None:
        """A version, the newest by default; None before the first."""
        told = self._log.read(n)
        return None if told is None else Manifest(**told)

    def _commit(self, m: Manifest) -> bool:
        return self._log.commit(m.n, m.__dict__)

    # ---- rows ----

    def _rows(self, m: Manifest, parts: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m.columns))
        files = [f for p, fs in m.files.items() if parts is None or int(p) in parts for f in fs]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files]) if files else self.spark.createDataFrame([], schema)

    def read(self, n: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest by default, without deleted keys; None before the first."""
        m = self.manifest(n)
        return None if m is None else self._rows(m).where(~F.col(DELETED)).drop(DELETED)

    def rows_of(self, values: DataFrame) -> DataFrame | None:
        """The rows that have a value (the only column of a DataFrame) in the column that the table is parted by; only their partitions are read."""
        m = self.manifest()
        if m is None:
            return None
        own = values.toDF("_value").distinct()
        parts = [r[0] for r in own.select(self._part("_value", m.parts)).distinct().collect()]  # numbers below m.parts
        return self._rows(m, parts).where(~F.col(DELETED)).drop(DELETED).join(own, F.col(m.by).eqNullSafe(F.col("_value")), "left_semi")

    def lookup(self, keys: list) -> DataFrame | None:
        """The rows of a few keys, from their partitions only; for tables parted by their key."""
        m = self.manifest()
        if m is None:
            return None
        if m.by != m.key:
            raise ValueError(f"the table is parted by {m.by}")
        kind = T.StructType.fromJson(json.loads(m.columns))[m.key].dataType
        return self.rows_of(self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(m.key, kind)])))

    @staticmethod
    def _part(key: str, parts: int):
        return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")

    def _merged(self, old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
        """One row for each key of both: the greatest in order, the new one among equals. Copies are combined within tasks first."""
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        rest = [c for c in old.columns if c != key]
        place = F.struct(F.col(order).isNotNull(), F.col(order), F.col("_new"))
        won = both.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), place).alias("_r"))
        return won.select(key, *[F.col("_r").getField(c).alias(c) for c in rest]).select(*old.columns)

    def _write(self, rows: DataFrame, by: str, parts: int, touched: list[int]) -> dict[str, list[str]]:
        """Writes rows as files of their partitions; the files of each, by name under the table's folder."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn(PART, self._part(by, parts)).repartition(min(parts, max(1, len(touched))), PART).write.partitionBy(PART).parquet(f"{self.path}/{name}")
        fs, found = self._log.fs(), {str(p): [] for p in touched}
        for p in touched:
            at = self._log.at(f"{name}/{PART}={p}")
            if fs.exists(at):
                found[str(p)] = sorted(f"{name}/{PART}={p}/{f.getPath().getName()}" for f in fs.listStatus(at) if f.getPath().getName().endswith(".parquet"))
        return found

    def merge(self, new: DataFrame, key: str, order: str, deleted: str | None = None, batch: tuple[str, int] | None = None, tries: int = 20) -> Manifest:
        """Merges rows by key and returns the version that holds them.

        deleted: a boolean column of new that says which keys go. batch: (source, number); one that isn't above the last of its source is in already, and nothing is done.
        """
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        rows = new.withColumn(DELETED, gone)
        if deleted:
            rows = rows.drop(deleted)
        made: tuple[Manifest | None, list[int], dict[str, list[str]]] | None = None
        for _ in range(tries):
            now = self.manifest()
            if now is not None and batch is not None and now.batches.get(batch[0], -1) >= batch[1]:
                return now
            if now is None:
                base = Manifest(0, self.parts, key, order, self.by or key, json.dumps(T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]).jsonValue()))
            else:
                base = now
                if (now.key, now.order) != (key, order):
                    raise ValueError(f"the table is by {now.key} in order of {now.order}")
            schema = T.StructType.fromJson(json.loads(base.columns))
            if sorted((f.name, f.dataType.simpleString()) for f in schema) != sorted((f.name, f.dataType.simpleString()) for f in rows.schema):
                raise ValueError(f"columns must be {schema.simpleString()}, not {rows.schema.simpleString()}")
            if made is None or any(base.files.get(str(p), []) != (made[0].files.get(str(p), []) if made[0] else []) for p in made[1]):
                touched = sorted(r[0] for r in rows.select(self._part(base.by, base.parts)).distinct().collect())
                merged = self._merged(self._rows(base, touched), rows.select(*schema.names), key, order)
                made = (base, touched, self._write(merged, base.by, base.parts, touched))
            next_ = replace(base, n=base.n + 1, files=base.files | made[2], batches=base.batches | ({batch[0]: batch[1]} if batch else {}))
            if self._commit(next_):
                return next_
        raise RuntimeError(f"other writers came first {tries} times")

    def delete(self, keys: DataFrame, order) -> Manifest | None:
        """Hides keys (a DataFrame that has the key column, and the one that the table is parted by) unless they have rows of a greater order; order is a literal value."""
        m = self.manifest()
        if m is None:
            return None
        schema = T.StructType.fromJson(json.loads(m.columns))
        marks = keys.select(*dict.fromkeys([m.key, m.by])).distinct()
        for f in schema:
            if f.name not in (m.key, m.by, DELETED):
                marks = marks.withColumn(f.name, (F.lit(order) if f.name == m.order else F.lit(None)).cast(f.dataType))
        return self.merge(marks.withColumn("_gone", F.lit(True)), m.key, m.order, deleted="_gone")

    def compact(self) -> Manifest | None:
        """Takes out the marks of deleted keys. From then on older rows of these keys would count again."""
        for _ in range(20):
            m = self.manifest()
            if m is None:
                return None
            parts = sorted(map(int, m.files))
            made = self._write(self._rows(m).where(~F.col(DELETED)), m.by, m.parts, parts)
            if self._commit(next_ := replace(m, n=m.n + 1, files=made)):
                return next_
        raise RuntimeError("other writers came first 20 times")

    def expire(self, keep: int = 2) -> int:
        """Takes away all but the last `keep` versions and the files that only they had; returns how many versions went.

        Files of merges that are under way are in no version yet: run it when none is, or where they can be told to begin again.
        """
        there = self.versions()
        old, stay = there[: -keep or None] if keep else [], there[-keep:]
        if not old:
            return 0
        held = {f for n in stay for fs in self.manifest(n).files.values() for f in fs}
        lost = {f for n in old for fs in self.manifest(n).files.values() for f in fs} - held
        fs = self._log.fs()
        for n in old:
            fs.delete(self._log.at(f"manifests/{n:012d}.json"), False)
        for f in sorted(lost):
            fs.delete(self._log.at(f), False)
        return len(old)


def merge_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, deleted: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Merges all batches of a stream that are there; one that is repeated after a failure changes nothing. prepare: what to make of a batch first."""

    def each(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        KeyedTable(batch.sparkSession, path).merge(rows, key, order, deleted, (checkpoint, number))

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
