"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.runtime import cut, new_table, shared_dir, ship

__all__ = ["A_TASK", "ROW_KEY", "TASKS", "added", "cut", "few", "hashable", "near_name", "new_table", "packed", "quoted", "row_hash", "row_key", "shared_dir", "ship", "stored"]


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashable(kind: T.DataType) -> bool:
    """Whether Spark can hash and order values of this type."""
    if isinstance(kind, T.ArrayType):
        return hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame, *salt: Column) -> Column:
    """A hash of all that a row holds; where nulls stand counts too."""
    parts = [quoted(f.name) if hashable(f.dataType) else F.to_json(F.struct(quoted(f.name))) for f in df.schema.fields]
    return F.xxhash64(*salt, *parts, *[p.isNull() for p in parts])


#: The type of row_key().
ROW_KEY = "struct<one:bigint,two:bigint>"


def row_key(df: DataFrame) -> Column:
    """128 bits that stand for all that a row holds: two hashes of different seeds, so rows that share one still differ."""
    return F.struct(row_hash(df).alias("one"), row_hash(df, F.lit("two")).alias("two"))


#: Rows of keys up to which a side is broadcast, some 40 bytes each.
FEW = 1_000_000


def few(keys: DataFrame) -> DataFrame:
    """Narrow rows, stored and counted, to be broadcast if they are few; else the join exchanges both sides."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= FEW else keys


#: Narrow rows of one task, and tasks of the fewest rows.
A_TASK, TASKS = 50_000, 8


def packed(df: DataFrame, rows: int, a_task: int = A_TASK) -> DataFrame:
    """df in no more tasks than so many rows are worth, since each task writes files for each exchange."""
    return df.coalesce(max(TASKS, rows // a_task))


def stored(df: DataFrame, a_task: int = A_TASK) -> tuple[DataFrame, int]:
    """df, cut and packed, and how many rows it has."""
    df = cut(df)
    n = df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism).count()
    return packed(df, n, a_task), n


def near_name(taken: list[str], name: str) -> str:
    """name, with as many _ after it as it takes to differ from those taken."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def added(df: DataFrame, read: str, new: str, *steps: Callable[[pa.Array, list[pa.Array]], list[pa.Array]]) -> tuple[DataFrame, list[str]]:
    """df with the columns of schema `new`, and the names they got (changed where df has them).

    Each step takes the column `read` and the new columns as the step before left them (at first null), a batch at a time.
    All other columns travel inside one struct, so their names don't matter.
    """
    ship(df.sparkSession)
    names = list(df.columns)
    rest = [c for c in names if c != read]
    fields = T._parse_datatype_string(new).fields
    packed = df.select(F.struct(*[quoted(c).alias(c) for c in rest] or [F.lit(None).alias("none")]).alias("rest"), quoted(read).alias("text"), *[F.lit(None).cast(f.dataType).alias(f"new{k}") for k, f in enumerate(fields)])
    schema = packed.schema

    def runner(step):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = step(b.column(1), [b.column(2 + k) for k in range(len(fields))])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *got], names=schema.names)

        return run

    for step in steps:
        packed = packed.mapInArrow(runner(step), schema)
    got: list[str] = []
    for f in fields:
        got.append(near_name(names + got, f.name))
    own = [F.col("text").alias(c) if c == read else F.col("rest").getField(c).alias(c) for c in names]
    return packed.select(*own, *[F.col(f"new{k}").alias(n) for k, n in enumerate(got)]), got
