"""What operators ask of a session: shared storage, stored cuts of lineage, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to a Python worker at once. Rows hold whole texts, so counting them bounds nothing.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that setting is missing and the master is local is a folder of this machine taken.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if not told and now.isDefined():
        told = now.get()
    if not told:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder that all its executors share")
        told = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", told)
    if not now.isDefined():
        sc.setCheckpointDir(told)
    return told


def cut(df: DataFrame) -> DataFrame:
    """df, computed and stored in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_table(spark: SparkSession, what: str) -> str:
    """A path for one table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/corvane/{what}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends the package's code to the executors, once for each context, and bounds the batches sent to Python."""
    if int(spark.conf.get(BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="corvane-code-"), "corvane_code.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(to)
    sc._corvane_shipped = True


def widen(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt out over all cores where it has fewer parts than these, as a small file of one row group has."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= n else scan.repartition(n)


def version_of(spark: SparkSession, path: str) -> str:
    """What the files of a table are now: a digest of their names, lengths and times of change. A table that is written again has another."""
    import hashlib

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while listed.hasNext():
        f = listed.next()
        found.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
