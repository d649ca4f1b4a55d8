"""A BM25 index that is kept up to date: segments of chunks with their counted terms, marks of what is gone, and sums that add up.

An update writes one segment with the new chunks, and marks of the chunks that it replaces or takes away; what was written before stays as it is.
A segment has its chunks, a row each (bm25.counted), in partitions by a hash of the key, in as many files each as it takes to hold A_FILE of them, so replaced
chunks are found without a scan of the others. A search reads each row once and exchanges no postings (bm25.best_rows). Statistics (n, total length, chunks by language, document frequencies) are kept as what each
update adds and takes away, so all searches of a version see the same numbers as an index that is built anew. compact() merges the small segments and drops marks.

A version names its segments and marks, and is committed as in sources.versions: an update that loses the race is worked out again upon the winner.

Cases: of equal keys in one update the last by `ord` stays (null loses); a null key is a key; keys to be deleted that aren't there change nothing; chunks without tokens count
in n; an empty index finds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import bm25, state
from corvane.runtime import cut
from corvane.sources.versions import VersionLog

#: Partitions of a segment's chunks, and chunks in one of their files.
PARTS, A_FILE = 32, 16_000


class Store:
    """The index in a folder. Token tables are those of bm25.token_table()."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts, self.log = spark, path.rstrip("/"), parts, VersionLog(spark, path)

    def version(self) -> dict:
        """The newest version: n, all (tokens), parts, the types of key and ord, segments (name to chunks written) and marks (names)."""
        return self.log.read() or {"version": 0, "n": 0, "all": 0, "parts": self.parts, "key": None, "ord": None, "segments": {}, "marks": []}

    # ---- reading ----

    def _read(self, v: dict, parts: list[int] | None = None) -> DataFrame:
        """Chunks of all segments, with the segment of each; parts: only these partitions."""
        out = None
        for name in v["segments"]:
            rows = self.spark.read.parquet(f"{self.path}/{name}/chunks")
            rows = (rows if parts is None else rows.where(F.col("part").isin(parts))).withColumn("segment", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _marked(self, v: dict) -> DataFrame:
        """(segment, key) of chunks that are gone."""
        paths = [f"{self.path}/{m}/gone" for m in v["marks"]]
        kind = f"segment string, key {v['key']}"
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def _live(self, v: dict, rows: DataFrame) -> DataFrame:
        if not v["marks"]:
            return rows
        gone = self._marked(v).withColumnRenamed("segment", "_s").withColumnRenamed("key", "_k")
        return rows.join(gone, (F.col("segment") == F.col("_s")) & F.col("key").eqNullSafe(F.col("_k")), "left_anti")

    def _sums(self, v: dict, what: str, by: str) -> DataFrame:
        """Counts by a value (`language` or `term`), over all updates."""
        paths = [f"{self.path}/{x}/{what}" for x in (*v["segments"], *v["marks"])]
        rows = self.spark.read.schema(f"{by} string, n long").parquet(*paths) if paths else self.spark.createDataFrame([], f"{by} string, n long")
        return rows.groupBy(by).agg(F.sum("n").alias("n")).where("n > 0")

    def document_frequency(self) -> DataFrame:
        """term, df, of the kept sums."""
        return self._sums(self.version(), "frequencies", "term").withColumnRenamed("n", "df")

    def stats(self) -> tuple[int, float]:
        """n and avgdl."""
        v = self.version()
        return v["n"], v["all"] / v["n"] if v["n"] else 0.0

    def search(self, terms: DataFrame, k: int, by_language: bool = False) -> DataFrame:
        """As bm25.search(), from the stored rows."""
        v = self.version()
        if not v["segments"]:
            return self.spark.createDataFrame([], f"q {terms.schema['q'].dataType.simpleString()}, key string, ord long, score double, rank int")
        rows = self._live(v, self._read(v)).drop("part", "segment")
        n, avgdl = v["n"], v["all"] / v["n"] if v["n"] else 0.0
        df = self._sums(v, "frequencies", "term").withColumnRenamed("n", "df")
        return bm25.best_rows(rows, df, n, float(avgdl), self._sums(v, "languages", "language").select("language"), terms, k, by_language)

    # ---- writing ----

    def _write_segment(self, name: str, rows: DataFrame, parts: int) -> tuple[int, int]:
        """Chunks, and what they add to the sums; n and all."""
        at = f"{self.path}/{name}"
        self._store(rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")), f"{at}/chunks", parts)
        return self._write_sums(at, self.spark.read.parquet(f"{at}/chunks"), 1)

    @staticmethod
    def _store(rows: DataFrame, at: str, parts: int) -> None:
        files = max(1, -(-rows.select("key").count() // (A_FILE * parts)))
        dealt = rows.withColumn("_file", F.pmod(F.xxhash64("key", F.lit("file")), F.lit(files)))
        dealt.repartition(min(parts * files, 10_000), "part", "_file").drop("_file").write.partitionBy("part").parquet(at)

    def _write_sums(self, at: str, chunks: DataFrame, sign: int) -> tuple[int, int]:
        count = F.count(F.lit(1)) * sign
        chunks.groupBy("language").agg(count.alias("n")).coalesce(1).write.parquet(f"{at}/languages")
        chunks.select(F.explode("terms").alias("term")).groupBy("term").agg(count.alias("n")).write.parquet(f"{at}/frequencies")
        got = chunks.agg(count.alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("all")).first()
        return got["n"], got["all"] * sign

    @staticmethod
    def _fresh(tokens: DataFrame) -> DataFrame:
        """Counted rows, of equal keys the last. Only rows whose key is not theirs alone are exchanged."""
        rows = bm25.counted(tokens)
        again = bm25.repeated(tokens, "key")
        if again is None:
            return rows
        last = state.last_wins(bm25._within(rows, again, "key").withColumnRenamed("key", "_key").withColumn("key", F.struct("_key")), "key", "ord").drop("_key").withColumn("key", F.col("key._key"))
        return bm25._without(rows, again, "key").unionByName(last.select(*rows.columns))

    def update(self, tokens: DataFrame | None = None, deleted: DataFrame | None = None, tries: int = 20) -> dict:
        """Adds the chunks of a token table in place of those with their keys, and takes away the keys of `deleted` (key). Returns the new version."""
        if tokens is not None and tokens.select("key").isEmpty():
            tokens = None
        segment, keys = None, []
        if tokens is not None:
            name = f"segment-{uuid.uuid4().hex}"
            parts = self.version()["parts"]  # the same for all versions
            segment = (name, *self._write_segment(name, self._fresh(tokens), parts))
            fresh = self.spark.read.parquet(f"{self.path}/{name}/chunks")
            keys.append(fresh.select("key"))
        if deleted is not None:
            keys.append(deleted.select("key"))
        if not keys:
            return self.version()
        keys = cut((keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])).distinct())
        for _ in range(tries):
            v = self.version()
            new = {**v, "version": v["version"] + 1, "segments": dict(v["segments"]), "marks": list(v["marks"])}
            if segment is not None:
                new["segments"][segment[0]] = segment[1]
                new["n"], new["all"] = new["n"] + segment[1], new["all"] + segment[2]
                new["key"], new["ord"] = (fresh.schema[c].dataType.simpleString() for c in ("key", "ord"))
            if v["segments"]:
                parts = [r[0] for r in keys.select(F.pmod(F.xxhash64("key"), F.lit(v["parts"])).cast("int")).distinct().collect()]
                asked = keys.withColumnRenamed("key", "_asked")
                held = self._read(v, parts).join(asked, F.col("key").eqNullSafe(F.col("_asked")), "left_semi")
                name = f"marks-{uuid.uuid4().hex}"
                at = f"{self.path}/{name}/gone"
                self._live(v, held).select("segment", "key", "language", "dl", "terms").write.parquet(at)
                stale = self.spark.read.parquet(at)
                if not stale.isEmpty():
                    n, all_ = self._write_sums(f"{self.path}/{name}", stale, -1)
                    new["marks"].append(name)
                    new["n"], new["all"] = new["n"] + n, new["all"] + all_
            if new["segments"] == v["segments"] and new["marks"] == v["marks"]:
                return v
            if self.log.commit(new["version"], new):
                return new
        raise RuntimeError(f"other writers came first {tries} times")

    def compact(self, below: int | None = None) -> dict:
        """Merges segments of fewer than `below` chunks (all of them by default) into one, without what is gone. Returns the new version; the old files stay for searches under way."""
        for _ in range(20):
            v = self.version()
            small = {s: n for s, n in v["segments"].items() if below is None or n < below}
            if len(small) < 2 and not (small and v["marks"]):
                return v
            name, own = f"segment-{uuid.uuid4().hex}", {**v, "segments": small}
            at = f"{self.path}/{name}"
            self._store(self._live(v, self._read(own)).drop("segment"), f"{at}/chunks", v["parts"])
            n, _ = self._write_sums(at, self.spark.read.parquet(f"{at}/chunks"), 1)
            rest = {s: c for s, c in v["segments"].items() if s not in small}
            new = {**v, "version": v["version"] + 1, "segments": {**rest, name: n}, "marks": []}
            if rest:  # marks of segments that stay, with what they take away
                gone = cut(self._marked(v).where(F.col("segment").isin(list(rest))))
                if not gone.isEmpty():
                    marks = f"marks-{uuid.uuid4().hex}"
                    gone.write.parquet(f"{self.path}/{marks}/gone")
                    own = self._read({**v, "segments": rest})
                    lost = own.join(gone.toDF("_s", "_k"), (F.col("segment") == F.col("_s")) & F.col("key").eqNullSafe(F.col("_k")), "left_semi")
                    self._write_sums(f"{self.path}/{marks}", lost, -1)
                    new["marks"] = [marks]
            if self.log.commit(new["version"], new):
                return new
        raise RuntimeError("other writers came first 20 times")

    def rebuild(self, tokens: DataFrame) -> dict:
        """All of the index anew from a token table, as one version."""
        fresh = self._fresh(tokens)
        for _ in range(20):
            v = self.version()
            name = f"segment-{uuid.uuid4().hex}"
            n, all_ = self._write_segment(name, fresh, v["parts"])
            new = {**v, "version": v["version"] + 1, "n": n, "all": all_, "segments": {name: n}, "marks": [], "key": fresh.schema["key"].dataType.simpleString(), "ord": fresh.schema["ord"].dataType.simpleString()}
            if self.log.commit(new["version"], new):
                return new
        raise RuntimeError("other writers came first 20 times")
