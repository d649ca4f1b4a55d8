"""Near-duplicates by one-permutation hashing: links at a Jaccard similarity of 85 % or more over 5-word shingles.

Each set of shingles is hashed once into BINS bins, of which the smallest hash is kept; an empty bin takes that of the first filled one
in an order of its own (optimal densification), so each bin of two sets agrees with the probability of their similarity, however small they
are. Bands of ROWS bins are keys; sets that share a key meet in a bucket. With 40 bands of 6 bins a pair at 85 % shares none with a
probability of 6 in 10^9.

Equal sets are one from the start, told by 128 bits. Buckets give stars, not pairs: at first each set is compared with one hub, the first by
hash of those in its buckets; then, in buckets that still hold several components, all with their bucket's hub; only what isn't connected
after that is compared within its bucket, by sizes and bitmaps (shingle_links.pairs_in_sorted), and what these leave by the full sets. A bucket of
more than LARGE sets is parted by the other keys of its sets before: similar sets share two keys or more but with a probability of 2 in 10^7. So no
bucket's pairs go out, and no component needs more links than hold it together.

All links are confirmed on full sets, made anew from their texts. The texts of a hub's partners are dealt to tasks by PARTNERS, each with the hub's.

Cases: texts with fewer words than a shingle are one shingle; null, empty and wordless texts have no set and are linked with nothing; a null id is
no component's id unless its component has no other; such a row is kept where its component's id is null, too; equal ids and repeated rows
all stay; an empty table gives no rows; clashing columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingle_links, simhash
from .common import ROW_KEY, cut, few, quoted, row_key, ship
from .components import connected_components

WIDTH, SHARE, OF = 5, 85, 100
BANDS, ROWS, SEED = 40, 6, 11
BINS = BANDS * ROWS
#: Sets of a bucket from which it is parted by other keys, and how often; partners of a hub in one task.
LARGE, DEPTH, PARTNERS = 20_000, 3, 2_000
#: Sets that a task remembers having given keys for.
SEEN = 500_000


class Signatures:
    """Band keys of sets of hashed shingles. One for each task."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        #: For each bin the order in which it asks all others, the same for all sets.
        self.asks = rng.permuted(np.tile(np.arange(self.bins, dtype=np.int16), (self.bins, 1)), axis=1)
        self.mix = rng.integers(0, 1 << 63, (2, self.bins), np.uint64) * np.uint64(2) + np.uint64(1)

    def bins_of(self, found: np.ndarray) -> np.ndarray:
        """The value of each bin; found is sorted, distinct and not empty."""
        x = np.sort((found ^ found >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93))  # apart from the hashes' own order
        of = ((x >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        value, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        value[of[first].astype(np.int64)], full[of[first].astype(np.int64)] = x[first], True
        out, empty = value.copy(), np.flatnonzero(~full)
        for k in range(0, self.bins, 16):
            if not len(empty):
                break
            asked = self.asks[empty, k : k + 16]
            hit = full[asked]
            some = hit.any(axis=1)
            out[empty[some]] = value[asked[some, hit[some].argmax(axis=1)]]
            empty = empty[~some]
        return out

    def keys(self, found: np.ndarray) -> np.ndarray:
        """One key for each band, different for different bands."""
        x = self.bins_of(found)
        x = (x ^ x >> np.uint64(29)) * self.mix[0]
        x = ((x ^ x >> np.uint64(32)) * self.mix[1]).reshape(self.bands, self.rows).sum(axis=1, dtype=np.uint64)
        return (x ^ x >> np.uint64(31)).view(np.int64)


def _marks(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, row, n, and of texts with a word one and two (128 bits of the set); bits and keys where a task sees the set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signatures, seen = shingle_links.Shingles(width), Signatures(), set()
        for b in batches:
            n, one, two, bits, keys = [], [], [], [], []
            for x in b.column(1):
                found = shingles.of(simhash.words_of(x.as_py()))
                raw = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                n.append(len(found))
                one.append(raw and int.from_bytes(raw[:8], "little", signed=True))
                two.append(raw and int.from_bytes(raw[8:], "little", signed=True))
                new = raw is not None and raw not in seen
                if new and len(seen) < SEEN:
                    seen.add(raw)
                bits.append(shingle_links.bitmap(found) if new else None)
                keys.append(signatures.keys(found) if new else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(v, pa.int64()) for v in (n, one, two)), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "n", "one", "two", "bits", "keys"])

    read = docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text"), row_key(docs).alias("row"))
    return read.mapInArrow(run, f"doc_id long, row {ROW_KEY}, n long, one long, two long, bits binary, keys array<bigint>")


def _compared(width: int, share: int, of: int):
    """Rows (a, part, b, text) sorted by all but the text, with b null in a hub's own; gives the links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, at, hub = shingle_links.Shingles(width), None, None
        for r in batches:
            a, part, b = (r.column(k).to_pylist() for k in range(3))
            ok = []
            for k in range(r.num_rows):
                found = shingles.of(simhash.words_of(r.column(3)[k].as_py()))
                if b[k] is None:
                    at, hub = (a[k], part[k]), found
                    ok.append(False)
                    continue
                if at != (a[k], part[k]):
                    raise RuntimeError("partners came before their hub")
                shared = len(np.intersect1d(hub, found, assume_unique=True))
                ok.append(of * shared >= share * (len(hub) + len(found) - shared))
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(2)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _met(least: float):
    """Rows (h, lo, hi, sid, root, at, block, plain, bits, keys) sorted by (h, lo, hi, at); gives pairs that can be similar.

    Similar sets meet in many buckets. A pair goes out in the bucket of the first key that both sets have, and there only; in buckets that
    were parted (plain is false) wherever it meets.
    """

    def out(parts) -> Iterator[pa.RecordBatch]:
        *columns, bits, keys = zip(*parts, strict=True)
        h, lo, hi, sid, root, at, block, plain = map(np.concatenate, columns)
        bits, keys = [x for part in bits for x in part], np.concatenate(keys)
        group = np.concatenate([[0], np.cumsum((h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))])
        side = np.where(lo == hi, 0, np.where(block == lo, 1, 2))
        for some in (plain, ~plain):
            k = np.flatnonzero(some)
            if not len(k):
                continue
            order = k[np.argsort(sid[k], kind="stable")]
            buckets = np.unique(h[k])
            for got in shingle_links.pairs_in_sorted(group[k], sid[k], root[k], at[k], side[k], [bits[i] for i in k.tolist()], least):
                got = np.unique(np.sort(got, axis=1), axis=0)
                if some is plain:
                    x, y = (keys[order[np.searchsorted(sid[order], got[:, e])]] for e in (0, 1))
                    first = x[np.arange(len(x)), (x == y).argmax(axis=1)]
                    got = got[np.isin(first, buckets)]
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            c = (*(b.column(k).to_numpy(zero_copy_only=False) for k in range(8)), b.column(8).to_pylist(), b.column(9).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            last = int(((c[0] == c[0][-1]) & (c[1] == c[1][-1]) & (c[2] == c[2][-1])).argmax())
            if last or held and any(held[0][k][0] != c[k][0] for k in range(3)):
                yield from out([*held, tuple(x[:last] for x in c)])
                held = []
            held.append(tuple(x[last:] for x in c))
        if held:
            yield from out(held)

    return run


class Links:
    """Links among distinct sets: sets (set, row, n, bits, keys), and the documents that hold them."""

    def __init__(self, docs: DataFrame, sets: DataFrame, text: str, width: int, share: int, of: int):
        self.sets, self.width, self.share, self.of, self.least = sets, width, share, of, share / of
        self.keyed = docs.select(quoted(text).alias("text"), row_key(docs).alias("row"))
        self.found: list[DataFrame] = []

    def confirm(self, pairs: DataFrame) -> None:
        """Compares the sets of pairs (a, b), b each with the hub a, and keeps the links."""
        about = self.sets.select("set", "n", "bits")
        s, t = about.toDF("s", "n", "x"), about.toDF("t", "m", "y")
        fit = pairs.where("a <> b").distinct().join(s, F.col("a") == F.col("s")).join(t, F.col("b") == F.col("t"))
        fit = fit.where((F.least("n", "m") * self.of >= F.greatest("n", "m") * self.share)).select("s", "n", "x", "t", "m", "y")
        fit = cut(fit.mapInArrow(shingle_links._bits_agree(self.least), "s long, t long"))
        wanted = fit.select(F.col("s").alias("set")).union(fit.select("t")).distinct()
        texts = cut(self.keyed.join(few(self.sets.select("set", "row").join(wanted, "set")), "row").groupBy("set").agg(F.first("text").alias("text")))
        parts = F.pmod(F.xxhash64("b"), "parts").cast("int")
        hubs = cut(fit.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))).withColumnRenamed("s", "a")
        partners = fit.toDF("a", "b").join(hubs, "a").select("a", parts.alias("part"), "b").join(texts.toDF("b", "text"), "b").select("a", "part", "b", "text")
        own = hubs.join(texts.toDF("a", "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
        rows = own.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        self.found.append(cut(rows.mapInArrow(_compared(self.width, self.share, self.of), "a long, b long")))

    def all(self) -> DataFrame:
        out = self.found[0]
        for more in self.found[1:]:
            out = out.unionByName(more)
        return out

    def roots(self) -> DataFrame:
        """set and root of the sets that have a link."""
        return cut(connected_components(self.all())).toDF("set", "root")

    def rooted(self, buckets: DataFrame) -> DataFrame:
        """Rows (key, set) of buckets that hold several components, with the root of each."""
        named = cut(buckets.select("key", "set").join(self.roots(), "set", "left").select("key", "set", F.coalesce("root", "set").alias("root")))
        open_ = named.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("rows")).where("r1 <> r2")
        return cut(named.join(open_.select("key", "rows"), "key"))


def _hub() -> tuple:
    """The order in which sets of a bucket become its hub."""
    return F.xxhash64("set"), F.col("set")


def links(docs: DataFrame, sets: DataFrame, text: str = "text", width: int = WIDTH, share: int = SHARE, of: int = OF) -> DataFrame:
    """Links (a, b) of sets, enough of them to connect all that similar sets connect."""
    out = Links(docs, sets, text, width, share, of)
    every = sets.select("set", F.explode("keys").alias("key"))
    hubs = cut(every.groupBy("key").agg(F.min(F.struct(*_hub())).alias("hub"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key", F.col("hub.set").alias("hub")))
    buckets = cut(every.join(hubs, "key"))
    # one hub for each set
    first = buckets.where("set <> hub").groupBy("set").agg(F.min(F.struct(F.xxhash64("hub").alias("h"), "hub")).alias("x")).select(F.col("x.hub").alias("a"), F.col("set").alias("b"))
    tried = cut(first)
    out.confirm(tried)
    # the hub of each bucket with all of other components
    rooted = out.rooted(buckets)
    star = rooted.join(hubs, "key").join(out.roots().toDF("hub", "hub_root"), "hub", "left").where(F.col("root") != F.coalesce("hub_root", "hub"))
    star = cut(star.select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    out.confirm(star)
    # what is left, without the hubs, which have met all others
    rest = out.rooted(rooted.join(hubs, "key").where("set <> hub")).withColumn("plain", F.lit(True))
    for _ in range(DEPTH):
        large = rest.where(F.col("rows") > LARGE)
        if large.isEmpty():
            break
        parted = large.join(sets.select("set", "keys"), "set").select("set", "key", F.explode("keys").alias("other")).where("key <> other")
        parted = out.rooted(parted.select("set", F.xxhash64("key", "other").alias("key"))).withColumn("plain", F.lit(False))
        rest = cut(rest.where(F.col("rows") <= LARGE).unionByName(parted))
    blocks = rest.withColumn("blocks", F.ceil(F.col("rows") / LARGE).cast("int")).withColumn("block", F.pmod(F.xxhash64("set"), "blocks").cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select(F.col("key").alias("h"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "set", "root", "block", "plain")
    blocks = blocks.join(sets.select("set", "n", "bits", "keys"), "set").select("h", "lo", "hi", F.col("set").alias("sid"), "root", F.shiftleft("n", 32).alias("at"), "block", "plain", "bits", "keys")
    pairs = blocks.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi", "at").mapInArrow(_met(out.least), "a long, b long")
    out.confirm(cut(pairs.distinct()))
    return out.all()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, share: int = SHARE, of: int = OF) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included) and kept of every row."""
    ship(docs.sparkSession)
    marks = cut(_marks(docs, key, text, width))
    sets = marks.where("n > 0").groupBy("one", "two").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"), F.first("keys", ignorenulls=True).alias("keys"))
    sets = cut(sets.withColumn("set", F.monotonically_increasing_id()))
    roots = cut(connected_components(links(docs, sets, text, width, share, of))).toDF("set", "root")
    least = cut(marks.where("n > 0").groupBy("one", "two").agg(F.min("doc_id").alias("least")))
    named = sets.select("one", "two", "set").join(roots, "set", "left").join(least, ["one", "two"]).select("one", "two", F.coalesce("root", "set").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = marks.join(few(named.join(ids, "root").select("one", "two", "component_id")), ["one", "two"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_OP11 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i : i + {WIDTH - 1}], ' '))) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
x AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE {OF} * c >= {SHARE} * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON t.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = n.doc_id
"""
