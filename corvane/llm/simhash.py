"""Near-duplicates by SimHash; candidates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last filled up with zeros). The
binary Golay code (23, 12, 7) is perfect: every 23-bit word lies within 3 bits of exactly one codeword,
its centre. If two words differ in at most one bit, the centre of either lies within 4 bits of the
other. So the keys of a word are the indices of the codewords within 4 bits: one, or six if its centre
is 3 bits away. Fingerprints at 3 or fewer differing bits (pigeonhole over three segments) either
agree in some segment and differ in at most one bit of another, or differ in exactly one bit of each.
Keys for the first case: a whole segment with the centre or the keys of another; for the second: the
centre and keys of the segments and their parities. Equal keys bring fingerprints together, which are
verified bit by bit.

Copies share a fingerprint and are reduced to one row before anything is matched. Where many different
fingerprints share a key, they are not paired off: a search from one to the next emits a spanning forest
of the verified links, so no group emits more rows than it has members (small groups of up to 16: all links).

Cases: null and empty texts and texts of white space have fingerprint zero and are linked with each
other like any equal fingerprints; null ids never become a component's id unless no id is known; repeated
rows share a component; an empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, cut, few, near_name, packed, quoted, row_key, ship, stored
from .components import connected_components

SEED, SHINGLE, BITS = 42, 3, 3
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
POLYNOMIAL = 0b110001110101
#: Within a key, groups up to this many give all their links; larger ones a spanning forest. Above WHOLE they are split by further keys.
SMALL, WHOLE = 16, 2_000
#: Fingerprints that one task gives their keys, some 60 each.
A_TASK = 50_000

# ---- fingerprints ----

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased text's words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """A hash of each of the word shingles, repeats included; none where there is no word."""
    n = len(words) - width + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of the lower-cased text's word shingles, repeats included; 0 where there is no word."""
    return fingerprint_of(shingle_hashes(words_of(text), width))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, fp): row stands for all that a row holds, fp the unsigned 64 bits as a long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "row", "fp"])

    return docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text"), row_key(docs).alias("row")).mapInArrow(run, f"doc_id long, row {ROW_KEY}, fp long")


# ---- Golay keys ----


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words as polynomials by the generator."""
    x = x.copy()
    for i in range(22, 10, -1):
        x ^= np.where(x >> i & 1, POLYNOMIAL << (i - 11), 0).astype(x.dtype)
    return x


def _patterns() -> np.ndarray:
    """For each of the 2048 remainders, the error patterns of up to 4 bits that have it: column 0 is the lightest."""
    ones = 1 << np.arange(23, dtype=np.int64)
    bit = _syndrome(ones)
    table = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = int(np.bitwise_xor.reduce(bit[list(at)])) if at else 0
            if weight < 4 or table[s, 0] >= 0 and int(table[s, 0]).bit_count() == 3:
                table[s, filled[s]] = sum(1 << i for i in at)
                filled[s] += 1
    return table


class Golay:
    """Keys of 23-bit words; built once for each worker."""

    def __init__(self):
        self.patterns = _patterns()
        low, high = _syndrome(np.arange(1 << 12, dtype=np.int64)), _syndrome(np.arange(1 << 11, dtype=np.int64) << 12)
        self.low, self.high = low, high

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(n, 6): indices of the codewords within 4 bits; column 0 is the centre's, -1 stands for none."""
        p = self.patterns[self.low[words & 0xFFF] ^ self.high[words >> 12]]
        return np.where(p >= 0, (words[:, None] ^ p) >> 11, -1)


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each key of each fingerprint (uint64)."""
    fps = fps.astype(np.uint64)
    seg = [(fps & np.uint64((1 << 23) - 1)).astype(np.int64), (fps >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64), (fps >> np.uint64(46)).astype(np.int64)]
    near = [golay().keys(s) for s in seg]
    n, rows, keys = len(fps), [], []
    row = np.arange(n)

    def add(tag: int, parts: np.ndarray, good: np.ndarray) -> None:
        keys.append((parts << 3 | tag)[good])
        rows.append(np.broadcast_to(row.reshape((n,) + (1,) * (good.ndim - 1)), good.shape)[good])

    tag = 0
    for a in range(3):
        for b in range(3):
            if a != b:  # a is equal, b differs in one bit at most: the centre of one is among the keys of the other
                add(tag, seg[a][:, None] << 12 | near[b], near[b] >= 0)
                tag += 1
    # exactly one bit differs in each segment: near(a) of one with near(b), near(c) of the other, and each parity is turned
    parity = [np.bitwise_count(s).astype(np.int64) & 1 for s in seg]
    bits = parity[0] << 2 | parity[1] << 1 | parity[2]
    left = ((bits[:, None, None] << 12 | near[0][:, :1, None]) << 12 | near[1][:, :, None]) << 12 | near[2][:, None, :]
    add(6, left, (near[1][:, :, None] >= 0) & (near[2][:, None, :] >= 0))
    right = (((bits ^ 7)[:, None] << 12 | near[0]) << 12 | near[1][:, :1]) << 12 | near[2][:, :1]
    add(6, right, near[0] >= 0)
    return np.concatenate(rows), np.concatenate(keys)


# ---- links ----


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links within one group, by search from one to the next."""
    left = fps.copy()
    out = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(left ^ x) <= BITS
            if hit.any():
                found = left[hit]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~hit]
    return out


def _split_forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """As _forest(), for groups of any size.

    The bits in which the group differs at all are cut into one piece more than bits may differ, so linked ones agree in a piece.
    """
    if len(fps) <= WHOLE:
        return _forest(fps)
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in range(64) if differ >> b & 1]
    if len(bits) <= BITS:
        return [(int(fps[0]), int(y)) for y in fps[1:]]
    out = []
    for k in range(BITS + 1):
        piece = np.zeros(len(fps), np.uint64)
        for b in bits[k :: BITS + 1]:
            piece = piece << np.uint64(1) | fps >> np.uint64(b) & np.uint64(1)
        order = np.argsort(piece, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
            if len(at) > 1:
                out += _split_forest(fps[at])
    return out


def links_in_sorted(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Links (n, 2) of uint64 among rows sorted by key, within equal keys."""
    found = []
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    length = np.diff(cuts)
    big = length > SMALL
    within = np.repeat(~big, length)
    for d in range(1, SMALL):
        if len(keys) <= d or not (length[~big] > d).any():
            break
        at = np.flatnonzero((keys[d:] == keys[:-d]) & within[d:])
        x, y = fps[at], fps[at + d]
        ok = (np.bitwise_count(x ^ y) <= BITS) & (x != y)
        found.append(np.stack([x[ok], y[ok]], axis=1))
    for a, n in zip(cuts[:-1][big].tolist(), length[big].tolist(), strict=True):
        got = _split_forest(np.unique(fps[a : a + n]))
        if got:
            found.append(np.array(got, dtype=np.uint64))
    if not found:
        return np.empty((0, 2), np.uint64)
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 20_000):
            part = fps[i : i + 20_000]
            rows, keys = keys_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], names=["key", "fp"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a group that a batch cuts is carried on into the next."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of one key

    def out(parts):
        got = links_in_sorted(np.concatenate([k for k, _ in parts]), np.concatenate([f for _, f in parts]))
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy().view(np.int64)), pa.array(got[:, 1].copy().view(np.int64))], names=["a", "b"])

    for b in batches:
        k, f = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1]))
        if last or held and held[0][0][0] != k[0]:
            if held or last:
                yield out([*held, (k[:last], f[:last])])
            held = []
        held.append((k[last:], f[last:]))
    if held:
        yield out(held)


def links(distinct: DataFrame) -> DataFrame:
    """distinct (fp) to links (a, b): enough of the pairs at 3 or fewer differing bits to connect all of them."""
    ship(distinct.sparkSession)
    dealt = distinct.select("fp").repartition(max(1, -(-distinct.count() // A_TASK)), "fp")
    keyed = dealt.mapInArrow(_emit_keys, "key long, fp long")
    return keyed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_match, "a long, b long")


def distinct_of(marks: DataFrame) -> DataFrame:
    """(fp, least): each fingerprint with its smallest id."""
    return stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))[0]


def grouped(marks: DataFrame, distinct: DataFrame, near: DataFrame) -> DataFrame:
    """doc_id, row, fp, root and component_id (the smallest id reachable by the links near (a, b)) of every row of marks."""
    roots = cut(connected_components(near))
    n = distinct.count()
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = packed(of, n)
    ids = packed(of.groupBy("root").agg(F.min("least").alias("component_id")), n)
    of = packed(of.join(ids, "root"), n).select("fp", "root", "component_id")
    return marks.join(of, "fp").select("doc_id", "row", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, fp, root and component_id of every row, by the fingerprints' links."""
    marks = cut(fingerprints(docs, key, text))
    distinct = distinct_of(marks)
    return grouped(marks, distinct, links(distinct))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs, one row of each component of found: the one with the smallest id, null ids last, the smallest row key among equal ids.

    Rows that go are told by their keys, so the texts of the others aren't exchanged; rows that come more than once
    in docs are taken out with them, and those that stay are put back once.
    """
    found, n = stored(found.select("doc_id", "row", "root"))
    best = packed(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("r")), n).select("root", F.col("r.row").alias("best"))
    twice = cut(packed(found.groupBy("row").count(), n).where("count > 1").select("row"))
    out = packed(packed(found.join(best, "root").where("row <> best").select("row"), n).union(twice).distinct(), n)
    back = packed(best.select(F.col("best").alias("row")).join(twice, "row", "left_semi"), n)
    name = near_name(docs.columns, "row")
    keyed = docs.select(*[quoted(c) for c in docs.columns], row_key(docs).alias(name))
    stay = keyed.join(few(out).withColumnRenamed("row", name), name, "left_anti")
    again = keyed.join(few(back).withColumnRenamed("row", name), name, "left_semi").groupBy(name).agg(F.first(F.struct(*[quoted(c).alias(c) for c in docs.columns])).alias("record"))
    return stay.select(*[quoted(c) for c in docs.columns]).unionByName(again.select(*[F.col("record").getField(c).alias(c) for c in docs.columns]))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, one row of each component of the fingerprints' links."""
    return keep_one(docs, near_duplicates(docs, key, text))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
