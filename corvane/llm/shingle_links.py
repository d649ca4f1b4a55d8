"""Near-duplicates by SimHash links and, besides, by a Jaccard similarity of LEAST or more between sets of word shingles.

No pair of that similarity is left unconnected. Prefix filter: if all sets are put in one order, two sets that are similar
enough share one of their first n - ceil(LEAST * n) + 1 shingles, so only these are exchanged. Any order is right; this one
is by hash, but shingles that are often among the first of a set by hash, counted over all texts, come last, the commonest at
the very end. Sets that meet at a shingle are kept if their sizes and the places of the shared shingle leave enough room, and if
small bitmaps of all their shingles don't rule it out; they are then compared on all shingles, which are made anew from their texts.

Only connections matter. At first each set is compared with one of those that it meets at a shingle, and the pairs of the
fingerprints' links count as connected. Then, in up to ROUNDS rounds, each set is compared with one more for each shingle: of those that it meets there and
isn't connected with, the one whose bitmap differs least. At last all pairs are that meet and aren't connected yet. So a large group of near copies
doesn't give all its pairs. Groups of one shingle are cut into blocks of BLOCK rows, and a task takes two blocks at a time, so a row goes out
once for each block; where these would be more than CROWD, the group is parted by a second shingle. Sets that must share two have the
first two that they share among their first n - ceil(LEAST * n) + 2, so a row goes out once for each of these that stands after the first.

A set's id (sid) is a hash of 64 bits and no more than a key: what is compared and linked are the texts of all fingerprints
that have it, so two sets with one id are not taken for one.

Cases: texts of fewer words than a shingle are one shingle; texts without a word have no set, and only the fingerprints' links;
nulls, ties, repeated rows and clashing names are as in simhash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import A_TASK, ROW_KEY, cut, few, packed, quoted, row_key, ship, stored
from .components import connected_components

WIDTH, LEAST = 5, 0.8
#: A shingle is common above so many sets; of these as many as a power of two of counts lets through, MOST at most, come last.
OFTEN, MOST = 64, 1 << 20
#: Rows of a block of a group, rows of groups that are paired by shifting; words hashed at once, bytes from which a word's digest stands for it.
BLOCK, SMALL, WORDS, LONG = 20_000, 16, 100_000, 64
#: Pairs of sets that one task compares, of each two texts.
PAIRS = 2_000
#: Blocks from which a group is parted by a second shingle.
CROWD = 32
#: Rounds in which each set goes to the likeliest of those that it isn't connected with.
ROUNDS = 2
BASE = 0x9E3779B97F4A7C15
#: Bits to which bitmaps are folded to compare many at once: the fewest that any has, and more for larger sets.
FOLDED = (256, 1024)
#: Parts that the rows of a common shingle are dealt to, a power of two.
SALTS = 64


class Shingles:
    """Sets of shingles by polynomial hashes of their bytes, read off running sums. One for each task."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        #: A value for each byte, powers of the base and of its inverse.
        self.value = np.random.default_rng(simhash.SEED).integers(0, 1 << 64, 256, np.uint64)
        self.up = self.down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                setattr(self, name, np.concatenate([np.ones(1, np.uint64), np.full(n * 5 // 4, base, np.uint64)]).cumprod(dtype=np.uint64))

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        line = b" ".join(words)
        data = np.frombuffer(line, np.uint8)
        gaps = np.flatnonzero(data == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
        if (ends - starts).max() > LONG:
            return self._hashes([w if len(w) <= LONG else xxhash.xxh3_128_hexdigest(w).encode() for w in words])
        self._powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value.take(data) * self.up[: len(data)], out=sums[1:])
        n = max(1, len(words) - self.width + 1)
        x = (sums[ends[-n:]] - sums[starts[:n]]) * self.down[starts[:n]]
        x ^= x >> np.uint64(31)
        x *= np.uint64(BASE)
        return x ^ (x >> np.uint64(29))

    def of(self, words: list[bytes]) -> np.ndarray:
        """The distinct shingles in order of their hashes; none where there is no word."""
        if not words:
            return np.empty(0, np.uint64)
        # shingles lie within one piece of words, and each piece begins width - 1 words before the last one's end
        step = WORDS - self.width + 1
        parts = [self._hashes(words[i : i + WORDS]) for i in range(0, max(1, len(words) - self.width + 1), step)]
        x = np.sort(parts[0] if len(parts) == 1 else np.concatenate(parts))
        return x[np.concatenate([[True], x[1:] != x[:-1]])]


def set_id(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def needed(n: np.ndarray | int, least: float) -> np.ndarray | int:
    """The least number of shingles that make up this share of n."""
    return np.ceil(np.round(n * least, 6)).astype(np.int64)


def in_order(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sorted shingles in the order of all sets; common is sorted, rank is the place of each behind all that aren't common."""
    if not len(common):
        return found
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    late = common[at] == found
    return np.concatenate([found[~late], found[late][np.argsort(rank[at[late]])]]) if late.any() else found


def bitmap(found: np.ndarray) -> bytes:
    """A bit for each value of the hashes' last digits, the parity of how many have it; as many bits as the next power of two of the set's size.

    Two sets differ in at least as many shingles as their bitmaps in bits, if the longer one is folded to the other's length.
    """
    bits = max(FOLDED[0], 1 << (len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def may_be_similar(n: int, x: bytes, m: int, y: bytes, least: float) -> bool:
    """Whether sets of these sizes and bitmaps can be similar enough."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = (int.from_bytes(x[:half], "little") ^ int.from_bytes(x[half:], "little")).to_bytes(half, "little")
    differ = (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()
    return differ <= n + m - 2 * int(needed((n + m) * (least / (1 + least)), 1.0))


def _marks(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, row, fp, and of texts with a word sid, n (the set's size) and bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for b in batches:
            fps, sids, sizes, bits = [], [], [], []
            for x in b.column(1):
                words = simhash.words_of(x.as_py())
                found = shingles.of(words)
                fps.append(simhash.fingerprint_of(simhash.shingle_hashes(words)))
                sids.append(set_id(found) if len(found) else None)
                sizes.append(len(found))
                bits.append(bitmap(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "row", "fp", "sid", "n", "bits"])

    return docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text"), row_key(docs).alias("row")).mapInArrow(run, f"doc_id long, row {ROW_KEY}, fp long, sid long, n long, bits binary")


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles of rows (h) in order of their hashes, and the place of each by its count."""
    counts, _ = stored(rows.groupBy("h").count().where(F.col("count") > OFTEN))
    held = counts.groupBy(F.floor(F.log2("count")).alias("power")).count().orderBy(F.desc("power")).collect()
    total, floor = 0, 64
    for r in held:
        total += r["count"]
        if total > MOST:
            break
        floor = r["power"]
    told = counts.where(F.floor(F.log2("count")) >= floor).toArrow()
    h, n = told["h"].to_numpy().view(np.uint64), told["count"].to_numpy()
    order = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    return h[order], rank[order]


def _prefixes(docs: DataFrame, text: str, width: int, least: float, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(h, sid, at, salt) of each set's first shingles; at is the set's size above 32 bits, and the shingle's place; salt deals out common ones, others have -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(width), set()
        for b in batches:
            parts, sids, sizes = [np.empty(0, np.uint64)], [], []
            for x in b.column(0):
                found = shingles.of(simhash.words_of(x.as_py()))
                sid = set_id(found)
                if len(found) and sid not in seen:
                    seen.add(sid)
                    sids.append(sid)
                    sizes.append(len(found))
                    parts.append(in_order(found, common, rank)[: len(found) - int(needed(len(found), least)) + 1])
            many = [len(p) for p in parts[1:]]
            ends = np.cumsum(many, dtype=np.int64)
            place = np.arange(ends[-1] if many else 0) - np.repeat(ends - many, many)
            at = np.repeat(np.array(sizes, np.int64), many) << 32 | place
            h, sid = np.concatenate(parts), np.repeat(np.array(sids, np.int64), many)
            salt = np.where(np.isin(h, common), sid & (SALTS - 1), -1) if len(common) else np.full(len(h), -1)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sid), pa.array(at), pa.array(salt, pa.int32())], names=["h", "sid", "at", "salt"])

    return docs.select(quoted(text).alias("text")).mapInArrow(run, "h long, sid long, at long, salt int")


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by all columns; those at a shingle that is common or that another set has go on, each once."""
    held = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.int32)]
    met = False  # whether the row that is held has met another one

    def out(c, keep):
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in c[:3]], names=["h", "sid", "at"])

    for b in batches:
        c = [np.concatenate([x, b.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(held)]
        if not len(c[0]):
            continue
        new = np.concatenate([[True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])])
        c = [x[new] for x in c]
        same = c[0][1:] == c[0][:-1]
        keep = np.concatenate([[met], same]) | np.concatenate([same, [False]]) | (c[3] >= 0)
        held, met = [x[-1:] for x in c], bool(keep[-1])
        if keep[:-1].any():
            yield out([x[:-1] for x in c], keep[:-1])
    if met:
        yield out(held, slice(None))


def room(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of sizes n and m that share a shingle at their places p and q can be similar enough."""
    shared = needed((n + m) * (least / (1 + least)), 1.0)
    return (np.minimum(n, m) >= needed(np.maximum(n, m), least)) & (np.minimum(p, q) + np.minimum(n - p, m - q) >= shared)


class Folded:
    """Bitmaps folded to FOLDED bits, as rows of words."""

    def __init__(self, bits: list[bytes]):
        small, large = FOLDED
        self.small = np.zeros((len(bits), small // 64), np.uint64)
        self.large = np.zeros((len(bits), large // 64), np.uint64)
        size = np.fromiter(map(len, bits), np.int64, len(bits))
        self.is_large = size * 8 >= large
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            rows = np.frombuffer(b"".join(bits[k] for k in at.tolist()), np.uint64).reshape(len(at), -1)
            if n * 8 >= large:
                self.large[at] = np.bitwise_xor.reduce(rows.reshape(len(at), -1, large // 64), axis=1)
            self.small[at] = np.bitwise_xor.reduce(rows.reshape(len(at), -1, small // 64), axis=1)

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bits rows i and j differ in, of the larger size where both have it."""
        n = np.bitwise_count(self.small[i] ^ self.small[j]).sum(axis=1, dtype=np.int64)
        at = np.flatnonzero(self.is_large[i] & self.is_large[j])
        n[at] = np.bitwise_count(self.large[i[at]] ^ self.large[j[at]]).sum(axis=1, dtype=np.int64)
        return n

    def agree(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether rows i and j differ in `most` bits or fewer."""
        ok = np.bitwise_count(self.small[i] ^ self.small[j]).sum(axis=1, dtype=np.int64) <= most
        at = np.flatnonzero(ok & self.is_large[i] & self.is_large[j])
        ok[at] = np.bitwise_count(self.large[i[at]] ^ self.large[j[at]]).sum(axis=1, dtype=np.int64) <= most[at]
        return ok


def _first_pairs(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, x, t, y = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            ok = room(x >> 32, x & 0xFFFFFFFF, y >> 32, y & 0xFFFFFFFF, least) & (s != t)
            if ok.any():
                got = np.unique(np.sort(np.stack([s[ok], t[ok]], axis=1), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["s", "t"])

    return run


def pairs_in_sorted(group: np.ndarray, sid: np.ndarray, root: np.ndarray, at: np.ndarray, side: np.ndarray, bits: list[bytes], least: float, nearest: bool = False) -> Iterator[np.ndarray]:
    """Pairs (n, 2) of sets of one group and different roots that can be similar; rows stand in order of (group, size).

    side: 0 in a block that is paired within itself; 1 and 2 where two blocks are paired with each other.
    nearest: of each row's pairs only the one whose bitmaps differ in the least share of both sets.
    """
    n, p, folded = at >> 32, at & 0xFFFFFFFF, Folded(bits)
    share, mate = np.full(len(sid), np.inf), np.full(len(sid), -1)

    def told(i: np.ndarray, j: np.ndarray) -> Iterator[np.ndarray]:
        if not nearest:
            yield np.stack([sid[i], sid[j]], axis=1)
            return
        new = folded.differ(i, j) / (n[i] + n[j])
        for x, y in ((i, j), (j, i)):
            order = np.lexsort((sid[y], new, x))
            x, y, d = x[order], y[order], new[order]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            first = first[d[first] < share[x[first]]]
            share[x[first]], mate[x[first]] = d[first], y[first]

    def good(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = (root[i] != root[j]) & (sid[i] != sid[j]) & ((side[i] == 0) | (side[i] != side[j])) & room(n[i], p[i], n[j], p[j], least)
        at = np.flatnonzero(ok)
        x, y = i[at], j[at]
        ok[at] = folded.agree(x, y, n[x] + n[y] - 2 * needed((n[x] + n[y]) * (least / (1 + least)), 1.0))
        return ok

    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    length = np.diff(cuts)
    big = length > SMALL
    within = np.repeat(~big, length)
    for d in range(1, SMALL):
        i = np.flatnonzero((group[d:] == group[:-d]) & within[d:])
        i = i[good(i, i + d)]
        if len(i):
            yield from told(i, i + d)
    for a, k in zip(cuts[:-1][big].tolist(), length[big].tolist(), strict=True):
        ends = a + np.searchsorted(n[a : a + k], np.floor(np.round(n[a : a + k] / least, 6)), side="right")
        for i in range(a, a + k, 64):
            left = np.arange(i, min(i + 64, a + k))
            right = np.arange(i + 1, ends[left[-1] - a])
            x, y = (v.ravel() for v in np.meshgrid(left, right, indexing="ij"))
            x, y = x[y > x], y[y > x]
            ok = good(x, y)
            if ok.any():
                yield from told(x[ok], y[ok])
    some = np.flatnonzero(mate >= 0)
    if len(some):
        yield np.stack([sid[some], sid[mate[some]]], axis=1)


def _other_pairs(least: float, nearest: bool = False):
    """Rows come sorted by (h, lo, hi, at); a group that a batch cuts is carried on into the next. nearest: as in pairs_in_sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(parts):
            *columns, bits = zip(*parts, strict=True)
            h, lo, hi, sid, root, at, block = map(np.concatenate, columns)
            new = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            side = np.where(lo == hi, 0, np.where(block == lo, 1, 2))
            for got in pairs_in_sorted(np.concatenate([[0], np.cumsum(new)]), sid, root, at, side, list(chain(*bits)), least, nearest):
                got = np.unique(np.sort(got, axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["s", "t"])

        for b in batches:
            if not b.num_rows:
                continue
            c = (*(b.column(k).to_numpy(zero_copy_only=False) for k in range(7)), b.column(7).to_pylist())
            same = (c[0] == c[0][-1]) & (c[1] == c[1][-1]) & (c[2] == c[2][-1])
            last = int(same.argmax())
            if last or held and any(held[0][k][0] != c[k][0] for k in range(3)):
                yield from out([*held, tuple(x[:last] for x in c)])
                held = []
            held.append(tuple(x[last:] for x in c))
        if held:
            yield from out(held)

    return run


def _bits_agree(least: float):
    """Rows (s, n, x, t, m, y) of two sets' ids, sizes and bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, x, m, y = (b.column(k).to_pylist() for k in (1, 2, 4, 5))
            ok = [may_be_similar(*pair, least) for pair in zip(n, x, m, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3)], names=["s", "t"]).filter(pa.array(ok, pa.bool_()))

    return run


def _similar(width: int, least: float):
    """Rows (s, a, one, t, b, two): sets' ids, fingerprints and texts; gives the links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for r in batches:
            made: dict[tuple, np.ndarray] = {}

            def of(ids, texts, k):
                if ids[k] not in made:
                    made[ids[k]] = shingles.of(simhash.words_of(texts[k].as_py()))
                return made[ids[k]]

            s, a, t, b = (r.column(k).to_pylist() for k in (0, 1, 3, 4))
            left, right, ok = list(zip(s, a, strict=True)), list(zip(t, b, strict=True)), []
            for k in range(r.num_rows):
                x, y = of(left, r.column(2), k), of(right, r.column(5), k)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared >= round(least * (len(x) + len(y) - shared), 6))
            yield pa.RecordBatch.from_arrays([r.column(1), r.column(4)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _seconds(texts: DataFrame, width: int, least: float, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(sid, second, place) of the shingles of each set (sid, text) in which those that share two have the first two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for b in batches:
            parts = [np.empty(0, np.uint64)]
            for x in b.column(1):
                found = shingles.of(simhash.words_of(x.as_py()))
                parts.append(in_order(found, common, rank)[: len(found) - int(needed(len(found), least)) + 2])
            many = np.array([len(p) for p in parts[1:]], np.int64)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            sid = np.repeat(b.column(0).to_numpy(zero_copy_only=False), many)
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(np.concatenate(parts).view(np.int64)), pa.array(place)], names=["sid", "second", "place"])

    return texts.select("sid", "text").mapInArrow(run, "sid long, second long, place long")


def _parted(rooted: DataFrame) -> DataFrame:
    """h and rows of groups with sets that aren't connected."""
    return rooted.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("h", "rows")


def _blocks(rooted: DataFrame, least: float, seconds: Callable[[DataFrame], DataFrame], rows: int | None = None) -> DataFrame:
    """(h, lo, hi, sid, root, at, block): rows (h, sid, root, at) once for each pair of blocks; seconds: _seconds() of sets (sid); rows: how many are rooted, if known."""
    n = rooted.count() if rows is None else rows
    groups = cut(packed(_parted(rooted), n))
    crowded = groups.where(F.col("rows") > CROWD * BLOCK).select("h")
    if not crowded.isEmpty():
        crowded = few(crowded)
        members = cut(rooted.join(crowded, "h"))
        after = seconds(members.select("sid").distinct())
        apart = members.join(after, "sid").where(F.col("place") > F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)))
        apart = apart.select(F.xxhash64("h", "second").alias("h"), "sid", "root", "at")
        # sets so small that one shingle is enough stay
        alone = members.where(F.ceil(F.round(F.shiftright("at", 32) * F.lit(least), 6)) < 2).select("h", "sid", "root", "at")
        rooted, n = stored(rooted.join(crowded, "h", "left_anti").select("h", "sid", "root", "at").unionByName(apart).unionByName(alone))
        groups = cut(packed(_parted(rooted), n))
    blocks = packed(rooted.join(groups.select("h", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "h"), n)
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return blocks.select("h", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "sid", "root", "at", "block")


def _links(docs: DataFrame, marks: DataFrame, near: DataFrame, text: str, width: int, least: float) -> DataFrame:
    """The links (a, b) of fingerprints between similar sets; near: the fingerprints' own."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    common = _common(_prefixes(docs, text, width, least, *none))
    rows = _prefixes(docs, text, width, least, *common).repartition("h", "salt").sortWithinPartitions("h", "sid", "at")
    meet, n_meet = stored(rows.mapInArrow(_meeting, "h long, sid long, at long"))
    sets, n_sets = stored(marks.where("sid is not null").groupBy("sid", "fp").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    keyed = docs.select(quoted(text).alias("text"), row_key(docs).alias("row"))

    def similar(pairs: DataFrame, n: int) -> DataFrame:
        def held(df: DataFrame) -> DataFrame:
            return packed(df, max(n * A_TASK // PAIRS, n_sets))

        bits = sets.select("sid", "n", "bits")
        pairs = held(held(pairs.join(bits.toDF("s", "n", "x"), "s")).join(bits.toDF("t", "m", "y"), "t")).select("s", "n", "x", "t", "m", "y")
        pairs = cut(held(pairs.mapInArrow(_bits_agree(least), "s long, t long").distinct()))
        sids = held(pairs.select(F.col("s").alias("sid")).union(pairs.select("t")).distinct())
        wanted = held(sets.select("sid", "fp", "row").join(sids, "sid"))
        texts = cut(held(keyed.join(few(wanted), "row").groupBy("sid", "fp").agg(F.first("text").alias("text"))))
        one, two = texts.toDF("s", "a", "one"), texts.toDF("t", "b", "two")
        both = held(held(pairs.join(one, "s")).join(two, "t")).where("a <> b").select("s", "a", "one", "t", "b", "two")
        return cut(held(both.mapInArrow(_similar(width, least), "a long, b long").distinct()))

    # pairs with one of each group, and different fingerprints of one set
    first = packed(meet.groupBy("h").agg(F.min(F.struct("sid", "at")).alias("y"), F.max("sid").alias("z")), n_meet).where("y.sid <> z").select("h", F.col("y.sid").alias("t"), F.col("y.at").alias("y"))
    pairs = packed(meet.join(first, "h"), n_meet).select(F.col("sid").alias("s"), F.col("at").alias("x"), "t", "y").mapInArrow(_first_pairs(least), "s long, t long")
    twins = packed(sets.groupBy("sid").agg(F.min("fp").alias("a"), F.max("fp").alias("b")), n_sets).where("a <> b").select(F.col("sid").alias("s"), F.col("sid").alias("t"))
    tried, tested = stored(pairs.unionByName(twins).distinct())
    found = similar(tried, tested)

    def seconds(sids: DataFrame) -> DataFrame:
        wanted = sets.select("sid", "fp", "row").join(sids, "sid")
        texts = keyed.join(few(wanted), "row").groupBy("sid", "fp").agg(F.first("text").alias("text"))
        return _seconds(texts, width, least, *common).distinct()

    meeting, n, last = meet, n_meet, False
    for k in range(ROUNDS + 1):
        last = last or k == ROUNDS
        # the likeliest of each set, at last all, that meet and aren't connected yet
        roots = cut(connected_components(near.unionByName(found))).withColumnRenamed("node", "fp")
        roots = packed(sets.join(roots, "fp", "left"), n_sets).select("sid", F.coalesce("root", "fp").alias("root"))
        rooted, n = stored(packed(meeting.join(roots, "sid"), max(n, n_sets)))
        blocks = _blocks(rooted, least, seconds, n)
        blocks = packed(blocks.join(packed(sets.select("sid", "bits").distinct(), n_sets), "sid"), max(n, n_sets)).select(*blocks.columns, "bits")
        pairs = blocks.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi", "at").mapInArrow(_other_pairs(least, not last), "s long, t long")
        left, tested = stored(pairs.distinct().join(tried, ["s", "t"], "left_anti"))
        links = similar(left, tested)
        found = found.unionByName(links)
        if last:
            break
        # where few of the likeliest are similar, the others are mostly unlike sets
        last = 2 * links.count() < tested or not tested
        tried = tried.unionByName(left)
        meeting = packed(rooted.join(packed(_parted(rooted), n).select("h"), "h"), n).select(*meet.columns)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """doc_id, row, fp, root and component_id (the smallest id reachable by links of either kind) of every row."""
    ship(docs.sparkSession)
    marks = cut(_marks(docs, key, text, width))
    distinct = simhash.distinct_of(marks)
    near, _ = stored(simhash.links(distinct))
    return simhash.grouped(marks, distinct, near.unionByName(_links(docs, marks, near, text, width, least)))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """docs, one row of each component: see simhash.keep_one."""
    return simhash.keep_one(docs, near_duplicates(docs, key, text, width, least))
