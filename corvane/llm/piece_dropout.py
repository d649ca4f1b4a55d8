"""SentencePiece BPE with seeded merge-dropout, and its lossless decoding.

The pieces and scores of a SentencePiece BPE model are read; no tokenizer is trained. An agenda merges
the best-scored pair of neighbours first, the leftmost among equals. Each candidate merge is skipped for
good if a keyed hash of its span falls below the dropout, so a segmentation is random but repeatable: the key is
made of the seed, the document's id and the unit's place in the text. With dropout 0 the ids are the library's own.

No piece of the model goes on from another character into a space, so texts are cut before spaces
into units which are encoded on their own. Of units that come again a worker remembers the ids without dropout and
the merges that lead there: where a key skips none of these, the ids are the remembered ones. All others are merged
under their own keys, short ones many at a time, as rows of an array; long ones by a heap.

Characters that are in no piece become byte pieces. So does U+2581, which the library would turn into
a space; hence decoding gives back every text.

Cases: null and empty texts have no ids; null ids share a key; repeated rows have equal ids; texts that
are one long unit take n log n steps; an empty table gives no rows; other columns stay as they are or aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import quoted, ship

DROPOUT, SEED = 0.1, 7
#: Keys that documents may have: a hash of the id, of 64 bits.
VARIANTS = 1 << 64
#: Units that a worker remembers; characters up to which a unit is merged in an array.
REMEMBERED, SHORT = 100_000, 24
SPACE = "▁"
NONE = np.int32(2**31 - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _skips(unit: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, limit: int) -> np.ndarray:
    """Whether the merge of [a, b) with [b, c) in a unit of that keyed hash is skipped."""
    x = unit + (a.astype(np.uint64) << np.uint64(42)) + (b.astype(np.uint64) << np.uint64(21)) + c.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < np.uint64(limit)


class Coder:
    """Encodes and decodes with one model."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or 4 in kinds:
            raise ValueError("the model must be BPE with byte fallback and leave texts as they are")
        self.dropout, self.seed = dropout, seed
        self.limit = int(dropout * 2**53)
        pieces = {p.piece.replace(SPACE, " "): i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(re.search("[^ ] ", s) for s in pieces):
            raise ValueError("pieces must not go on into a space")
        self.byte = [0] * 256
        self.bytes_of = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"" for p in model.pieces]
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte[int(p.piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[1:-1], 16)])
        # single characters: pieces, or parts of pieces that are none themselves (these end as bytes)
        self.char = {s: i for s, i in pieces.items() if len(s) == 1}
        for c in sorted(set("".join(pieces))):
            self.char.setdefault(c, len(self.bytes_of) + len(self.char))
        symbol = {**{s: i for s, i in pieces.items()}, **self.char}
        self.by_point = np.full(0x110000, -1, np.int32)
        self.by_point[[ord(c) for c in self.char]] = list(self.char.values())
        order = {i: r for r, i in enumerate(sorted(pieces.values(), key=lambda i: (-model.pieces[i].score, i)))}
        self.base = max(symbol.values()) + 2
        pairs = sorted((symbol[s[:k]] * self.base + symbol[s[k:]], i) for s, i in pieces.items() for k in range(1, len(s)) if s[:k] in symbol and s[k:] in symbol)
        self.codes = np.array([c for c, _ in pairs], np.int64)
        self.merged = np.array([i for _, i in pairs], np.int32)
        self.rank = np.array([order[i] for _, i in pairs], np.int32)
        self.place = {c: n for n, (c, _) in enumerate(pairs)}
        # where no piece holds a line's end, it parts units too
        self.cut = re.compile(r" *[^ \n]+| +|\n" if not any("\n" in s and len(s) > 1 for s in pieces) else r" *[^ ]+| +")
        self.forget()
        self.n_pieces = len(self.bytes_of)

    # ---- merging ----

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs; NONE where there is no such piece."""
        code = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        ok = (self.codes[at] == code) & (left >= 0) & (right >= 0)
        return np.where(ok, self.rank[at], NONE), self.merged[at]

    def _rows(self, units: list[str], keys: np.ndarray | int, n: int, path: list | None = None) -> list[bytes]:
        """Ids of units of n characters each, each under its key. With a path nothing is skipped, and it gets the merges (row, start, middle, end)."""
        limit = self.limit if path is None else 0
        m = len(units)
        sym = self.by_point[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")].reshape(m, n)
        start = np.tile(np.arange(n + 1, dtype=np.int16), (m, 1))  # where each symbol starts; the last column is the end
        keys = np.broadcast_to(np.asarray(keys, np.uint64), m)
        row = np.arange(m)
        out: list[bytes | None] = [None] * m
        rank, merged = self._lookup(sym[:, :-1], sym[:, 1:]) if n > 1 else (np.empty((m, 0), np.int32),) * 2
        if limit and n > 1:
            rank = np.where(_skips(keys[:, None], start[:, :-2], start[:, 1:-1], start[:, 2:], self.limit), NONE, rank)
        while len(row):
            k = sym.shape[1]
            j = rank.argmin(axis=1) if k > 1 else np.zeros(len(row), int)
            live = rank[np.arange(len(row)), j] < NONE if k > 1 else np.zeros(len(row), bool)
            done = np.flatnonzero(~live)
            plain = ((sym[done] >= 0) & (sym[done] < self.n_pieces)).all(axis=1)
            raw = sym[done].astype("<i4").tobytes()
            for at, i, r, easy in zip(range(0, len(raw) + 1, 4 * k), done.tolist(), row[done].tolist(), plain.tolist()):
                out[r] = raw[at : at + 4 * k] if easy else self._ids(sym[i].tolist(), units[r], start[i].tolist())
            if not live.any():
                break
            row, sym, start, rank, merged, j, keys = row[live], sym[live], start[live], rank[live], merged[live], j[live], keys[live]
            each = np.arange(len(row))
            if path is not None:
                path.append(np.stack([row, start[each, j], start[each, j + 1], start[each, j + 2]]))
            sym[each, j] = merged[each, j]
            cols = np.arange(k - 1)
            sym = np.take_along_axis(sym, cols + (cols > j[:, None]), axis=1)
            cols = np.arange(k)
            start = np.take_along_axis(start, cols + (cols > j[:, None]), axis=1)
            cols = np.arange(k - 2)
            keep = cols + (cols >= j[:, None])
            rank, merged = np.take_along_axis(rank, keep, axis=1), np.take_along_axis(merged, keep, axis=1)
            for at in (j - 1, j):  # the new symbol with its left and its right neighbour
                ok = np.flatnonzero((at >= 0) & (at < k - 2))
                p = at[ok]
                r, g = self._lookup(sym[ok, p], sym[ok, p + 1])
                if limit:
                    r = np.where(_skips(keys[ok], start[ok, p], start[ok, p + 1], start[ok, p + 2], self.limit), NONE, r)
                rank[ok, p], merged[ok, p] = r, g
        return out

    def _heap(self, unit: str, key: int) -> bytes:
        """Ids of one unit of any length, by an agenda."""
        n = len(unit)
        sym = [self.char.get(c, -1) for c in unit]
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        key, limit = np.array([key], np.uint64), self.limit
        agenda: list[tuple[int, int, int, int]] = []

        def add(spots: list[tuple[int, int]]) -> None:
            found = [(a, b, at) for a, b in spots if a >= 0 and b < n and sym[a] >= 0 and sym[b] >= 0 and (at := self.place.get(sym[a] * self.base + sym[b])) is not None]
            if not found:
                return
            skip = _skips(key, np.array([a for a, _, _ in found]), np.array([b for _, b, _ in found]), np.array([end[b] for _, b, _ in found]), limit) if limit else [False] * len(found)
            for (a, b, at), s in zip(found, skip, strict=True):
                if not s:
                    heapq.heappush(agenda, (int(self.rank[at]), a, end[b], at))

        add([(i, i + 1) for i in range(n - 1)])
        gone = [False] * n
        while agenda:
            _, a, stop, at = heapq.heappop(agenda)
            b = after[a]
            if gone[a] or b >= n or end[b] != stop or self.place.get(sym[a] * self.base + sym[b]) != at:
                continue
            sym[a], end[a], gone[b] = int(self.merged[at]), end[b], True
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            add([(before[a], a), (a, after[a])])
        live = [i for i in range(n) if not gone[i]]
        return self._ids([sym[i] for i in live], unit, [*live, n])

    def _ids(self, sym: list[int], unit: str, start: list[int]) -> bytes:
        out = []
        for k, s in enumerate(sym):
            if 0 <= s < self.n_pieces:
                out.append(s)
            else:
                out += [self.byte[x] for x in unit[start[k] : start[k + 1]].encode("utf-8", "surrogatepass")]
        return np.array(out, "<i4").tobytes()

    # ---- texts ----

    def variant(self, key) -> int:
        return xxhash.xxh64_intdigest(b"" if key is None else str(key).encode(), self.seed) % VARIANTS

    def _keys(self, counts: list[int], keys: list) -> np.ndarray:
        """A key for each unit of each text, of the seed, the document's id and the unit's place."""
        of = np.repeat(np.array([self.variant(k) for k in keys], np.uint64), counts)
        ends = np.cumsum(counts)
        place = np.arange(len(of)) - np.repeat(ends - counts, counts)
        x = of + (place.astype(np.uint64) + np.uint64(1)) * _M2
        x = (x ^ (x >> np.uint64(32))) * _M1
        return x ^ (x >> np.uint64(29))

    def _by_length(self, units: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(length, which units) of at most 20,000 units each."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(sizes, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            for k in range(0, len(at), 20_000):
                yield int(sizes[at[0]]), at[k : k + 20_000]

    def _learn(self, units: list[str]) -> None:
        """Remembers short units that come more than once among these, up to REMEMBERED."""
        counts = Counter(units)
        new = [u for u, n in counts.items() if (n > 1 or not self.limit) and len(u) <= SHORT][: REMEMBERED - len(self.known)]
        for n, at in self._by_length(new):
            some, path = [new[i] for i in at.tolist()], []
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))
            self.plain += self._rows(some, 0, n, path)
            steps = np.concatenate([np.empty((4, 0), np.int64), *path], axis=1)
            steps = steps[:, np.argsort(steps[0], kind="stable")]
            self.first = np.concatenate([self.first[:-1], len(self.spans) + np.searchsorted(steps[0], np.arange(len(some) + 1))])
            self.spans = np.concatenate([self.spans, steps[1:].T.astype(np.int16)])

    def _under_keys(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        """Ids of units, each under its key and without what is remembered."""
        out: list[bytes] = [b""] * len(units)
        for n, at in self._by_length(units):
            some = at.tolist()
            if n <= SHORT:
                for i, ids in zip(some, self._rows([units[i] for i in some], keys[at], n), strict=True):
                    out[i] = ids
            else:
                for i in some:
                    out[i] = self._heap(units[i], int(keys[i]))
        return out

    def _skipped(self, node: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether a key skips any merge on the way to the remembered ids."""
        hit = np.zeros(len(node), bool)
        if not self.limit or not len(node):
            return hit
        first, many = self.first[node], np.diff(self.first)[node]
        for d in range(int(many.max())):
            at = np.flatnonzero((many > d) & ~hit)
            a, b, c = self.spans[first[at] + d].T
            hit[at] = _skips(keys[at], a, b, c, self.limit)
        return hit

    def encode(self, texts: list[str | None], keys: list) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        parts = [self.cut.findall(" " + t) if t else [] for t in texts]
        counts = [len(p) for p in parts]
        units = list(chain.from_iterable(parts))
        own = self._keys(counts, keys)
        node = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(node < 0)
        if len(self.known) < REMEMBERED and len(new):
            unknown = [units[i] for i in new.tolist()]
            self._learn(unknown)
            node[new] = np.fromiter(map(self.known.get, unknown, repeat(-1)), np.int64, len(new))
        there = np.flatnonzero(node >= 0)
        node[there[self._skipped(node[there], own[there])]] = -1
        todo = np.flatnonzero(node < 0)
        ids = list(map(self.plain.__getitem__, np.maximum(node, 0).tolist())) if self.plain else [b""] * len(units)
        for i, x in zip(todo.tolist(), self._under_keys([units[i] for i in todo.tolist()], own[todo]), strict=True):
            ids[i] = x
        ends = np.cumsum([0, *counts]).tolist()
        return [b"".join(ids[a:b]) for a, b in zip(ends, ends[1:])]

    def forget(self) -> None:
        """Drops the remembered units, so that a worker's memory serves what it runs next."""
        self.known: dict[str, int] = {}
        self.plain: list[bytes] = []
        self.spans, self.first = np.empty((0, 3), np.int16), np.zeros(1, np.int64)  # the merges of each, and where they begin

    def decode(self, ids: bytes) -> str:
        """The text that has these ids."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return raw[1:].decode("utf-8", "surrogatepass")


_CODERS: dict[tuple, Coder] = {}


def coder(*told) -> Coder:
    """One for each worker and setting."""
    if told not in _CODERS:
        _CODERS[told] = Coder(*told)
    return _CODERS[told]


def _ranges(texts: list[str | None], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held < most):
            held += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def encode_texts(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32, text_sha256 (of what the ids decode to; null for a null text) and lossless."""
    ship(docs.sparkSession)
    names = ("doc_id", "n_tokens", "ids", "ids_crc32", "text_sha256", "lossless")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, dropout, seed)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _ranges(texts):
                ids = c.encode(texts[i:j], keys[i:j])
                back = [c.decode(x) for x in ids]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                digests = [None if t is None else hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for t, x in zip(texts[i:j], back, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(digests, pa.string()), pa.array([(t or "") == x for t, x in zip(texts[i:j], back, strict=True)])], names=names)
        c.forget()

    return docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, text_sha256 string, lossless boolean")


def decode_ids(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids."""
    ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, DROPOUT, SEED)
        for b in batches:
            texts = [None if x is None else c.decode(np.array(x, "<i4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(quoted(key).cast("long").alias("doc_id"), quoted(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
