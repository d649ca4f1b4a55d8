"""Token ids in files of directly addressable codes.

Texts are encoded by the tokenizers library; every id is split into chunks of 8 bits. Level 0 holds the
lowest chunk of every id, level k the next chunk of those ids that need one. Next to each level stand a
bitmap (bit i: id i goes on in the next level) and a rank directory (set bits before each block of 512
bits), so any one id is found by a rank for each level, without decoding its neighbours.

The files: documents are dealt by ranges of ascending id, and each range is written in order as
segments (bytes, see pack()) in a Parquet table, which Spark commits as a whole: a lost executor leaves
no half file. Reading takes the segments back; the ids of all documents before one are known from sums
over the ranges and the directory inside each segment. A segment's row tells its least and greatest id, so single
tokens (tokens_at()) are read from the row groups that can hold their documents.

Cases: a null text counts as empty and has only the end id; a null id sorts first; rows with equal ids
all stay, ordered by a hash of their text; an empty table gives no rows; other columns are not read.
Special tokens inside a text are encoded as the library does by default.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_table, quoted, ship

MAGIC = b"DAC1"
BLOCK = 512
#: Bytes of text that go into one segment, and pieces that an encoder remembers.
SEGMENT_BYTES, REMEMBERED = 4 << 20, 800_000
#: Bytes of text for one range; there are at least as many ranges as shuffle partitions.
RANGE_BYTES = 256 << 20
#: Bytes of one row group, some segments each.
GROUP_BYTES = 16 << 20


# ---- the format ----


def pack(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    """One segment: header, directory of documents, then each level's chunks, bitmap and rank directory."""
    out = [MAGIC, struct.pack("<II", len(doc_ids), len(ids))]
    out.append(np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes())
    out.append(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes())
    out.append(np.asarray(counts, dtype="<u4").tobytes())
    rest, levels = ids.astype(np.uint32), []
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        rank = np.cumsum(ones, dtype=np.uint32) - ones
        levels.append(struct.pack("<II", len(rest), len(rank)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + rank.astype("<u4").tobytes())
        rest = rest[more] >> 8
    return b"".join([*out, struct.pack("<I", len(levels)), *levels])


class Segment:
    """Reads what pack() wrote."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        n, self.n_tokens = struct.unpack_from("<II", blob, 4)
        at = 12
        null = np.frombuffer(blob, np.uint8, n, at)
        ids = np.frombuffer(blob, "<i8", n, at + n)
        self.doc_ids = [None if x else int(d) for x, d in zip(null, ids, strict=True)]
        self.counts = np.frombuffer(blob, "<u4", n, at + 9 * n)
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts
        at += 13 * n
        (k,) = struct.unpack_from("<I", blob, at)
        at += 4
        self.levels = []
        for _ in range(k):
            m, blocks = struct.unpack_from("<II", blob, at)
            chunks = np.frombuffer(blob, np.uint8, m, at + 8)
            bits = np.frombuffer(blob, np.uint8, blocks * BLOCK // 8, at + 8 + m)
            rank = np.frombuffer(blob, "<u4", blocks, at + 8 + m + len(bits))
            self.levels.append((chunks, bits, rank))
            at += 8 + m + len(bits) + 4 * blocks

    def get(self, i: int) -> int:
        """The id at place i, by one rank in each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            within = bits[block * BLOCK // 8 : (i >> 3)]
            i = int(rank[block]) + int(np.bitwise_count(within).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n_tokens, np.uint32)
        at = None
        for k, (chunks, bits, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(8 * k)
            if at is None:
                out |= part
            else:
                out[at] |= part
            on = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
            at = np.flatnonzero(on) if at is None else at[on]
        return out


# ---- encoding ----

_ALL = [chr(i) for i in (*range(0x20, 0x7F), *range(0xA1, 0x250))]
_L = "".join(re.escape(c) for c in _ALL if unicodedata.category(c)[0] == "L")
_N = "".join(re.escape(c) for c in _ALL if unicodedata.category(c)[0] == "N")
#: Texts of these characters alone are cut into pieces here; the rest is left to the library.
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")
#: The byte-level pre-tokenizer's pattern on those characters.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


class Encoder:
    """The library's ids of whole texts. Where a byte-level pre-tokenizer cuts texts into pieces that never merge, the library sees each distinct piece once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer") and (told.get("model") or {}).get("type") == "BPE" and not (told["model"].get("dropout"))
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        self.opens = np.zeros(max([0, *self.library.get_vocab().values()]) + 1, bool)  # ids whose bytes begin with a space
        self.opens[[i for t, i in self.library.get_vocab().items() if t.startswith("Ġ")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        left: list[int] = []
        for i, x in enumerate(texts):
            if self.by_piece and not _ODD.search(x) and not any(s in x for s in self.special):
                cut.append((i, _PIECE.findall(x)))
            else:
                left.append(i)
        new = set(itertools.chain.from_iterable(p for _, p in cut)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.known.clear()
            new = set(itertools.chain.from_iterable(p for _, p in cut))
        if new:
            # words after a space go to the library many at a time: each begins where an id begins with a space
            words = [p for p in new if p[0] == " " and p[1:].isalpha()]
            rest = list(new.difference(words))
            self.known.update(zip(rest, self._encode(rest), strict=True))
            for i in range(0, len(words), 512):
                some = words[i : i + 512]
                (ids,) = self._encode(["".join(some)])
                at = (np.flatnonzero(self.opens[np.frombuffer(ids, "<u4")]) * 4).tolist()
                self.known.update((p, ids[a:b]) for p, a, b in zip(some, at, [*at[1:], len(ids)], strict=True))
        get = self.known.__getitem__
        for i, pieces in cut:
            out[i] = b"".join(map(get, pieces))
        for i, e in zip(left, self._encode([texts[i] for i in left]) if left else [], strict=True):
            out[i] = e
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- writing and reading ----

SEGMENTS = "part int, seq int, first long, low long, high long, n_docs long, n_tokens long, blob binary"


def _segments(path: str, end: int | None):
    tail = b"" if end is None else struct.pack("<I", end)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq, first = encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            texts = texts.to_pylist()
            i = 0
            while i < len(ids):
                j, held = i, 0
                while j < len(ids) and (j == i or held < SEGMENT_BYTES):
                    held += len(texts[j] or "")
                    j += 1
                codes = [c + tail for c in coder.encode([x or "" for x in texts[i:j]])]
                tokens = np.frombuffer(b"".join(codes), "<u4")
                blob = pack(tokens, ids[i:j], np.array([len(c) // 4 for c in codes]))
                known = [d for d in ids[i:j] if d is not None]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first": pa.array([first], pa.int64()), "low": pa.array([min(known, default=None)], pa.int64()), "high": pa.array([max(known, default=None)], pa.int64()), "n_docs": pa.array([j - i], pa.int64()), "n_tokens": pa.array([len(tokens)], pa.int64()), "blob": pa.array([blob], pa.binary())})
                first += len(tokens)
                seq, i = seq + 1, j

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int | None, key: str = "doc_id", text: str = "text") -> None:
    """Encodes all texts and writes the segments, in ascending order of key, as a table at path."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(quoted(key).cast("long").alias("key"), quoted(text).alias("text"), F.xxhash64(quoted(text)).alias("tie"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    # ranges are cut before encoding: finding their bounds reads ids and texts, and encodes nothing
    ranged = rows.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    ranged.mapInArrow(_segments(tokenizer, end), SEGMENTS).write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 1).parquet(path)


def tokens_at(spark: SparkSession, path: str, wanted: list[tuple[int, int]]) -> DataFrame:
    """doc_id, place, token for each wanted (doc_id, place) that exists, by random access: other segments' bytes aren't decoded.

    wanted is a short list (it becomes a filter). Places count from 0 within a document; of several documents with
    one id each answers. Null ids can't be asked for; negative places and places behind the end give no row.
    """
    ship(spark)
    places: dict[int, list[int]] = {}
    for d, at in dict.fromkeys(wanted):
        places.setdefault(d, []).append(at)
    near = F.lit(False)
    for d in places:
        near = near | ((F.col("low") <= d) & (F.col("high") >= d))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                s = Segment(blob)
                got = [(d, at, s.get(int(a) + at)) for d, a, n in zip(s.doc_ids, s.starts, s.counts, strict=True) for at in places.get(d, ()) if 0 <= at < n]
                yield pa.RecordBatch.from_pydict({k: pa.array([g[c] for g in got], pa.int64()) for c, k in enumerate(("doc_id", "place", "token"))})

    return spark.read.parquet(path).where(near).select("blob").mapInArrow(read, "doc_id long, place long, token long")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document, from the segments; with_ids: ids too."""
    ship(spark)
    segments = spark.read.parquet(path)
    sums = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each range that was written: as many as partitions
    before = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = Segment(blob)
                ids = s.all().astype("<u4")
                own = [ids[a : a + n] for a, n in zip(s.starts.tolist(), s.counts.tolist(), strict=True)]
                got = {"part": pa.array([part] * len(own), pa.int32()), "doc_id": pa.array(s.doc_ids, pa.int64()), "at": pa.array(s.starts + first, pa.int64()), "n_tokens": pa.array(s.counts.astype(np.int64)), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())}
                if with_ids:
                    got["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(got)

    kind = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = segments.select("part", "first", "blob").mapInArrow(read, kind)
    out = docs.join(F.broadcast(before), "part")
    return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    to = new_table(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), to, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return read_tokens(spark, to)
