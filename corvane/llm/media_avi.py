"""Bytes as AVI clips of motion JPEG, and back: frames, shots and timed clip rows.

Frames are lossless JPEG (SOF3, 8-bit grey, predictor 1), so what is stored is read back bit by bit. The
Huffman table gives category k a code of 9 - k bits, which with its k further bits makes 9 bits for every
sample; so frames of this table are packed and read without a loop over samples. Frames of any other
Huffman table, of predictors 1 to 7 and with restart-free single scans are read by a plain loop. Frames
of JPEG's baseline process, as cameras write them, are decoded too (jpeg_baseline); their brightness counts.

The RIFF file has a header list, a text note with the payload's length, a `movi` list of `00dc` chunks
and an `idx1` index, which the reader follows; without it, the reader walks through `movi`.

Shots: each frame has a histogram of 16 levels; a shot begins where the difference to the frame before
exceeds both a floor and the mean of the last differences plus THREE standard deviations. Each shot is a clip.

Cases: null and empty texts become one frame of zeros (64 bytes of payload); the last frame is filled up
with zeros, which the note's length takes off again; equal texts give equal files; repeated rows are kept;
an empty table gives no rows; a very long text is one file, held whole in one worker; bytes that are no AVI file of this kind raise ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import new_table, quoted, ship
from .jpeg_baseline import is_baseline, luma

BLOCK = 64
WIDTH, HEIGHT, RATE = 64, 32, 25
LEVELS, FLOOR, THREE, MEMORY = 16, 0.25, 3.0, 8
#: Bytes of files that leave a worker at once, and bytes (once compressed) and files of a row group of the stored table.
SENT_BYTES, GROUP_BYTES, GROUP_FILES = 2 << 20, 8 << 20, 64

# ---- lossless JPEG ----

#: Code lengths by category: 9 - k bits for 1 to 8, 9 for 0.
_LENGTHS = {k: 9 - k if k else 9 for k in range(9)}


def _huffman(lengths: dict[int, int]) -> tuple[bytes, list[int], dict[int, tuple[int, int]]]:
    """Counts by length, values in order, and the canonical code of each value."""
    values = sorted(lengths, key=lambda v: (lengths[v], v))
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return counts, values, _canonical(counts, values)


def _canonical(counts: bytes, values: list[int]) -> dict[int, tuple[int, int]]:
    codes, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[values[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return codes


_COUNTS, _VALUES, _CODES = _huffman(_LENGTHS)


def _units() -> tuple[np.ndarray, np.ndarray]:
    """The 9-bit unit of each difference (index: difference + 255), and back."""
    unit, back = np.zeros(511, np.uint16), np.full(512, 9999, np.int16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        code, _ = _CODES[k]
        unit[d + 255] = code << k | (d if d >= 0 else d + (1 << k) - 1) if k else code
        back[unit[d + 255]] = d
    return unit, back


_UNIT, _BACK = _units()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(height: int, width: int) -> bytes:
    return b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)) + _segment(0xC4, b"\x00" + _COUNTS + bytes(_VALUES)) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def jpeg_encode(frames: np.ndarray) -> list[bytes]:
    """Frames (n, height, width) of bytes, each as one lossless JPEG image."""
    n, height, width = frames.shape
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, 0, 0] = x[:, 0, 0] - 128
    d[:, 0, 1:] = x[:, 0, 1:] - x[:, 0, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 1:, 1:] = x[:, 1:, 1:] - x[:, 1:, :-1]
    unit = _UNIT[d.reshape(n, -1) + 255]
    # eight units of 9 bits are nine bytes
    u = np.concatenate([unit, np.full((n, -unit.shape[1] % 8), 511, np.uint16)], axis=1).reshape(n, -1, 8)
    packed = np.empty((n, u.shape[1], 9), np.uint8)
    packed[..., 0] = u[..., 0] >> 1
    for k in range(1, 8):
        packed[..., k] = (u[..., k - 1] << (8 - k)) & 0xFF | u[..., k] >> (k + 1)
    packed[..., 8] = u[..., 7] & 0xFF
    size = -(-unit.shape[1] * 9 // 8)
    head = _jpeg_head(height, width)
    return [head + row[:size].tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed.reshape(n, -1)]


def _parse(data: bytes) -> tuple[dict, bytes]:
    """Head of a lossless image and its entropy-coded bytes, stuffing removed."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    told: dict = {"tables": {}}
    at = 2
    while at + 4 <= len(data):
        _, marker, length = struct.unpack_from(">BBH", data, at)
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC3:
            told["bits"], told["height"], told["width"], parts = struct.unpack_from(">BHHB", body)
            if parts != 1 or told["bits"] != 8:
                raise ValueError("only 8-bit images of one component are read")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only lossless images are read")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                told["tables"][body[0] & 15] = (bytes(body[1:17]), list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDA:
            told["table"], told["predictor"], told["shift"] = body[2] >> 4, body[3], body[5] & 15
            end = data.rfind(b"\xff\xd9")
            return told, data[at : end if end >= at else len(data)].replace(b"\xff\x00", b"\xff")
    raise ValueError("an image without a scan")


def jpeg_decode(images: list[bytes]) -> np.ndarray:
    """Images of one size as frames (n, height, width); of baseline images the brightness."""
    if any(map(is_baseline, images)):
        return np.stack([luma(x) if is_baseline(x) else jpeg_decode([x])[0] for x in images])
    parsed = [_parse(x) for x in images]
    sizes = {(t["height"], t["width"]) for t, _ in parsed}
    if len(sizes) != 1:
        raise ValueError("frames differ in size")
    ((height, width),) = sizes
    if any(t["tables"].get(t["table"]) != (_COUNTS, _VALUES) or t["predictor"] != 1 or t["shift"] for t, _ in parsed):
        return np.stack([_decode_plain(t, raw) for t, raw in parsed])
    samples = height * width
    size = -(-samples * 9 // 8)
    if any(len(raw) < size for _, raw in parsed):
        raise ValueError("a frame is cut short")
    groups = -(-samples // 8)
    p = np.frombuffer(b"".join(raw[:size] + bytes(groups * 9 - size) for _, raw in parsed), np.uint8).reshape(len(parsed), groups, 9).astype(np.uint16)
    u = np.empty((len(parsed), groups, 8), np.uint16)
    for k in range(8):
        u[..., k] = ((p[..., k] << (k + 1)) | (p[..., k + 1] >> (7 - k))) & 511
    d = _BACK[u.reshape(len(parsed), -1)[:, :samples]].astype(np.int32).reshape(len(parsed), height, width)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 0xFF).astype(np.uint8)


def _decode_plain(told: dict, raw: bytes) -> np.ndarray:
    """Any Huffman table and predictor, sample by sample."""
    counts, values = told["tables"][told["table"]]
    codes = {(length, code): v for v, (code, length) in _canonical(counts, values).items()}
    bits = iter(np.unpackbits(np.frombuffer(raw, np.uint8)).tolist())
    height, width, predictor = told["height"], told["width"], told["predictor"]
    x = np.zeros((height, width), np.int64)

    def read(n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | next(bits)
        return v

    for r in range(height):
        for c in range(width):
            code, length = 0, 0
            while (length, code) not in codes:
                code, length = code << 1 | next(bits), length + 1
                if length > 16:
                    raise ValueError("no such Huffman code")
            k = codes[length, code]
            d = 32768 if k == 16 else read(k)
            if 0 < k < 16 and d < 1 << (k - 1):
                d -= (1 << k) - 1
            if r == 0 and c == 0:
                guess = 1 << (7 - told["shift"])
            elif r == 0:
                guess = x[0, c - 1]
            elif c == 0:
                guess = x[r - 1, 0]
            else:
                a, b, e = int(x[r, c - 1]), int(x[r - 1, c]), int(x[r - 1, c - 1])
                guess = {1: a, 2: b, 3: e, 4: a + b - e, 5: a + ((b - e) >> 1), 6: b + ((a - e) >> 1), 7: (a + b) >> 1}[predictor]
            x[r, c] = (int(guess) + d) & 0xFFFF
    return (x << told["shift"]).astype(np.uint8)


# ---- RIFF ----


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def _list(name: bytes, *parts: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(parts))


def avi_write(payload: bytes, width: int = WIDTH, height: int = HEIGHT, rate: int = RATE) -> bytes:
    """An AVI file whose frames hold the payload's bytes as grey samples."""
    size = width * height
    n = max(1, -(-len(payload) // size))
    images = jpeg_encode(np.frombuffer(payload.ljust(n * size, b"\x00"), np.uint8).reshape(n, height, width))
    most = max(map(len, images))
    head = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, n, most, 10_000, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", size, 0, 0, 0, 0)
    movi, index, at = [], [], 4
    for x in images:
        c = _chunk(b"00dc", x)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(x)))
        movi.append(c)
        at += len(c)
    note = _list(b"INFO", _chunk(b"ICMT", f"payload {len(payload)}\x00".encode()))
    body = _list(b"hdrl", _chunk(b"avih", head), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", picture))) + note + _list(b"movi", *movi) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


class Avi:
    """A parsed file: rate, size, places of the frames, and the payload's length where the note tells it."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("no AVI file")
        self.data, self.rate, self.length = data, 0.0, None
        self.index: list[tuple[int, int]] | None = None
        self.movi = (0, 0)
        self._walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
        if not self.movi[0]:
            raise ValueError("an AVI file without frames")
        if self.index is None:
            self.index = [(at, n) for name, at, n in self._chunks(*self.movi) if name[2:] in (b"dc", b"db")]

    def _chunks(self, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        while at + 8 <= end:
            name, n = self.data[at : at + 4], struct.unpack_from("<I", self.data, at + 4)[0]
            if at + 8 + n > end:
                raise ValueError("a chunk is longer than what holds it")
            yield name, at + 8, n
            at += 8 + n + (n & 1)

    def _walk(self, at: int, end: int) -> None:
        for name, a, n in self._chunks(at, end):
            if name == b"LIST":
                kind = self.data[a : a + 4]
                if kind == b"movi":
                    self.movi = (a + 4, a + n)
                else:
                    self._walk(a + 4, a + n)
            elif name == b"avih":
                (self.micros,) = struct.unpack_from("<I", self.data, a)
                self.width, self.height = struct.unpack_from("<II", self.data, a + 32)
            elif name == b"strh" and self.data[a : a + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", self.data, a + 20)
                self.rate = rate / max(1, scale)
            elif name == b"ICMT":
                if m := re.match(rb"payload (\d+)\x00", self.data[a : a + n]):
                    self.length = int(m[1])
            elif name == b"idx1":
                rows = [struct.unpack_from("<4sIII", self.data, a + 16 * k) for k in range(n // 16)]
                rows = [(off, size) for name, _, off, size in rows if name[2:] in (b"dc", b"db")]
                # offsets count from the list's name, or, in some files, from the file's start
                base = self.movi[0] - 4 if rows and self.data[self.movi[0] - 4 + rows[0][0] :][2:4] in (b"dc", b"db") else 0
                self.index = [(base + off + 8, size) for off, size in rows]

    def frames(self) -> np.ndarray:
        return jpeg_decode([self.data[a : a + n] for a, n in self.index])

    def payload(self, frames: np.ndarray) -> bytes:
        raw = frames.tobytes()
        return raw if self.length is None else raw[: self.length]


# ---- shots ----


def shots(frames: np.ndarray, levels: int = LEVELS) -> list[int]:
    """First frames of shots: where the histogram's difference exceeds what the last differences let expect."""
    n = len(frames)
    if n == 1:
        return [0]
    level = (frames.reshape(n, -1) >> (9 - levels.bit_length())).astype(np.int64)
    hist = np.bincount((level + np.arange(n)[:, None] * levels).ravel(), minlength=n * levels).reshape(n, levels)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * level.shape[1])
    # mean and deviation of up to MEMORY differences before each
    one, two = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
    i = np.arange(len(diff))
    lo = np.maximum(0, i - MEMORY)
    count = np.maximum(1, i - lo)
    mean = (one[i] - one[lo]) / count
    spread = np.sqrt(np.maximum(0, (two[i] - two[lo]) / count - mean * mean))
    return [0, *(np.flatnonzero(diff > np.maximum(FLOOR, mean + THREE * spread)) + 1).tolist()]


def clips(data: bytes) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frames, start and end in seconds) of a file's shots."""
    v = Avi(data)
    begin = shots(v.frames())
    rate = v.rate or 1_000_000 / v.micros
    return [(k, a, b - a, a / rate, b / rate) for k, (a, b) in enumerate(zip(begin, [*begin[1:], len(v.index)], strict=True))]


# ---- DataFrames ----


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\x00")


def to_avi(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the text's payload as an AVI file."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, i = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            while i < len(ids):  # by bytes: media are larger than their texts, some much
                sizes, media, a = [], [], i
                while i < len(ids) and (i == a or sum(map(len, media)) < SENT_BYTES):
                    sizes.append(len((texts[i] or "").encode("utf-8", "surrogatepass")))
                    media.append(avi_write(padded(texts[i])))
                    i += 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:i], pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def write_media(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """The texts' files as a table at path: doc_id, n_bytes, media. Its row groups are small, as one is held whole where it is written or read."""
    to_avi(docs, key, text).write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).option("parquet.block.row.count.limit", GROUP_FILES).option("parquet.page.size.row.check.min", 1).parquet(path)


def clip_rows(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each clip of each file: doc_id, clip, first_frame, n_frames, start_s, end_s."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *c) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x is not None for c in clips(x)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["doc_id", "clip", "first_frame", "n_frames", "start_s", "end_s"])

    return media.select(quoted(key).cast("long").alias("doc_id"), quoted(column).alias("media")).mapInArrow(run, "doc_id long, clip int, first_frame long, n_frames long, start_s double, end_s double")


def features(media: bytes) -> dict:
    """What the stored bytes give: digests of the payload and of the file, and the shots as a text."""
    v = Avi(media)
    frames = v.frames()
    payload = v.payload(frames)
    begin = shots(frames)
    at = ",".join(f"{a / v.rate:.2f}" for a in begin)
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-BLOCK:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"{v.width}x{v.height}@{v.rate:g} frames={len(frames)} shots={len(begin)} at={at}",
    }


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_bytes and the features of every file that write_media() has stored at path."""
    ship(spark)
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in kinds.items())], names=["doc_id", "n_bytes", *kinds])

    stored = spark.read.parquet(path).select("doc_id", "n_bytes", "media")
    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_table(spark, "media")
    write_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), at)
    return read_features(spark, at)
