"""JPEG's baseline process, as motion JPEG of cameras has it: Huffman codes, dequantisation, inverse DCT, colours.

Read are 8-bit images (SOF0, and SOF1 with Huffman codes) of one or three components, of any sampling factors, in one
scan or a scan for each component, with restart intervals. Frames that leave their Huffman tables out get the usual ones.
Components of fewer samples are repeated to the image's size. A scan that ends early raises ValueError, and so does any
other process, code or table that isn't there.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

#: The place of each coefficient of a block, row by row, in the order in which they are stored.
ORDER = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))


def _usual(counts: str, head: str) -> tuple[bytes, list[int]]:
    """A table of runs and sizes: the values that head lists, then all others in natural order."""
    first = list(bytes.fromhex(head))
    return bytes.fromhex(counts), first + sorted({0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))} - set(first))


# The usual Huffman tables of the JPEG standard, by (class, place).
USUAL = {
    (0, 0): (bytes.fromhex("00010501010101010100000000000000"), list(range(12))),
    (0, 1): (bytes.fromhex("00030101010101010101010000000000"), list(range(12))),
    (1, 0): _usual("0002010303020403050504040000017d", "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    (1, 1): _usual("00020102040403040705040400010277", "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}

#: Rows of the cosine transform.
COSINE = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def is_baseline(data: bytes) -> bool:
    """Whether the image's frame header is one of this process."""
    at = 2
    while at + 4 <= len(data):
        _, marker, length = struct.unpack_from(">BBH", data, at)
        if marker in (0xC0, 0xC1):
            return True
        if marker == 0xDA or 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return False
        at += 2 + length
    return False


@lru_cache(64)
def _lookup(counts: bytes, values: tuple[int, ...]) -> list[int]:
    """For each 16 bits the length of the code that they begin with, and its value below; 0 where there is none."""
    out, code, at = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            start = code << (16 - length)
            out[start : start + (1 << (16 - length))] = [length << 8 | values[at]] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    if len(out) != 65536:
        raise ValueError("a Huffman table with too many codes")
    return out


class _Bits:
    """The bits of one restart interval; ones follow its end, and reading far beyond it raises."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def _fill(self, least: int) -> None:
        while self.n < least:
            if self.at >= len(self.data) + 8:
                raise ValueError("a scan is cut short")
            self.held = (self.held << 64 | int.from_bytes(self.data[self.at : self.at + 8].ljust(8, b"\xff"), "big")) & ((1 << (self.n + 64)) - 1)
            self.at += 8
            self.n += 64

    def code(self, table: list[int]) -> int:
        self._fill(16)
        found = table[self.held >> (self.n - 16) & 0xFFFF]
        if not found:
            raise ValueError("no such Huffman code")
        self.n -= found >> 8
        self.held &= (1 << self.n) - 1
        return found & 0xFF

    def number(self, size: int) -> int:
        """A signed number of so many bits."""
        if not size:
            return 0
        self._fill(size)
        self.n -= size
        x = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return x if x >> (size - 1) else x - (1 << size) + 1

    @property
    def ended_early(self) -> bool:
        return self.at * 8 - self.n > len(self.data) * 8


def _block(bits: _Bits, dc: list[int], ac: list[int], before: int, out: np.ndarray) -> int:
    before += bits.number(bits.code(dc))
    out[0] = before
    k = 1
    while k < 64:
        step = bits.code(ac)
        run, size = step >> 4, step & 15
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a block of more than 64 coefficients")
        out[k] = bits.number(size)
        k += 1
    return before


class _Image:
    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG image")
        self.quant: dict[int, np.ndarray] = {}
        self.tables = {k: None for k in USUAL}
        self.told = dict(USUAL)
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.coefficients: dict[int, np.ndarray] = {}
        self.restart = 0
        at = 2
        while at + 4 <= len(data) and data[at + 1] != 0xD9:
            _, marker, length = struct.unpack_from(">BBH", data, at)
            body, at = data[at + 4 : at + 2 + length], at + 2 + length
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                while body:
                    n, where = sum(body[1:17]), (body[0] >> 4, body[0] & 15)
                    self.told[where], self.tables[where] = (bytes(body[1:17]), list(body[17 : 17 + n])), None
                    body = body[17 + n :]
            elif marker == 0xDD:
                (self.restart,) = struct.unpack(">H", body[:2])
            elif marker in (0xC0, 0xC1):
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xDA:
                end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
                stop = end.start() if end else len(data)
                self._scan(body, data[at:stop])
                at = stop
        if not self.parts or set(self.parts) != set(self.coefficients):
            raise ValueError("an image without all its scans")

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
            body = body[65 + 64 * wide :]

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if bits != 8 or n not in (1, 3) or not self.height or not self.width:
            raise ValueError("only 8-bit images of one or three components are read")
        for k in range(n):
            name, by, table = body[6 + 3 * k : 9 + 3 * k]
            self.parts[name] = (by >> 4, by & 15, table) if n > 1 else (1, 1, table)
        self.across, self.down = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
        self.units = -(-self.height // (8 * self.down)), -(-self.width // (8 * self.across))

    def _table(self, kind: int, place: int) -> list[int]:
        if (kind, place) not in self.told:
            raise ValueError("a Huffman table that isn't there")
        if self.tables.get((kind, place)) is None:
            self.tables[kind, place] = _lookup(self.told[kind, place][0], tuple(self.told[kind, place][1]))
        return self.tables[kind, place]

    def _scan(self, body: bytes, raw: bytes) -> None:
        names = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
        rows, columns = self.units
        places = []
        for name, by in names:
            if name not in self.parts:
                raise ValueError("a scan of a component that isn't there")
            h, v, _ = self.parts[name]
            out = self.coefficients[name] = np.zeros((rows * v, columns * h, 64), np.int64)
            places.append((out, h, v, self._table(0, by >> 4), self._table(1, by & 15)))
        if len(places) == 1:  # blocks lie row by row, and only those that hold samples are there
            out, h, v, dc, ac = places[0]
            rows, columns = -(-(-(-self.height * v // self.down)) // 8), -(-(-(-self.width * h // self.across)) // 8)
            places = [(out, 1, 1, dc, ac)]
        total = rows * columns
        step = self.restart or total
        intervals = re.split(rb"\xff[\xd0-\xd7]", raw)
        if len(intervals) < -(-total // step):
            raise ValueError("a scan is cut short")
        for first, piece in zip(range(0, total, step), intervals, strict=False):
            bits, before = _Bits(piece), [0] * len(places)
            for unit in range(first, min(first + step, total)):
                y, x = divmod(unit, columns)
                for k, (out, h, v, dc, ac) in enumerate(places):
                    for j in range(v):
                        for i in range(h):
                            before[k] = _block(bits, dc, ac, before[k], out[y * v + j, x * h + i])
            if bits.ended_early:
                raise ValueError("a scan is cut short")

    def samples(self, name: int) -> np.ndarray:
        """A component at the image's size."""
        h, v, table = self.parts[name]
        if table not in self.quant:
            raise ValueError("a quantiser that isn't there")
        stored = self.coefficients[name]
        x = np.empty(stored.shape, np.float64)
        x[..., ORDER] = stored * self.quant[table]
        x = COSINE.T @ x.reshape(*stored.shape[:2], 8, 8) @ COSINE
        x = np.clip(np.rint(x + 128), 0, 255).astype(np.uint8)
        x = x.swapaxes(1, 2).reshape(stored.shape[0] * 8, stored.shape[1] * 8)
        down, across = np.arange(self.height) * v // self.down, np.arange(self.width) * h // self.across
        return x[np.ix_(down, across)]


def luma(data: bytes) -> np.ndarray:
    """The image's first component (height, width): its brightness."""
    image = _Image(data)
    return image.samples(next(iter(image.parts)))


def pixels(data: bytes) -> np.ndarray:
    """(height, width) of grey images, (height, width, 3) red, green and blue of others."""
    image = _Image(data)
    planes = [image.samples(name).astype(np.float64) for name in image.parts]
    if len(planes) == 1:
        return planes[0].astype(np.uint8)
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * r, y - (0.299 * 1.402 * r + 0.114 * 1.772 * b) / 0.587, y + 1.772 * b], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
