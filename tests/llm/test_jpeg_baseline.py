import struct

import numpy as np
import pytest

from corvane.llm import jpeg_baseline as J
from corvane.llm import media_avi as M

ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def transform(block):
    """The cosine transform by its definition."""
    u = np.arange(8)
    wave = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    scale = np.where(u == 0, 0.5**0.5, 1) / 2
    return scale[:, None] * scale[None, :] * np.einsum("ux,vy,xy->uv", wave, wave, block)


def encode(planes, factors, quant=1, restart=0, tables=False, split=False):
    """A baseline image of planes that are sampled by factors (h, v); with restarts, own tables or a scan for each plane if told."""
    most = max(h for h, _ in factors), max(v for _, v in factors)
    height, width = planes[0].shape
    units = -(-height // (8 * most[1])), -(-width // (8 * most[0]))
    coded = [(0, 0) if k == 0 else (1, 1) for k in range(len(planes))]
    code = {(c, t): M._canonical(*J.USUAL[c, t]) for c in (0, 1) for t in (0, 1)}

    def number(d):
        k = abs(d).bit_length()
        return k, f"{d if d > 0 else d + (1 << k) - 1:0{k}b}" if k else ""

    def symbol(table, value):
        return "{:0{}b}".format(*code[table][value])

    def one(block, table, before):
        z = np.rint(transform(block.astype(float) - 128) / quant).astype(int).ravel()[ZIGZAG].tolist()
        k, tail = number(z[0] - before)
        out, run = symbol((0, table), k) + tail, 0
        for at in range(1, 64):
            if not any(z[at:]):
                return out + symbol((1, table), 0), z[0]
            if z[at]:
                k, tail = number(z[at])
                out, run = out + symbol((1, table), 0xF0) * (run // 16) + symbol((1, table), run % 16 << 4 | k) + tail, 0
            else:
                run += 1
        return out, z[0]

    padded = []
    for p, (h, v) in zip(planes, factors, strict=True):
        full = units[0] * v * 8, units[1] * h * 8
        padded.append(np.pad(p, [(0, full[0] - p.shape[0]), (0, full[1] - p.shape[1])], mode="edge"))

    def scan(names):
        before, bits, out, n = [0] * len(planes), "", [], 0
        single = len(names) == 1
        rows, columns = (-(-planes[names[0]].shape[0] // 8), -(-planes[names[0]].shape[1] // 8)) if single else units
        for y in range(rows):
            for x in range(columns):
                if restart and n and n % restart == 0:
                    out.append(bits)
                    before, bits = [0] * len(planes), ""
                n += 1
                for k in names:
                    h, v = (1, 1) if single else factors[k]
                    for j in range(v):
                        for i in range(h):
                            r, c = (y * v + j) * 8, (x * h + i) * 8
                            more, before[k] = one(padded[k][r : r + 8, c : c + 8], coded[k][0], before[k])
                            bits += more
        out.append(bits)
        body = b""
        for i, b in enumerate(out):
            b += "1" * (-len(b) % 8)
            body += (b"" if i == 0 else bytes([0xFF, 0xD0 + (i - 1) % 8])) + bytes(int(b[m : m + 8], 2) for m in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")
        told = bytes([len(names)]) + b"".join(bytes([k + 1, coded[k][0] << 4 | coded[k][1]]) for k in names) + b"\x00\x3f\x00"
        return M._segment(0xDA, told) + body

    image = b"\xff\xd8" + M._segment(0xDB, b"\x00" + bytes([quant] * 64))
    image += M._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(factors)))
    if tables:
        image += b"".join(M._segment(0xC4, bytes([c << 4 | t]) + J.USUAL[c, t][0] + bytes(J.USUAL[c, t][1])) for c, t in J.USUAL)
    if restart:
        image += M._segment(0xDD, struct.pack(">H", restart))
    scans = [[k] for k in range(len(planes))] if split else [list(range(len(planes)))]
    return image + b"".join(map(scan, scans)) + b"\xff\xd9"


def noise(seed, *shape):
    return np.random.default_rng(seed).integers(0, 256, shape).astype(np.uint8)


def far(a, b):
    return np.abs(a.astype(int) - b.astype(int)).max()


def test_fixed_values():
    assert J.ORDER == ZIGZAG
    for (kind, _), (counts, values) in J.USUAL.items():
        assert sum(counts) == len(values) == len(set(values)) == (162 if kind else 12)


@pytest.mark.parametrize("restart,tables", [(0, False), (2, True), (1, False)])
@pytest.mark.parametrize("shape", [(8, 8), (13, 21), (1, 40)])
def test_grey(shape, restart, tables):
    frame = noise(3, *shape)
    image = encode([frame], [(1, 1)], restart=restart, tables=tables)
    assert J.is_baseline(image) and far(J.luma(image), frame) <= 1 and J.pixels(image).shape == shape


@pytest.mark.parametrize("factors", [(1, 1), (2, 1), (2, 2)])
@pytest.mark.parametrize("split", [False, True])
def test_three_components(factors, split):
    h, v = factors
    y = noise(1, 19, 37)
    small = [noise(k, -(-19 // v), -(-37 // h)) for k in (2, 3)]
    image = encode([y, *small], [factors, (1, 1), (1, 1)], restart=0 if split else 3, tables=split, split=split)
    assert far(J.luma(image), y) <= 1
    inner = J._Image(image)
    for name, plane in zip((2, 3), small, strict=True):
        assert far(inner.samples(name), plane.repeat(v, 0).repeat(h, 1)[:19, :37]) <= 1


def test_colours():
    """Red, by the usual conversion: Y 76, Cb 85, Cr 255."""
    image = encode([np.full((8, 8), c, np.uint8) for c in (76, 85, 255)], [(1, 1)] * 3)
    assert far(J.pixels(image), np.broadcast_to(np.array([254, 0, 0]), (8, 8, 3))) <= 1


def test_coarse_quantiser():
    frame = np.add.outer(np.arange(16) * 8, np.arange(24) * 5).astype(np.uint8)
    assert far(J.luma(encode([frame], [(1, 1)], quant=16)), frame) <= 24


def test_clip_of_baseline_frames():
    """Grey steps with a cut after six of ten frames, as a camera's AVI: baseline frames, no note, no index."""
    images = [encode([np.full((16, 16), 40 if k < 6 else 200, np.uint8)], [(1, 1)]) for k in range(10)]
    made = M.avi_write(b"x")
    at = made.index(b"LIST", made.index(b"hdrl") + 200) if made.find(b"INFO") < 0 else made.index(b"INFO") - 8
    body = made[12:at] + M._list(b"movi", *[M._chunk(b"00dc", x) for x in images])
    clip = M._chunk(b"RIFF", b"AVI " + body)
    assert M.Avi(clip).frames()[:, 3, 3].tolist() == [40] * 6 + [200] * 4
    assert M.clips(clip) == [(0, 0, 6, 0.0, 0.24), (1, 6, 4, 0.24, 0.4)]


@pytest.mark.parametrize("spoil", [lambda x: x[:-40], lambda x: x.replace(b"\xff\xc0", b"\xff\xc2"), lambda x: b"\xff\xd8\xff\xd9", lambda x: x[:80]])
def test_bad_images(spoil):
    with pytest.raises((ValueError, struct.error)):
        J.luma(spoil(encode([noise(5, 24, 24)], [(1, 1)])))
