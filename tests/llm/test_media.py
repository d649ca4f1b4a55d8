import hashlib
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from corvane.llm import media_avi as M

from .conftest import make_docs


@pytest.mark.parametrize("n", [64, 128, 2048, 2112, 9984])
def test_round_trip(n):
    payload = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    v = M.Avi(M.avi_write(payload))
    assert v.payload(v.frames()) == payload and v.rate == 25
    assert (v.width, v.height) == (64, 32) and len(v.index) == -(-n // 2048)


def test_plain_decoder_agrees():
    frames = np.random.default_rng(1).integers(0, 256, (2, 5, 7), dtype=np.uint8)
    for frame, image in zip(frames, M.jpeg_encode(frames), strict=True):
        assert (M._decode_plain(*M._parse(image)) == frame).all()


@pytest.mark.parametrize("predictor", [2, 3, 4, 5, 6, 7])
def test_other_tables_and_predictors(predictor):
    """An image coded sample by sample, with a flat table and another predictor."""
    frame = np.random.default_rng(predictor).integers(0, 256, (4, 6)).astype(np.int64)
    counts, values, codes = M._huffman({k: 4 for k in range(10)})
    bits = ""
    for r in range(4):
        for c in range(6):
            if r == 0 and c == 0:
                guess = 128
            elif r == 0:
                guess = frame[0, c - 1]
            elif c == 0:
                guess = frame[r - 1, 0]
            else:
                a, b, e = int(frame[r, c - 1]), int(frame[r - 1, c]), int(frame[r - 1, c - 1])
                guess = {2: b, 3: e, 4: a + b - e, 5: a + ((b - e) >> 1), 6: b + ((a - e) >> 1), 7: (a + b) >> 1}[predictor]
            d = int(frame[r, c]) - int(guess)
            k = abs(d).bit_length()
            code, length = codes[k]
            bits += f"{code:0{length}b}" + (f"{d if d > 0 else d + (1 << k) - 1:0{k}b}" if k else "")
    bits += "1" * (-len(bits) % 8)
    raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    image = b"\xff\xd8" + M._segment(0xC3, struct.pack(">BHHBBBB", 8, 4, 6, 1, 1, 0x11, 0)) + M._segment(0xC4, b"\x00" + counts + bytes(values)) + M._segment(0xDA, bytes([1, 1, 0, predictor, 0, 0])) + raw + b"\xff\xd9"
    assert (M.jpeg_decode([image])[0] == frame).all()


def test_index_and_its_absence():
    data = M.avi_write(b"ab" * 4000)
    at = data.index(b"idx1")
    bare = data[:at]
    bare = bare[:4] + struct.pack("<I", len(bare) - 8) + bare[8:]
    v, w = M.Avi(data), M.Avi(bare)
    assert v.index == w.index and (v.frames() == w.frames()).all()
    # offsets from the file's start
    base = v.movi[0] - 4
    rows = b"".join(b"00dc" + struct.pack("<III", 16, a - 8, n) for a, n in v.index)
    assert M.Avi(data[: at + 8] + rows).index == v.index and base > 0


def test_shots():
    assert M.clips(M.avi_write(b"a" * 20480 + b"Z" * 20480)) == [(0, 0, 10, 0.0, 0.4), (1, 10, 10, 0.4, 0.8)]
    assert len(M.clips(M.avi_write(b"a" * 64))) == 1


@pytest.mark.parametrize("bad", [b"", b"RIFF", b"x" * 400])
def test_bad_files(bad):
    with pytest.raises((ValueError, struct.error)):
        M.Avi(bad)


def plain_feature(payload):
    """The feature of a payload by loops over its frames, without any file."""
    n = M.WIDTH * M.HEIGHT
    frames = [payload[i : i + n].ljust(n, b"\0") for i in range(0, len(payload), n)]
    levels = [[sum(x * 16 // 256 == k for x in f) / n for k in range(16)] for f in frames]
    diff = [sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 2 for a, b in zip(levels, levels[1:], strict=False)]
    begin = [0]
    for i, d in enumerate(diff):
        last = diff[max(0, i - M.MEMORY) : i]
        mean = sum(last) / max(1, len(last))
        spread = max(0.0, sum(x * x for x in last) / max(1, len(last)) - mean * mean) ** 0.5
        if d > max(M.FLOOR, mean + M.THREE * spread):
            begin.append(i + 1)
    return f"{M.WIDTH}x{M.HEIGHT}@25 frames={len(frames)} shots={len(begin)} at=" + ",".join(f"{a / 25:.2f}" for a in begin)


def test_features_against_plain_loops(spark, written, odd_rows):
    rows = [*odd_rows, (900, "a" * 20480 + "Z" * 20480), (901, "".join(chr(33 + k // 900 % 90) for k in range(40000)))]
    want = {(i, t): plain_feature(M.padded(t)) for i, t in rows}
    assert any("shots=1 " not in f for f in want.values())
    got = M.op8_media(spark, written(rows)).collect()
    assert sorted((r["doc_id"] or -1, r["feature"]) for r in got) == sorted((i or -1, want[i, t]) for i, t in rows)


def test_stored_files(spark, tmp_path):
    """The table holds the files themselves; row groups are bounded though rows are large."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(33, 120, 300_000).astype(np.uint8).tobytes().decode()) for k in range(100, 160)] + [(k, "x" * k) for k in range(200, 500)] + [(1, None)]
    at = str(tmp_path / "media")
    M.write_media(make_docs(spark, rows).coalesce(1), at)
    stored = {r["doc_id"]: bytes(r["media"]) for r in spark.read.parquet(at).collect()}
    assert stored == {i: M.avi_write(M.padded(t)) for i, t in rows}
    (file,) = (tmp_path / "media").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
    assert max(g.total_byte_size for g in groups) < 3 * M.GROUP_BYTES and max(g.num_rows for g in groups) <= M.GROUP_FILES
    assert M.clip_rows(spark.read.parquet(at)).select("doc_id").distinct().count() == len(rows)


def test_query(spark, written, odd_rows):
    got = M.op8_media(spark, written(odd_rows)).collect()
    want = []
    for i, t in odd_rows:
        p = M.padded(t)
        raw = (t or "").encode()
        assert len(p) % 64 == 0 < len(p) and p.rstrip(b"\0") == raw.rstrip(b"\0")
        want.append((i or -1, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        key = tuple(r)[1:]
        assert by_text.setdefault((r["payload_sha256"], r["n_bytes"]), key) == key


def test_clip_rows_and_empty(spark, written):
    docs = make_docs(spark, [(1, "a" * 20480 + "Z" * 20480), (2, None)])
    rows = sorted(tuple(r) for r in M.clip_rows(M.to_avi(docs)).collect())
    assert rows == [(1, 0, 0, 10, 0.0, 0.4), (1, 1, 10, 10, 0.4, 0.8), (2, 0, 0, 1, 0.0, 0.04)]
    assert M.op8_media(spark, written([])).collect() == []
