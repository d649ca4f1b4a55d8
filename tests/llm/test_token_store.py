import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import token_store as S

from .conftest import make_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_format(ids):
    s = S.Segment(S.pack(np.array(ids, np.uint32), [3, None], np.array([len(ids), 0])))
    assert s.all().tolist() == ids and s.doc_ids == [3, None]
    assert [s.get(i) for i in range(0, len(ids), 7)] == ids[::7]
    with pytest.raises(IndexError):
        s.get(len(ids))


def test_bad_bytes():
    with pytest.raises(ValueError):
        S.Segment(b"nothing of the kind")


def test_encoder(odd_rows):
    texts = [t or "" for _, t in odd_rows] + ["it's  a 'S  b\n\n c \x1c d", "é¼½ ʰ\x85y\xa0z", " ", "\n \n"]
    library = Tokenizer.from_file(PATH)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in S.Encoder(PATH).encode(texts)]
    assert got == want


def test_query(spark, written, odd_rows, monkeypatch):
    got = S.op4_tokens(spark, written(odd_rows)).collect()
    library = Tokenizer.from_file(PATH)
    rows = []
    for i, t in odd_rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        rows.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert sorted(((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got)) == sorted((i or -1, n, c) for i, n, c in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] or -1 for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids)


def test_empty(spark, written):
    assert S.op4_tokens(spark, written([])).collect() == []


def test_tokens_at(spark, tmp_path, odd_rows, monkeypatch):
    """Single tokens by document and place, out of many segments, are those of the library."""
    monkeypatch.setattr(S, "SEGMENT_BYTES", 2000)
    docs = make_docs(spark, odd_rows)
    S.write_tokens(docs, str(tmp_path / "t"), PATH, end=2)
    library = Tokenizer.from_file(PATH)
    ids = {}
    for i, t in odd_rows:
        ids.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    wanted = [(1, 0), (2, 0), (2, 1), (6, 0), (6, 17_000), (6, len(ids[6][0]) - 1), (6, len(ids[6][0])), (7, 5), (10, 3), (10, -1), (12345, 0), (6, 0)]
    got = S.tokens_at(spark, str(tmp_path / "t"), wanted)
    want = sorted((i, at, own[at]) for i, at in set(wanted) for own in ids.get(i, []) if 0 <= at < len(own))
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(low" in plan and "n_tokens" not in plan.split("ReadSchema")[1]
    assert S.tokens_at(spark, str(tmp_path / "t"), []).collect() == []


def test_ranges_grow_with_the_texts(spark, tmp_path, odd_rows, monkeypatch):
    make_docs(spark, odd_rows).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = []
    for size in (1 << 30, 1000):
        monkeypatch.setattr(S, "RANGE_BYTES", size)
        S.write_tokens(docs, str(tmp_path / f"t{size}"), PATH, end=2)
        got.append(spark.read.parquet(str(tmp_path / f"t{size}")).select("part").distinct().count())
    assert got[0] <= int(spark.conf.get("spark.sql.shuffle.partitions")) < got[1]
