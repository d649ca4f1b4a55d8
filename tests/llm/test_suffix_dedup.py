import hashlib
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import suffix_dedup as S

from .conftest import make_docs


def brute(rows, window):
    """(id, n_bytes, n_removed, n_spans, digest) of every row; rows equal in id and text are one document."""
    rank = lambda i: (1 << 63) - 1 if i is None else i
    docs = sorted({(rank(i), hashlib.sha256((t or "").encode()).digest(), (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for i, sha, b in docs:
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            if w in seen:
                gone[k : k + window] = [True] * window
            seen.add(w)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i, sha] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return sorted((rank(i), *out[rank(i), hashlib.sha256((t or "").encode()).digest()]) for i, t in rows)


def plain(rows):
    return sorted(((1 << 63) - 1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, rows))


@pytest.mark.parametrize(("hot", "part_bytes"), [(S.HOT, S.PART_BYTES), (S.HOT, 4096), (2, 4096)])
def test_against_brute_force(spark, odd_rows, hot, part_bytes):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdé ") for _ in range(3000))
    rows = odd_rows + [(100 + k, base[rng.randrange(2000) :][: rng.randrange(50, 900)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(200)))) for k in range(40)]
    rows += [(200, "q" * 99), (201, "q" * 100), (202, "q" * 101), (203, base[:100]), (204, base[50:149])]
    got = S.removed(make_docs(spark, rows), hot=hot, part_bytes=part_bytes).collect()
    assert plain(got) == brute(rows, 100)


def test_query_and_empty(spark, written, odd_rows):
    assert plain(S.op10_repeats(spark, written(odd_rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute(odd_rows, 100)


def test_empty(spark, written):
    assert S.op10_repeats(spark, written([])).collect() == []


def test_without_repeats(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefé") for _ in range(n))
    a, b, c = text(400), text(300), text(200)
    docs = make_docs(spark, [(1, a), (2, b + a[100:300] + c), (3, a), (4, "short"), (5, "short"), (6, None)])
    got = {r["doc_id"]: r for r in S.without_repeats(docs).collect()}
    assert sorted(got) == [1, 2, 4, 5, 6]
    assert got[1]["text"] == a and got[2]["text"] == b + c and got[2]["shard"] == 5 and got[2]["a.b"] == "x"


def test_layout():
    """Spark takes 100,000 buckets at most; parts stay small at any size of text."""
    assert S.layout(0) == (1, 1) and S.layout(S.PART_BYTES * 9) == (9, 2)
    for parts in (10**6, 10**8):
        n, buckets = S.layout(parts * S.PART_BYTES)
        assert n == parts and buckets <= 100_000
    assert S.layout(1 << 60)[0] < 1 << 31


@pytest.mark.parametrize("hot", [2, S.HOT])
def test_many_parts_in_a_bucket(spark, odd_rows, hot):
    got = S.removed(make_docs(spark, odd_rows), part_bytes=512, hot=hot, most_buckets=3)
    assert plain(got.collect()) == brute(odd_rows, 100)


def test_hot_windows_pass_in_batches():
    """Equal windows over many batches, and different windows of one hash, against a plain loop."""
    rng = random.Random(5)
    rows = sorted((rng.randrange(4), k, rng.choice([b"aaaa", b"bbbb", b"cccc"])) for k in range(400))
    for size in (1, 7, 400):
        passed, got = S.Again(4), []
        for a in range(0, len(rows), size):
            some = rows[a : a + size]
            got += passed.of(np.array([g for g, *_ in some]), np.frombuffer(b"".join(w for *_, w in some), np.uint8).reshape(-1, 4)).tolist()
            assert len(passed.first) == 1 and len(passed.others) <= 2
        seen = set()
        want = [(g, w) in seen or seen.add((g, w)) is not None for g, _, w in rows]
        assert got == want


def test_radix():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, (300, 21)).astype(np.uint8)
    rows[100:200] = rows[:100]
    order, shared = S.radix(rows)
    keys = [bytes(rows[k]) for k in order]
    assert keys == sorted(keys)
    for k in range(1, 300):
        n = next((j for j in range(21) if keys[k][j] != keys[k - 1][j]), 21)
        assert shared[k] == n


def test_wide_rows(spark):
    docs = make_docs(spark, [(1, "z" * 150)]).withColumn("part", F.lit("clash")).withColumn("text_", F.lit(1))
    assert S.without_repeats(docs).first()["part"] == "clash"


def test_hot_windows_are_compared_by_their_bytes(spark):
    rng = random.Random(8)
    tail = "".join(rng.choice("xyz") for _ in range(67))
    rows = [(k, f"{a}{b}{'x' * 30}{c}{tail}") for k, (a, b, c) in enumerate((a, b, c) for a in "ab" for b in "0123456789" for c in "0123456789")]
    rows += [(500 + i, t) for i, t in rows[::7]]
    rows += [(1000 + k, "w" * 30 + t) for k, t in rows[:20]]
    assert plain(S.removed(make_docs(spark, rows), hot=2, part_bytes=256).collect()) == brute(rows, 100)


def test_hash_gives_swapped_bytes_another_value():
    base = np.frombuffer(bytes(range(100, 200)), np.uint8)
    found = []
    for i in range(100):
        for j in range(i):
            w = base.copy()
            w[[i, j]] = w[[j, i]]
            found.append(int(S._hash(w, 100, 1)[0]))
    assert len(set(found)) == len(found) == 4950


def test_short_periods(spark):
    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = ["-" * 900, say(150) + "-" * 700 + say(150), ("ab" * 300) + say(90) + ("abc" * 200), "x" * 99 + "y" * 101, ("0123456789abcdef" * 60), ("0123456789abcdefg" * 60), "-" * 100, say(130) + "é" * 300, "z" * 100 + "z", "-" * 899 + "!" + "-" * 899]
    rows = list(enumerate(texts))
    for hot in (2, 20_000):
        got = S.removed(spark.createDataFrame(rows, "doc_id long, text string"), part_bytes=700, hot=hot)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute(rows, 100)))


def test_memory_of_one_byte():
    """16 MB of one byte in one part, in a process of its own."""
    code = """
import resource, pyarrow as pa
from corvane.llm import suffix_dedup as S
t = pa.table({"part": pa.array([0], pa.int32()), "sha": pa.array([b"s" * 32]), "id": pa.array([1], pa.int64()), "text": pa.array(["-" * (16 << 20)])})
first = S._first_digits(100, 32)(t)
counted = first.append_column("hot", pa.array([False] * first.num_rows)).append_column("elsewhere", pa.array([False] * first.num_rows))
moved = S._sort_part(100, 32)(t, counted)
spans = moved.select(["part", "doc", "start", "stop"])
(row,) = S._cut_part(100, False)(t, spans).to_pylist()
print(row["n_removed"], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == (16 << 20) - 1 and int(out[1]) < 1500
