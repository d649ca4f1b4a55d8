import random
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm import simhash as S
from corvane.llm.components import connected_components


def brute_fp(text):
    low = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in __import__("re").split(rb"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(fps, ids):
    """Smallest id of each fingerprint's component."""
    fps = np.array(fps, np.uint64)
    least, seen = {}, set()
    for k in range(len(fps)):
        if k in seen:
            continue
        stack, own = [k], {k}
        while stack:
            x = stack.pop()
            for y in np.flatnonzero(np.bitwise_count(fps ^ fps[x]) <= 3).tolist():
                if y not in own:
                    own.add(y)
                    stack.append(y)
        seen |= own
        known = [ids[y] for y in own if ids[y] is not None]
        for y in own:
            least[y] = min(known) if known else None
    return [least[k] for k in range(len(fps))]


def test_query(spark, written, odd_rows):
    got = S.op7_near_dup(spark, written(odd_rows)).collect()
    fps = [brute_fp(t) for _, t in odd_rows]
    want = sorted((i or -1, f"{f:016x}", c or -1) for (i, _), f, c in zip(odd_rows, fps, brute_components(fps, [i for i, _ in odd_rows]), strict=True))
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"] or -1) for r in got) == want


def test_empty(spark, written):
    assert S.op7_near_dup(spark, written([])).collect() == []


def test_golay():
    g = S.golay()
    assert (g.patterns[:, 0] >= 0).all()  # every remainder has a pattern of up to 3 bits: the code is perfect
    assert sorted(set((g.patterns >= 0).sum(axis=1).tolist())) == [1, 6]
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 500)
    y = x ^ (1 << rng.integers(0, 23, 500))
    near = g.keys(y)
    assert all(g.keys(x)[k, 0] in near[k] for k in range(500))


def test_no_pair_is_missed():
    rng = random.Random(5)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        row, key = S.keys_of(np.array([x, y], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_large_groups():
    rng = random.Random(6)
    fps = sorted({rng.getrandbits(64) & 0x3FF | 0xABC << 40 for _ in range(300)})
    got = S.links_in_sorted(np.zeros(len(fps), np.int64), np.array(fps, np.uint64))
    assert len(got) < len(fps)
    part = list(range(len(fps)))

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    place = {f: k for k, f in enumerate(fps)}
    for a, b in got.tolist():
        assert (a ^ b).bit_count() <= 3
        part[root(place[a])] = root(place[b])
    want = brute_components(fps, list(range(len(fps))))
    assert len({root(k) for k in range(len(fps))}) == len(set(want))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (200, 200), (7, 300)] + [(500, 600 + k) for k in range(30)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[300] == 0 and got[100] == got[101] == 100
    assert all(got[600 + k] == 500 for k in range(30)) and 200 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_of_one_hash_stay(spark, monkeypatch):
    """Different rows that share one of the two hashes of their keys are different rows."""
    plain = common.row_hash
    monkeypatch.setattr(common, "row_hash", lambda df, *salt: plain(df, *salt) if salt else F.lit(7).cast("long"))
    docs = spark.createDataFrame([(i, f"text number {i} " + " ".join(str(i * k % 97) for k in range(40))) for i in range(20)] * 2, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.representatives(docs).collect()) == list(range(20))


def test_one_key_of_many_fingerprints():
    """A code of distance 4 in 21 bits: no two fingerprints are linked, and all have one key."""
    x = np.arange(1 << 20, dtype=np.uint64)
    x = x[np.bitwise_count(x & np.uint64(0x55555)) % 2 == 0]
    x = x[np.bitwise_count(x & np.uint64(0xAAAAA)) % 2 == 0]
    x = x[: 1 << 16]
    far = x << np.uint64(8) | x << np.uint64(32)  # each bit twice, so 2 differing bits become 4
    begin = time.time()
    assert len(S.links_in_sorted(np.zeros(len(far), np.int64), far)) == 0
    assert len(far) == 1 << 16 and time.time() - begin < 60
    near = np.unique(np.concatenate([far[:3000], far[:3000] ^ np.uint64(1)]))
    got = S.links_in_sorted(np.zeros(len(near), np.int64), near)
    assert len({tuple(x) for x in got.tolist()}) == 3000


def test_likeliest_pairs_grow_with_the_rows():
    """Of a group of near copies each set gives the pair whose bitmaps differ least, and no more."""
    import numpy as np

    from corvane.llm import shingle_links as L

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 200, np.uint64)
    sets = [np.sort(np.concatenate([base[rng.permutation(200)[:185]], rng.integers(0, 1 << 64, 6, np.uint64)])) for _ in range(150)]
    bits, sid = [L.bitmap(s) for s in sets], np.arange(150)
    args = np.zeros(150, int), sid, sid, np.array([len(s) << 32 for s in sets]), np.zeros(150, int), bits, 0.8
    every = np.concatenate(list(L.pairs_in_sorted(*args)))
    one = np.concatenate(list(L.pairs_in_sorted(*args, nearest=True)))
    assert len(every) > 5000 and len(one) <= 150 and set(map(tuple, np.sort(one, axis=1))) <= set(map(tuple, np.sort(every, axis=1)))
    folded = L.Folded(bits)
    mate = dict(one.tolist())
    for k in range(150):
        others = np.array([j for j in range(150) if j != k])
        assert folded.differ(np.array([k]), np.array([mate[k]]))[0] == folded.differ(np.full(149, k), others).min()
