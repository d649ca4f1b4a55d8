import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from corvane.llm import token_align as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(ids, bytes) of A and of B for a whole text, or none."""
    a, b = libraries
    of = T.byte_level()
    want = (" " + (text or "")).encode()
    ids = a.encode(" " + (text or ""), add_special_tokens=False).ids
    left = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in ids]
    right = []
    for i in b.encode(text or ""):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    if not text or b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
        return [], []
    return left, right


def spans(toks):
    at = 0
    for i, x in toks:
        yield i, at, at + len(x)
        at += len(x)


def brute(libraries, rows):
    found = []
    for i, text in rows:
        left, right = (list(spans(t)) for t in tokens(libraries, text))
        both = sorted({e for *_, e in left} & {e for *_, e in right})
        groups, start = [], 0
        for e in both:
            groups.append(",".join(str(t) for t, s, f in left if start < f <= e) + "|" + ",".join(str(t) for t, s, f in right if start < f <= e))
            start = e
        links = [(x, y) for x, s, e in left for y, p, q in right if max(s, p) < min(e, q)] if len(left) < 400 else swept(left, right)
        found.append((i, len(left), len(right), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
    count = Counter(p for *_, links, _ in found for p in set(links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(i, a, b, g, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), sha) for i, a, b, g, links, sha in found]


def swept(left, right):
    out, k = [], 0
    for x, s, e in left:
        while right[k][2] <= s:
            k += 1
        j = k
        while j < len(right) and right[j][1] < e:
            out.append((x, right[j][0]))
            j += 1
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [(100, " "), (101, "  two  spaces "), (102, "a\n b\t c  d  e"), (103, "nul \x00 x"), (104, "it's we'll  they’re 12 345"), (105, "日本 語の テスト"), (106, "é é ﬁ 🙂 👩‍👩‍👧"), (107, "a\x1cb \x1c c\x85 d"), (108, "<0x41> <s> </s> <unk> <|endoftext|>x"), (109, "\n"), (110, "x" * 3000), (111, "﻿ z ​ y"), (112, "tail "), (113, "def f(x):\n    return  x\r\n")]


@pytest.mark.parametrize("most, kept", [(T.MOST, T.REMEMBERED), (0, 50)])
def test_query_is_brute_force(spark, written, odd_rows, libraries, monkeypatch, most, kept):
    monkeypatch.setattr(T, "REMEMBERED", kept)
    monkeypatch.setattr(T, "AT_ONCE", 3000 if not most else T.AT_ONCE)
    rows = [(i, t if t is None or len(t) < 20000 else t[:20000]) for i, t in odd_rows] + ODD
    docs = spark.read.parquet(f"{written(rows)}/documents.parquet")
    got = T.align(docs, A, B, most=most)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == sorted(brute(libraries, rows), key=repr)


def test_query_on_the_table(spark, libraries):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = T.op12_alignment(spark, d)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(brute(libraries, rows))


def test_empty_and_very_long(spark, written, tmp_path):
    assert T.op12_alignment(spark, written([])).collect() == []
    many = "word " * 200_000
    docs = spark.createDataFrame([(1, "ab" * 100_000), (2, many), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in T.align(docs, A, B).collect()}
    assert got[2]["n_groups"] >= 200_000 and got[1]["n_links"] >= got[1]["n_a"] > 0
    assert (got[None]["n_links"], got[None]["groups_sha256"]) == (0, "")


def test_overlaps():
    import numpy as np

    first, last, ends = T.overlaps(np.array([2, 3, 7, 9]), np.array([1, 3, 4, 9]))
    assert (first.tolist(), last.tolist(), ends.tolist()) == ([0, 1, 2, 3], [2, 2, 4, 4], [False, True, False, True])
