import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from corvane.llm import piece_dropout as P

from .conftest import make_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")
PLAIN, DROPPED = P.Coder(PATH, 0.0), P.Coder(PATH, 0.3)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_lossless(text):
    for c in (PLAIN, DROPPED):
        (raw,) = c.encode([text], [5])
        assert c.decode(raw) == text


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abe thorin. \n é漢x"), max_size=120))
def test_without_dropout_as_the_library(text):
    assert ids(PLAIN.encode([text], [0])[0]) == LIBRARY.encode(text)


def test_rows_and_heap_agree(words):
    units = sorted({" " + w + v for w in words for v in ("", ",", "ly.")})
    for v in range(2):
        for u in units:
            if len(u) <= P.SHORT:
                assert DROPPED._rows([u], v, len(u))[0] == DROPPED._heap(u, v)


def test_varied_and_repeatable(words):
    text = " ".join(words)
    found = {DROPPED.encode([text], [k])[0] for k in range(40)}
    assert 1 < len(found) <= P.VARIANTS
    assert P.Coder(PATH, 0.3).encode([text], [3]) == DROPPED.encode([text], [3])
    assert P.Coder(PATH, 0.3, seed=99).encode([text], [3]) != DROPPED.encode([text], [3])
    assert len(ids(DROPPED.encode([text], [3])[0])) > len(LIBRARY.encode(text))
    # every id is a piece of the text: merges were skipped, nothing else
    assert all(0 < i < 32000 for i in ids(DROPPED.encode([text], [3])[0]))


def test_query(spark, written, odd_rows):
    got = P.op2_pieces(spark, written(odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(r["lossless"] for r in got)
    assert sorted(r["text_sha256"] or "" for r in got) == sorted("" if t is None else hashlib.sha256(t.encode()).hexdigest() for _, t in odd_rows)
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes())
    empty = [r for r in got if r["doc_id"] in (1, 2)]
    assert [r["n_tokens"] for r in empty] == [0, 0]


def test_decode_rows_and_empty(spark, odd_rows, written):
    docs = make_docs(spark, odd_rows)
    back = P.decode_ids(P.encode_texts(docs, PATH), PATH).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in odd_rows)
    assert P.op2_pieces(spark, written([])).collect() == []


def test_varied_by_document_and_place(words):
    unit = max(words, key=len)
    (raw,) = DROPPED.encode([" ".join([unit] * 400)], [3])
    assert DROPPED.decode(raw) == " ".join([unit] * 400)
    cuts = {tuple(ids(x)) for x in DROPPED.encode([unit] * 300, list(range(300)))}
    assert len(cuts) > 4
    (many,) = DROPPED.encode([" ".join([unit] * 400)], [3])
    alone = [tuple(ids(x)) for x in DROPPED._under_keys([" " + unit] * 400, DROPPED._keys([400], [3]))]
    assert len(set(alone)) > 4 and [i for x in alone for i in x] == ids(many)


def test_remembered_as_merged_anew(words):
    texts = [" ".join(words[k:] + words[:k] * 2) + " " + "x" * 60 for k in range(0, 40, 7)]
    for c in (P.Coder(PATH, 0.1), P.Coder(PATH, 0.0)):
        for t, raw in zip(texts, c.encode(texts, list(range(len(texts)))), strict=True):
            units = c.cut.findall(" " + t)
            assert b"".join(c._under_keys(units, c._keys([len(units)], [texts.index(t)]))) == raw


def naive(text, doc, dropout, seed=P.SEED):
    """One pair at a time, looked for from the start, with whole numbers of Python."""
    model = pb.ModelProto()
    model.ParseFromString(Path(PATH).read_bytes())
    score = {p.piece.replace("▁", " "): (-p.score, i) for i, p in enumerate(model.pieces) if p.type == 1}
    parts = {c for s in score for c in s}
    byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
    m, m1, m2 = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
    of, out = xxhash.xxh64_intdigest(str(doc).encode(), seed), []
    # a unit is a word with the spaces before it, spaces at the end, or an end of line
    units = re.findall(r" *[^ \n]+| +|\n", " " + text) if text else []
    for place, unit in enumerate(units):
        x = of + (place + 1) * m2 & m
        x = (x ^ x >> 32) * m1 & m
        key = x ^ x >> 29

        def skipped(a, b, c):
            x = key + (a << 42) + (b << 21) + c & m
            x = (x ^ x >> 30) * m1 & m
            x = (x ^ x >> 27) * m2 & m
            return (x ^ x >> 31) >> 11 < int(dropout * 2**53)

        cuts = list(range(len(unit) + 1))
        while True:
            known = [unit[a:b] in score or b - a == 1 and unit[a] in parts for a, b in zip(cuts, cuts[1:])]
            can = [(score[unit[a:c]], a, b) for (a, b, c), l, r in zip(zip(cuts, cuts[1:], cuts[2:]), known, known[1:]) if l and r and unit[a:c] in score and not skipped(a, b, c)]
            if not can:
                break
            cuts.remove(min(can)[2])
        for a, b in zip(cuts, cuts[1:]):
            out += [score[unit[a:b]][1]] if unit[a:b] in score else [byte[v] for v in unit[a:b].encode()]
    return out


def test_against_a_naive_agenda(words):
    texts = [" ".join(words[:150]), "the  responsibility of international\n\nanother  line of 漢字 text ▁ " + "ab" * 30 + " ", "", "\n", "a"] + [" ".join(["internationally"] * 60)]
    for dropout in (0.0, 0.1, 0.5):
        c = P.Coder(PATH, dropout)
        for _ in range(2):  # the second time units are remembered
            for k, raw in enumerate(c.encode(texts, list(range(len(texts))))):
                assert ids(raw) == naive(texts[k], k, dropout)
