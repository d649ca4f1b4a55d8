import hashlib
import random
import re

import pytest

from corvane.llm import decontam as D

from .conftest import make_docs


def brute_words(t):
    low = (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    out = []
    for i, t in rows:
        w, hit, names = brute_words(t), set(), set()
        for name, x in items:
            v = brute_words(x)
            for a in range(max(1, len(v) - 9) if v else 0):
                win = v[a : a + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        names |= {str(name)} if name is not None else set()
        out.append((i or -1, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def items(odd_rows):
    rng = random.Random(3)
    texts = {i: t for i, t in odd_rows if i is not None and t}
    passage = texts[31].split()
    return [(1, " ".join(passage[40:75])), (2, " ".join(passage[60:70]).upper()), (10, " ".join(texts[7].split()[5:9])), (11, "a"), (12, ""), (13, None), (None, " ".join(passage[80:95])), (14, "none of these " * 5), (2, "second text of item two, same id"), (15, " ".join(texts[6].split()[-12:])), (16, rng.choice(["тест", "тест"]))]


def test_query(spark, written, odd_rows, items):
    d = written(odd_rows, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = D.op5_decontaminate(spark, d).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == brute(odd_rows, items)


def test_blocks_change_nothing(spark, odd_rows, items):
    docs, bench = make_docs(spark, odd_rows), spark.createDataFrame(items, "item_id long, text string")
    take = lambda n: sorted(str((r["doc_id"], r["n_words"], r["hit"], r["items"])) for r in D.contamination(docs, bench, block_bytes=n)[0].collect())
    assert take(1 << 20) == take(200)


def test_empty(spark, odd_rows, items):
    docs, bench = make_docs(spark, odd_rows), spark.createDataFrame(items, "item_id long, text string")
    found, _ = D.contamination(docs, bench.limit(0))
    assert found.where("hit is not null").count() == 0 and found.count() == len(odd_rows)
    assert D.contamination(docs.limit(0), bench)[0].count() == 0


def test_clashing_names(spark, items):
    docs = make_docs(spark, [(1, "a b")]).selectExpr("doc_id", "text", "1 AS hit", "2 AS items", "3 AS N_Words")
    found, added = D.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert added == ["n_words_", "hit_", "items_"] and found.first()["items_"] == ["11"]
