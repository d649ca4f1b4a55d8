"""Benchmark passages in documents: a set join filtered by prefixes, verified word by word.

An item's windows are its runs of 10 consecutive words; an item of fewer words, but not none, is one
window. A document contains a window if all the window's shingles (3 words; fewer in shorter windows)
are found in it, so by the prefix filter at full containment one shingle, the rarest over all
documents, must be found. The search joins the documents' shingles with these prefixes; the place of
the prefix in the window gives the place of the candidate (positional bound), which must lie inside its
document (length bound), and is then verified word by word.

The benchmark is not collected: its words go to the workers in blocks of a bounded number of bytes, and
each block is one more pass over the rows, which carry their hits along; no block drops anything.

Cases: null and empty texts have no words and no hits; an item without words occurs nowhere; repeated
items with one id count once, null item ids are not named; repeated rows are judged alike; an empty
benchmark hits nothing; other columns stay as they are, and added ones get names that are free.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, quoted, ship

WINDOW, SHINGLE = 10, 3
#: Bytes of benchmark text in one block; what a worker holds of the benchmark at once is a few times that.
BLOCK_BYTES = 8 << 20

#: A-Z in lower case; every other ASCII character but 0-9 and a-z parts words.
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Index:
    """The windows of one block of items, by shingle."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, shingle: int = SHINGLE):
        split = [(i, words_of(x)) for i, x in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        owners: dict[tuple[int, ...], set[str]] = {}
        for i, ws in split:
            ids = [self.vocabulary[w] for w in ws]
            for a in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[a : a + window]), set()).update([i] if i is not None else [])
        self.windows = sorted(owners)
        self.owners = [owners[w] for w in self.windows]
        self.shingle = shingle
        # shingles of each length that windows need, as sorted codes
        self.base = len(self.vocabulary) + 1
        if self.base**shingle >= 1 << 63:
            raise ValueError("a block of items has too many words; take smaller blocks")
        found: dict[int, set[int]] = {}
        for w in self.windows:
            q = min(shingle, len(w))
            found.setdefault(q, set()).update(self._code(w[o : o + q]) for o in range(len(w) - q + 1))
        self.codes = {q: np.array(sorted(c), np.int64) for q, c in found.items()}

    def _code(self, ids) -> int:
        code = 0
        for x in ids:
            code = code * self.base + x + 1
        return code

    def ids(self, lists: list[list[bytes]]) -> np.ndarray:
        """The words of all lists as ids, -1 for words of no item and after each list."""
        get = self.vocabulary.get
        out = np.full(sum(map(len, lists)) + len(lists), -1, np.int64)
        at = 0
        for ws in lists:
            out[at : at + len(ws)] = np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws))
            at += len(ws) + 1
        return out

    def found(self, ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a shingle of length q of any window begins, and its number."""
        known = ids >= 0
        ok = known[: len(ids) - q + 1].copy()
        for d in range(1, q):
            ok &= known[d : len(ids) - q + 1 + d]
        at = np.flatnonzero(ok)
        code = np.zeros(len(at), np.int64)
        for d in range(q):
            code = code * self.base + ids[at + d] + 1
        table = self.codes[q]
        k = np.minimum(np.searchsorted(table, code), len(table) - 1)
        same = table[k] == code
        return at[same], k[same]

    def prefixes(self, counts: dict[int, np.ndarray]) -> None:
        """Chooses each window's rarest shingle, by its count over all documents."""
        self.by_prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for n, w in enumerate(self.windows):
            q = min(self.shingle, len(w))
            each = [int(np.searchsorted(self.codes[q], self._code(w[o : o + q]))) for o in range(len(w) - q + 1)]
            o = min(range(len(each)), key=lambda j: (counts[q][each[j]], each[j], j))
            self.by_prefix.setdefault(q, {}).setdefault(each[o], []).append((n, o))
        self.arrays = [np.array(w, np.int64) for w in self.windows]

    def occurrences(self, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(window, places where it begins) of each window found."""
        out = []
        for q, wanted in self.by_prefix.items():
            at, k = self.found(ids, q)
            is_prefix = np.zeros(len(self.codes[q]), bool)
            is_prefix[list(wanted)] = True
            keep = is_prefix[k]
            at, k = at[keep], k[keep]
            if not len(k):
                continue
            order = np.argsort(k, kind="stable")
            at, k = at[order], k[order]
            cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(k)], strict=True):
                for n, o in wanted[int(k[a])]:
                    w = self.arrays[n]
                    begin = at[a:b] - o
                    begin = begin[(begin >= 0) & (begin + len(w) <= len(ids))]
                    for d in range(len(w)):  # the marks after each document equal no word, so no window crosses them
                        begin = begin[ids[begin + d] == w[d]]
                        if not len(begin):
                            break
                    if len(begin):
                        out.append((n, begin))
        return out


def _groups(texts: list[str | None], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held < most):
            held += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def _counter(index):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Index = index.value
        total = {q: np.zeros(len(c), np.int64) for q, c in x.codes.items()}
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in _groups(texts):
                ids = x.ids([words_of(t) for t in texts[i:j]])
                for q in total:
                    total[q] += np.bincount(x.found(ids, q)[1], minlength=len(total[q]))
        for q, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int32)), pa.array(at), pa.array(c[at])], names=["q", "k", "n"])

    return count


def _search(index):
    """Adds a block's hits to n_words, hit (bits) and items of each text."""

    def search(column: pa.Array, old: list[pa.Array]) -> list[pa.Array]:
        x: Index = index.value
        texts, hits, items, counts = column.to_pylist(), old[1].to_pylist(), old[2].to_pylist(), []
        for i, j in _groups(texts):
            lists = [words_of(t) for t in texts[i:j]]
            sizes = np.array([len(w) for w in lists], np.int64)
            counts += sizes.tolist()
            starts = np.cumsum(sizes + 1) - sizes - 1
            ids = x.ids(lists)
            edge, owners = np.zeros(len(ids) + 1, np.int64), {}
            for n, begin in x.occurrences(ids):
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + len(x.windows[n]), -1)
                for d in np.unique(np.searchsorted(starts, begin, side="right") - 1).tolist():
                    owners.setdefault(d, set()).update(x.owners[n])
            covered = np.cumsum(edge)[:-1] > 0
            for d, own in owners.items():
                mine = np.packbits(covered[starts[d] : starts[d] + sizes[d]])
                if hits[i + d]:
                    mine = mine | np.frombuffer(hits[i + d], np.uint8)
                hits[i + d] = mine.tobytes()
                items[i + d] = sorted({*(items[i + d] or []), *own})
        return [pa.array(counts, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]

    return search


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and their names: n_words, hit (bits of the words hit, null if none), items (sorted ids as strings, null if none)."""
    spark = docs.sparkSession
    ship(spark)
    bench = benchmark.select(quoted(item).cast("string").alias("i"), quoted(item_text).alias("t")).distinct()
    total = bench.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    bench = bench.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    steps = []
    for k in range(blocks):
        # one block is bounded by its bytes: it goes to the driver and to every worker
        index = Index([(r["i"], r["t"]) for r in bench.where(F.col("block") == k).select("i", "t").collect()])
        counts = {q: np.zeros(len(c), np.int64) for q, c in index.codes.items()}
        if index.windows:
            each = docs.select(quoted(text).alias("t")).mapInArrow(_counter(spark.sparkContext.broadcast(index)), "q int, k long, n long")
            for r in each.groupBy("q", "k").agg(F.sum("n").alias("n")).collect():  # one row for each shingle of the block at most
                counts[r["q"]][r["k"]] = r["n"]
        index.prefixes(counts)
        steps.append(_search(spark.sparkContext.broadcast(index)))
    return added(docs, text, "n_words long, hit binary, items array<string>", *steps)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, (n_words, hit, items) = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.coalesce(F.col(items), F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        F.coalesce(bits_set(F.col(hit)), F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        F.col(hit).isNotNull().alias("contaminated"),
    )


def bits_set(bits):
    """How many bits of a binary column are 1, from its hexadecimal digits."""
    shown = F.hex(bits)
    return sum((F.char_length(F.regexp_replace(shown, f"[^{digits}]", "")) * n for n, digits in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F"))), F.lit(0))


ORACLE_OP5 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), hits AS (
  SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
