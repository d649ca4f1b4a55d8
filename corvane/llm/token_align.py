"""How the tokens of two tokenizers lie over each other.

A text's tokens of B are intervals of its bytes, sorted and without overlap: a static index. For each token of A two bisections
of B's ends and starts (stabbing queries) give the run of B's tokens that overlap it; each overlap is a link. Where a token of A ends
and no token of B spans the gap, a group of tokens ends.

No token of either goes on into a single space between two visible characters, so both end there, and texts are cut into words at
such spaces. A worker aligns many new words at once and remembers them; a text's values are put together from its words'. (Where a
model has pieces that do go on into a space, texts stay whole.)

The links of each document are stored once, as its distinct pairs of ids with how often each occurs. A pair is counted once for each
document, over all documents, and each id of A gets its highest count. The counts go out as sorted arrays if there are MOST pairs or
fewer (16 bytes each); beyond, links and counts are joined. Both ways give the same rows.

Cases: texts that are null or empty, and texts that either tokenizer does not give back byte by byte (such as those with U+2581), have
no tokens; special tokens' strings are plain text; a null id stays; repeated rows and ids each have their own row, and each counts as a document;
a text without a space is one long word; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_table, quoted, ship

#: Pairs of ids that are sent to all tasks at most.
MOST = 4_000_000
#: Words and characters of words that a worker remembers; characters from which a word isn't remembered; characters of texts taken at once.
REMEMBERED, KEPT_CHARS, LONG, AT_ONCE = 300_000, 24 << 20, 64, 2 << 20
#: Before a space between two visible characters.
CUT = re.compile(r"(?<=[\x21-\x7e\w])(?= [\x21-\x7e\w])")
#: Texts in which every space is such a one.
ODD = re.compile(r"[^\x21-\x7e\w] |^ | $| [^\x21-\x7e\w]")
SPACE = "▁"


def byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible ones stand for themselves, all others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of A the run [first, last) of B's tokens that overlap it, and whether a group ends with it. Ends are ascending offsets over the same bytes."""
    a_start, b_start = (np.concatenate([[0], x[:-1]]) for x in (a_end, b_end))
    first, last = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_start, a_end, side="left")
    return first, last, b_end[last - 1] == a_end


class Aligner:
    """Both tokenizers of a worker, and the words that it remembers."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            pre = json.load(f).get("pre_tokenizer") or {}
        of = byte_level()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            if all(c in of for c in t):
                self.a_bytes[i] = bytes(of[c] for c in t)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        # an id with what follows it: a comma within a group's ids, else the sign after A's or B's part
        self.a_text = [f"{i}{s}" for i in range(len(self.a_bytes)) for s in ",|"]
        self.b_text = [f"{i}{s}" for i in range(n) for s in ",;"]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.text: list[str] = []
        self.told = np.empty((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whether both tokenizers give the word back
        self.first, self.pair, self.times = np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Aligns words, each with a space before it."""
        raw = [(" " + w).encode() for w in words]
        a = [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        b = self.b.encode(words, num_threads=1)
        good = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, r in zip(a, b, raw, strict=True)], bool)
        a, b = ([x if ok else [] for x, ok in zip(of, good.tolist(), strict=True)] for of in (a, b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in (a, b))
        of_a, of_b = np.repeat(np.arange(len(words)), n_a), np.repeat(np.arange(len(words)), n_b)
        links, groups, text, pairs, times, many = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [""] * len(words), [], [], np.zeros(len(words), np.int64)
        if len(ids_a):
            a_end, b_end = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
            first, last, ends = overlaps(a_end, b_end)
            links, groups = (np.bincount(of_a, w, len(words)).astype(np.int64) for w in (last - first, ends))
            # the text of groups: A's and B's tokens in order of (group, side)
            group_a = np.cumsum(ends) - ends
            group_b = np.searchsorted(a_end[ends], b_end, side="left")
            b_last = np.concatenate([group_b[1:] != group_b[:-1], [True]])
            order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
            sides = [*map(self.a_text.__getitem__, (2 * ids_a + ends).tolist()), *map(self.b_text.__getitem__, (2 * ids_b + b_last).tolist())]
            owner = np.concatenate([of_a, of_b])[order]
            cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
            line = [sides[k] for k in order.tolist()]
            text = ["".join(line[i:j])[:-1] for i, j in itertools.pairwise(cuts)]
            # distinct pairs of each word
            span = last - first
            code = np.repeat(ids_a, span) << 32 | ids_b[np.repeat(first - np.cumsum(span) + span, span) + np.arange(int(span.sum()))]
            word = np.repeat(of_a, span)
            order = np.lexsort((code, word))
            code, word = code[order], word[order]
            new = np.concatenate([[True], (code[1:] != code[:-1]) | (word[1:] != word[:-1])])
            at = np.flatnonzero(new)
            pairs, times = [code[at]], [np.diff(np.append(at, len(code)))]
            many = np.bincount(word[at], minlength=len(words))
        self.known.update(zip(words, range(len(self.text), len(self.text) + len(words)), strict=True))
        self.held += sum(map(len, words))
        self.text += text
        self.told = np.concatenate([self.told, np.stack([n_a, n_b, groups, links, good], axis=1)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(many)])
        self.pair, self.times = np.concatenate([self.pair, *pairs]), np.concatenate([self.times, *times])

    def words(self, text: str) -> list[str]:
        """The words of a text that isn't empty, without the space before each."""
        if not self.by_word:
            return [text]
        return [w[1:] for w in CUT.split(" " + text)] if ODD.search(text) else text.split(" ")

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(n, 4) of n_a, n_b, n_groups and n_links, digests of the groups, distinct pairs and their times, and how many of them each text has."""
        parts = [self.words(t) if t and SPACE not in t else [] for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = list(itertools.chain.from_iterable(parts))
        new = list(dict.fromkeys(w for w in flat if w not in self.known))
        if self.known and (len(self.known) + len(new) > REMEMBERED or self.held > KEPT_CHARS):
            self.forget()
            new = list(dict.fromkeys(flat))
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])
        word, of = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)), np.repeat(np.arange(len(texts)), counts)
        told = np.zeros((len(texts), 5), np.int64)
        np.add.at(told, of, self.told[word])
        whole = (told[:, 4] == counts) & (counts > 0)
        told = np.where(whole[:, None], told[:, :4], 0)
        get, digests, at = self.text.__getitem__, [], word.tolist()
        for ok, i, n in zip(whole.tolist(), (np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
            digests.append(hashlib.sha256(";".join(map(get, at[i : i + n])).encode()).hexdigest() if ok else "")
        # pairs of each text: of its distinct words, then summed
        keep = whole[of]
        key, often = np.unique(of[keep] * len(self.text) + word[keep], return_counts=True)
        own, word = np.divmod(key, max(1, len(self.text)))
        many = self.first[word + 1] - self.first[word]
        at = np.repeat(self.first[word] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        own, code, times = np.repeat(own, many), self.pair[at], self.times[at] * np.repeat(often, many)
        order = np.lexsort((code, own))
        own, code, times = own[order], code[order], times[order]
        at = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (own[1:] != own[:-1])])) if len(code) else np.empty(0, np.int64)
        times = np.add.reduceat(times, at) if len(at) else times
        if self.held > KEPT_CHARS or any(len(w) > LONG << 10 for w in new):
            self.forget()
        return told, digests, code[at], times, np.bincount(own[at], minlength=len(texts))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(*paths: str) -> Aligner:
    """One for each worker and pair of files."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def ranges(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held < AT_ONCE):
            held += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


# ---- Spark ----

TOLD = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
NAMES = [f.split()[0] for f in TOLD.split(", ")]


def _lists(values: np.ndarray, many: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(values, kind))


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(a_path, b_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in ranges(texts):
                told, digests, pair, times, many = one.align(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(told[:, k].copy()) for k in range(4)), pa.array(digests, pa.string()), _lists(pair, many, pa.int64()), _lists(times, many, pa.int64())], names=[*NAMES, "pairs", "times"])
        one.forget()

    return run


def links(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs (A's id above 32 bits, B's id) with their times; stored."""
    spark = docs.sparkSession
    ship(spark)
    at = new_table(spark, "links")
    found = docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text")).mapInArrow(_aligned(a_path, b_path), f"{TOLD}, pairs array<bigint>, times array<bigint>")
    found.write.option("compression", "zstd").option("parquet.dictionary.page.size", 16 << 20).parquet(at)
    return spark.read.parquet(at)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows each pair is linked, and whether that is the highest count of its A id; stored."""
    counts = cut(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.shiftright("pair", 32)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return cut(counts.join(highest, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for b in batches:
            k = b.schema.names.index("pairs")
            many = b.column(k).value_lengths().to_numpy(zero_copy_only=False)
            at = np.searchsorted(pair, b.column(k).flatten().to_numpy(zero_copy_only=False))
            times = b.column(k + 1).flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(b.num_rows), many)
            sums = []
            for values in (times * best[at], times * n[at]):
                x = np.zeros(b.num_rows, np.int64)
                np.add.at(x, of, values)
                sums.append(pa.array(x))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in NAMES), *sums], names=[*NAMES, "n_best", "count_sum"])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """links() of every row without its pairs, and n_best and count_sum over its links; most: pairs up to which their counts are sent to all tasks."""
    spark = docs.sparkSession
    found = links(docs, a_path, b_path, key, text)
    counts = pair_counts(found)
    if counts.count() <= most:
        told = counts.orderBy("pair").toArrow()
        sent = spark.sparkContext.broadcast(tuple(told[c].to_numpy() for c in ("pair", "n", "best")))
        return found.mapInArrow(_scored(sent), f"{TOLD}, n_best long, count_sum long")
    # rows get a number of their own, as ids may repeat
    numbered = cut(found.select("*", F.monotonically_increasing_id().alias("row")))
    each = numbered.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return numbered.join(sums, "row", "left").select(*NAMES, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
